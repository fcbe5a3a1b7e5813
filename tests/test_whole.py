"""Whole queries without SQL against plain Python on the same tables."""

import re

import duckdb
import pytest

from heronry.plans import catalogue


def _texts(sf_dir):
    return duckdb.execute(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()


def _similar(texts):
    """(left, right) -> similarity of the first documents of different texts, and the class of every document."""
    plain = {i: re.sub(r"\s+", " ", t).lower() for i, t in texts}
    first = {}
    for i in sorted(plain):
        first.setdefault(plain[i], i)
    runs = {i: {t[k : k + 7] for k in range(len(t) - 6)} or {t} for t, i in first.items()}
    pairs = {}
    for a in runs:
        for b in runs:
            if a < b:
                both = len(runs[a] & runs[b])
                j = both / (len(runs[a]) + len(runs[b]) - both)
                if j >= 0.85:
                    pairs[a, b] = j
    return pairs, {i: first[t] for i, t in plain.items()}


def test_shingle_jaccard(spark, sf_dir):
    pairs, classes = _similar(_texts(sf_dir))
    got = catalogue.QUERIES["shingle_jaccard"](spark, sf_dir).collect()
    assert {(r.left_id, r.right_id): r.jaccard for r in got if r.kind == "similar"} == {k: pytest.approx(v, abs=1e-6) for k, v in pairs.items()}
    assert sorted((r.right_id, r.left_id) for r in got if r.kind == "member") == sorted(classes.items())


def test_trigger_clusters(spark, sf_dir):
    members = {r.atom_id: r.class_id for r in catalogue.QUERIES["trigger_members"](spark, sf_dir).collect()}
    root = {c: c for c in members.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in catalogue.QUERIES["trigger_pairs"](spark, sf_dir).collect():
        a, b = sorted((find(r.left_id), find(r.right_id)))
        root[b] = a
    got = {r.atom_id: r.root for r in catalogue.QUERIES["trigger_clusters"](spark, sf_dir).collect()}
    assert got == {i: find(c) for i, c in members.items()}
