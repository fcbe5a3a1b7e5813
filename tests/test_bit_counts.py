import os

import numpy as np

from heronry.operators import postings, search
from heronry.sources.shared import shared_dir


def test_first_of_block_equals_a_full_sort():
    rng = np.random.default_rng(3)
    for width, n_terms, limit in ((1, 5, 3), (3, 40, 7), (2, 9, 18), (4, 33, 1)):
        held = rng.random((n_terms + 1, width * 64)) < rng.random((n_terms + 1, 1)) ** 2
        held[0] = False
        bits = np.packbits(held, axis=1, bitorder="little").view(np.uint64)
        rows = rng.integers(0, n_terms + 1, (20, n_terms))
        planes = postings.counted(bits, rows)
        full = held[rows].sum(axis=1)
        assert (sum(np.unpackbits(p.view(np.uint8), axis=1, bitorder="little").astype(int) << k for k, p in enumerate(planes)) == full).all()
        marks = rng.integers(1, n_terms // 2 + 1, 20)
        q, at, n = postings.first_of_block(planes, marks, limit)
        for k in range(20):
            got = sorted((-c, p) for c, p in zip(n[q == k].tolist(), at[q == k].tolist()))
            assert got[:limit] == sorted((-int(c), p) for p, c in enumerate(full[k]) if c >= marks[k])[:limit]
            assert len(got) <= limit + 63


def test_equal_texts_are_not_looked_at_one_by_one():
    planes = postings.counted(np.full((2, 64), ~np.uint64(0)), np.ones((5, 9), int))
    q, at, n = postings.first_of_block(planes, np.ones(5, int), 18)
    assert len(q) <= 5 * 64 and set(n.tolist()) == {9} and [at[q == k].min() for k in range(5)] == [0] * 5


def test_a_search_writes_no_index(spark):
    corpus = spark.createDataFrame([(k, f"a{k} common b{k % 7}", "p") for k in range(300)], "item_id bigint, content string, project string")
    q = spark.createDataFrame([(1, ["common", "b3"]), (2, ["zzz"]), (3, []), (4, None)], "query_id int, terms array<string>")
    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    found = postings.search(postings.build(corpus), q, 5)
    assert sorted(tuple(r) for r in found.collect() if r["n"] == 2)[:5] == [(1, k, 2, 2) for k in (3, 10, 17, 24, 31)]
    assert (set(os.listdir(folder)) if os.path.isdir(folder) else set()) == before


def test_no_query_and_no_text(spark):
    none = spark.createDataFrame([], "query_id int, terms array<string>")
    empty = spark.createDataFrame([], "item_id bigint, content string, item_type string")
    some = spark.createDataFrame([(1, "a b")], "item_id bigint, content string")
    assert search.lexical(none, some).collect() == [] and search.lexical(none.union(spark.createDataFrame([(1, ["a"])], none.schema)), empty).collect() == []
