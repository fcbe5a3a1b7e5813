import random

import numpy as np

from heronry.operators import postings, search


def brute(docs, queries, limit):
    out = {}
    for q, terms, wanted, rejected in queries:
        terms = list(dict.fromkeys(terms))
        rows = [(-sum(t in (text or "").lower() for t in terms), i) for i, text, g in docs if (wanted is None or g == wanted) and i not in (rejected or ())]
        out[q] = [(i, -n) for n, i in sorted(r for r in rows if r[0] < 0)[:limit]]
    return {q: v for q, v in out.items() if v}


def made(seed, n):
    """Texts over few frequent and many rare words; queries with substrings, blanks, short terms, groups and rejected ids."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["the", "of", "and", "é", "Alpha/Beta", "x"]
    weights = [1 / (k + 1) for k in range(400)] + [3, 3, 2, 0.2, 0.1, 0.3]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 30))) if i % 17 else None, f"g{i % 3}") for i in range(n)]
    queries = [(q, [*(rng.choice(words).lower() for _ in range(rng.randint(1, 14))), *rng.choices(["w1 w", "w", "", "a/b", "zzz", "and the"], k=2)], rng.choice([None, "g0", "g1", "none"]), rng.sample(range(n), rng.choice([0, 5, n // 2]))) for q in range(40)]
    return docs, [(q, [t for t in ts if t], w, r) for q, ts, w, r in queries]


def test_best_by_count(spark, monkeypatch):
    docs, queries = made(1, 900)
    corpus = spark.createDataFrame(docs, "item_id bigint, content string, project string").repartition(3)
    q = spark.createDataFrame(queries, "query_id int, terms array<string>, wanted string, rejected array<bigint>")
    for size in (postings.DOCS, 50):
        monkeypatch.setattr(postings, "DOCS", size)
        got = {}
        for r in sorted(search.lexical(q, corpus, 7, "project").collect(), key=lambda r: (r.query_id, r.rank)):
            got.setdefault(r.query_id, []).append((r.item_id, r.raw))
        want = brute(docs, queries, 7)
        sizes = {k: len(set(ts)) for k, ts, _, _ in queries}
        assert got == {k: [(i, round(n / sizes[k], 6)) for i, n in v] for k, v in want.items()}, size


def test_rarest_first_equals_a_full_count():
    rng = np.random.default_rng(5)
    for _ in range(300):
        own = [np.flatnonzero(rng.random(60) < p) for p in rng.random(rng.integers(1, 9)) ** 2]
        own = [x for x in own if len(x)]
        mark = int(rng.integers(1, 6))
        full = sum((np.bincount(x, minlength=60) for x in own), np.zeros(60, int))
        at, n = postings.best_of_block(own, mark, None)
        assert dict(zip(at[n >= mark].tolist(), n[n >= mark].tolist())) == {int(p): int(full[p]) for p in np.flatnonzero(full >= mark)}


def test_a_frequent_term_alone_opens_few_candidates():
    often, rare = [np.arange(4000)] * 9, [np.array([5, 77]), np.array([77])]
    at, n = postings.best_of_block([*often, *rare], 10, None)
    assert at.tolist() == [5, 77] and n.tolist() == [10, 11]
    assert len(postings.best_of_block(often, 10, None)[0]) == 0
