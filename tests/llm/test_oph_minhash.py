import random
from itertools import combinations

import numpy as np

from heronry.llm import oph_minhash as M

from ..differential import duck, rows


def brute(docs, shingle=2, percent=80):
    """(doc_id, set size, least doc_id reachable, kept) by all pairs of different sets."""
    sets = []
    for _, text in docs:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))) if w else frozenset())
    kinds = sorted(set(sets) - {frozenset()}, key=sorted)
    root = dict(zip(kinds, kinds, strict=True))

    def top(x):
        while root[x] is not x:
            x = root[x]
        return x

    for a, b in combinations(kinds, 2):
        k = len(a & b)
        if 100 * k >= percent * (len(a) + len(b) - k):
            root[top(a)] = top(b)
    least = {}
    for (i, _), s in zip(docs, sets, strict=True):
        if s and i is not None:
            least[top(s)] = min(least.get(top(s), i), i)
    out = [(i, len(s), least.get(top(s)) if s else i) for (i, _), s in zip(docs, sets, strict=True)]
    return sorted(((*r, r[0] == r[2]) for r in out), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def test_query(spark, sf_dir, documents):
    assert got(M.op13_oph_minhash(spark, sf_dir)) == brute(documents)


def test_sql(spark, sf_dir):
    assert rows(M.op13_oph_minhash(spark, sf_dir)) == duck(sf_dir, M.SQL)


def test_agreement_of_minima_is_the_similarity():
    rng = np.random.default_rng(1)
    for size, share in ((5, 0.8), (40, 0.5), (400, 0.8), (3000, 0.3)):
        found = []
        for _ in range(60):
            union = rng.integers(0, 1 << 64, size, np.uint64)
            n = round(size * share)
            half = n + (size - n) // 2
            a, b = np.sort(union[:half]), np.sort(np.concatenate([union[:n], union[half:]]))
            found.append((M.minima(a) == M.minima(b)).mean())
        assert abs(np.mean(found) - share) < 0.06, size


def perturbed(rng, base, edits):
    words = list(base)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def planted(seed):
    """Groups around a base whose members are barely or not quite similar to each other, chains, copies, and short texts."""
    rng, texts = random.Random(seed), []
    for g in range(6):
        base = [f"w{g}_{k}" for k in range(60)]
        texts += [" ".join(base)] + [perturbed(rng, base, rng.randint(1, 4)) for _ in range(12)]
        chain = list(base)
        for _ in range(6):
            chain = perturbed(rng, chain, 3).split()
            texts.append(" ".join(chain))
    texts += ["a b c d e", "a b c d e f", "b c d e f", "a b", "a b", "b a", "solo", "SOLO", "", None, "a b a b a b"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_no_link_is_lost(spark, monkeypatch):
    monkeypatch.setattr(M, "GROUP", 5)
    monkeypatch.setattr(M, "ASKING", 3)
    for seed in (1, 2):
        docs = planted(seed)
        df = spark.createDataFrame(docs, "doc_id bigint, text string")
        assert got(M.near_duplicates(df)) == brute(docs)
        assert got(M.near_duplicates(df, block=4)) == brute(docs)  # large buckets, dealt into blocks
    assert got(M.near_duplicates(df, shingle=1, percent=90)) == brute(docs, 1, 90)


def test_blocks_find_all_that_one_comparison_finds(spark):
    rng = np.random.default_rng(2)
    n = 90
    sketches = rng.integers(0, 256, (3, M.BINS), np.uint8)[rng.integers(0, 3, n)]
    sketches[rng.random((n, M.BINS)) < 0.1] = 7
    roots, sizes = np.where(rng.random(n) < 0.6, 0, rng.integers(0, n, n)), rng.integers(90, 110, n)
    blocks = rng.integers(0, 9, n)
    near = lambda i, j: roots[i] != roots[j] and 100 * min(sizes[i], sizes[j]) >= 80 * max(sizes[i], sizes[j]) and (sketches[i] == sketches[j]).sum() >= M.least_agreement(80)
    members = spark.createDataFrame([(k % 2, i) for k in range(2) for i in range(n)], "key bigint, cid bigint")
    rooted = spark.createDataFrame([(i, int(roots[i]), int(sizes[i]), sketches[i].tobytes(), int(blocks[i])) for i in range(n)], "cid bigint, root bigint, n bigint, sketch binary, block bigint")
    pairs = [(i, j) for i, j in combinations(range(n), 2) if near(i, j)]
    for block in (1000, 16, 3):
        asks = {(r.cid, r.block) for r in M.unconnected(members, rooted, 80, block).collect()}
        assert all((i, blocks[j]) in asks or (j, blocks[i]) in asks for i, j in pairs), block
        assert all(any(near(i, j) for j in range(n) if blocks[j] == b) for i, b in asks), block


def test_odd_rows(spark, odd, none):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(M.near_duplicates(odd)) == brute(docs)
    assert M.near_duplicates(none).count() == 0 and M.keep_one(none).count() == 0
    kept = M.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [0, 2, 3, 4, 5, 5, 6, 7, 8]
    same = spark.createDataFrame([(None, "one two three"), (None, "one two three"), (4, "One two three"), (9, "five six")], "doc_id bigint, text string")
    assert got(M.near_duplicates(same)) == brute([(r.doc_id, r.text) for r in same.collect()])


def test_very_long_texts(spark):
    rng = random.Random(3)
    words = [f"word{rng.randrange(5000)}" for _ in range(150_000)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:-9000])), (3, " ".join(words[:60_000])), (4, "y" * 1_000_000)]
    assert got(M.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"))) == brute(docs)


def test_no_round_for_stars(spark, monkeypatch):
    """A round deals all edges anew several times, which on check_h took longer than the work; stars need none."""
    from heronry.llm import components as C

    rounds, large = [], C._large
    monkeypatch.setattr(C, "_large", lambda e: rounds.append(1) or large(e))
    stars = spark.createDataFrame([(k, 0) for k in range(1, 90)] + [(100, k) for k in range(101, 130)], "u bigint, v bigint")
    assert {(r.node, r.root) for r in C.components(stars).collect()} == {(k, 0) for k in range(90)} | {(k, 100) for k in range(100, 130)} and not rounds
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)], "u bigint, v bigint")
    assert {(r.node, r.root) for r in C.components(chain).collect()} == {(k, 0) for k in range(41)} and rounds
