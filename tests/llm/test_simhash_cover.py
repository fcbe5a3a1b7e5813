import random
from itertools import combinations

import numpy as np
import xxhash

from heronry.llm import simhash_cover as M


def brute(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}
    links = [(a, b) for a, b in combinations(ids, 2) if (prints[a] ^ prints[b]).bit_count() <= 3]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    return root


def test_masks_cover():
    rng = random.Random(6)
    for _ in range(3000):
        bits = sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3)))
        assert any(bits & m == 0 for m in M.masks())


def test_query(spark, sf_dir, documents):
    prints = {i: brute(t) for i, t in documents}
    root = components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in M.op5_simhash_cover(spark, sf_dir).collect()}
    assert got == {i: (f"{prints[i]:016x}", root[i]) for i in prints}


def test_large_buckets_are_cut_into_blocks(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(3)]
    fps = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(60)}
    ids = dict(enumerate(sorted(fps)))
    root = components(ids)
    signed = [(int(np.uint64(x).view(np.int64)),) for x in fps]
    edges = [(e.u, e.v) for e in M.links(spark.createDataFrame(signed, "fp bigint"), bucket=8).collect()]
    back = {int(np.uint64(x).view(np.int64)): i for i, x in ids.items()}
    got = dict.fromkeys(ids)
    got = {i: i for i in ids}
    for _ in ids:
        for u, v in edges:
            m = min(got[back[u]], got[back[v]])
            got[back[u]] = got[back[v]] = m
    assert got == root and all((ids[back[u]] ^ ids[back[v]]).bit_count() <= 3 for u, v in edges)


def test_odd_rows(odd, none):
    got = {r.doc_id: r for r in M.near_components(odd).collect()}
    assert {got[k].fingerprint for k in (2, 3, 4)} == {"0" * 16} and {got[k].component_id for k in (2, 3, 4)} == {2}
    assert got[0].component_id == got[1].component_id == 0 and got[None].component_id is None
    assert M.near_components(none).count() == 0
    kept = M.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [0, 2, 5, 6, 7, 8]


def test_a_hub_is_dealt_out(spark):
    from heronry.llm.components import PARTS, _told
    from heronry.llm.components import components as linked

    hub = [(0, k) for k in range(1, 900)] + [(1000, k) for k in range(600, 1000)] + [(k, k + 1) for k in range(2000, 2040)]
    edges = spark.createDataFrame(hub, "u bigint, v bigint")
    got = {r.node: r.root for r in linked(edges).collect()}
    assert got == {**dict.fromkeys(range(1001), 0), **dict.fromkeys(range(2000, 2041), 2000)}
    told, _ = _told(edges)
    assert told.count() == len(hub)
    parts = edges.where("u = 0").groupBy(M.F.pmod(M.F.xxhash64("v"), M.F.lit(PARTS))).count().agg({"count": "max"}).first()[0]
    assert parts <= 899 // PARTS * 3
