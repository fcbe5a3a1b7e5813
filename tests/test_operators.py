"""Operators on small tables worked out by hand or by plain Python."""

from itertools import combinations

from pyspark.sql import functions as F

from heronry.functions import text as T
from heronry.functions import vectors as V
from heronry.operators import curation, evaluation, graph, operations, ranking, search


def test_text_functions(spark):
    r = spark.createDataFrame([("  A  b\tC! ", "0 x")], "a string, b string").select(T.normalize_text(F.col("a")).alias("n"), T.normalize_label(F.col("a")).alias("l"), T.estimate_tokens(F.col("a")).alias("t"), T.truncate(F.lit("abcdefgh"), 6).alias("c")).first()
    assert (r.n, r.l, r.t, r.c) == ("A b C!", "a-b-c", 3, "abc...")


def test_area_key(spark):
    paths = {"": "_unassigned", "x.md": "_root", "src/a.ts": "src", "src/lib/a.ts": "src/lib", "./docs/a/b": "docs"}
    got = {r.p: r.k for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", T.area_key(F.col("p")).alias("k")).collect()}
    assert got == paths


def test_cosine(spark):
    r = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0], [])], "a array<double>, b array<double>, c array<double>").select(V.cosine(F.col("a"), F.col("a")).alias("x"), V.cosine(F.col("a"), F.col("b")).alias("y"), V.cosine(F.col("a"), F.col("c")).alias("z")).first()
    assert (r.x, r.y, r.z) == (1.0, 0.0, 0.0)


def test_fuse(spark):
    hits = spark.createDataFrame([(1, "lexical", 10, 0.9, 1), (1, "lexical", 11, 0.8, 2), (1, "vector", 11, 0.7, 1)], "query_id int, source string, item_id int, raw double, rank int")
    got = [(r.item_id, r.score, r.n_hits) for r in ranking.fuse(hits, ranking.source_weight(F.col("source"))).orderBy("rank").collect()]
    a, b = 1 / 61, 1 / 62 + 0.92 / 61
    assert got == [(11, 1.0, 2), (10, round(a / b, 6), 1)]


def greedy(rows, budget):
    first, second = -(-budget * 52 // 100), -(-budget * 34 // 100)
    out, left = [], list(rows)
    for name, most, n in (("essential", first, 4), ("supporting", second, 6), ("optional", budget - first - second, 8)):
        used, took, rest = 0, 0, []
        for i, t in left:
            if took < n and used + min(t, most) <= most:
                used, took = used + min(t, most), took + 1
                out.append((name, i))
            else:
                rest.append((i, t))
        left = rest
    return out


def test_pack(spark):
    rows = [(k, (k * 173) % 610 + 20) for k in range(1, 19)]
    got = ranking.pack(spark.createDataFrame([(1, k, k, t) for k, t in rows], "query_id int, rank int, item_id int, tokens bigint"), 1500).collect()
    assert sorted((r.section, r.item_id) for r in got) == sorted(greedy(rows, 1500))


def test_suppress(spark):
    f = F.lit(False)
    cols = [ranking.suppress(F.lit(0.5), F.lit(None).cast("double"), f, F.lit(None).cast("string"), f, F.lit(None).cast("boolean")), ranking.suppress(F.lit(0.5), F.lit(None).cast("double"), f, F.lit(None).cast("string"), f, F.lit(True)), ranking.suppress(F.lit(0.12), F.lit(1.0), F.lit(True), F.lit("stale"), f, F.lit(False))]
    r = spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).first()
    assert (r.c0, r.c1, r.c2) == (0.5, 0.65, 0.1)


def test_walk_and_impact(spark):
    e = spark.createDataFrame([(1, 2, "refines"), (2, 3, "depends_on"), (1, 4, "supersedes"), (2, 1, "related_to"), (2, 5, "refines")], "src int, dst int, kind string")
    seeds = spark.createDataFrame([(9, 1)], "query_id int, item_id int")
    nodes = spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "item_id int")
    got = sorted((r.item_id, r.hop, r.score) for r in graph.walk(seeds, e, nodes).collect())
    assert got == [(2, 1, 0.7), (3, 2, round(0.7 * 0.6 * 0.6, 6))]


def test_co_change(spark):
    c = spark.createDataFrame([(k, p) for k in range(3) for p in "ab"] + [(3, "a"), (4, "c")], "commit_id int, path string")
    assert [tuple(r) for r in graph.co_change(c).collect()] == [("a", "b", 3, 0.75)]


def test_set_pairs_and_clusters(spark):
    import random

    rng = random.Random(3)
    sets = {k: set(rng.sample(range(12), rng.randint(1, 8))) for k in range(60)}
    df = spark.createDataFrame([(k, list(v)) for k, v in sets.items()], "set_id int, members array<int>")
    want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    pairs = graph.set_pairs(df, 0.6)
    assert {(r.left_id, r.right_id): r.jaccard for r in pairs.collect()} == want
    root = {k: k for k in sets}
    for _ in sets:
        for a, b in want:
            root[a] = root[b] = min(root[a], root[b])
    found = graph.clusters(df.select(F.col("set_id").alias("node")), pairs)
    assert {r.node: r.root for r in found.collect()} == root


def test_similar_texts(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away into the woods"
    docs = spark.createDataFrame([(1, base), (2, base), (3, base + "!"), (4, "something else altogether, with no likeness")], "doc_id int, text string")
    assert [(r.left_id, r.right_id) for r in graph.similar_texts(docs).collect()] == [(1, 3)]


def test_every_copy_is_a_member(spark, tmp_path):
    from heronry.plans import catalogue

    base = "the quick brown fox jumps over the lazy dog and runs far away into the woods"
    docs = [(1, base), (2, base.upper()), (3, base + "!"), (4, "something else altogether, with no likeness"), (5, base + " !"), (6, base), (None, base), (7, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, [1.0, 0.0], 0) for k in range(1, 7)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalogue.QUERIES["shingle_jaccard"](spark, str(tmp_path)).collect()
    members = [(r.right_id or 0, r.left_id) for r in got if r.kind == "member"]
    assert sorted(members) == [(0, 1), (1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 1), (7, 7)]
    assert {(r.left_id, r.right_id) for r in got if r.kind == "similar"} == {(1, 3), (1, 5), (3, 5)}
    linked = graph.class_links(spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4)], "atom_id int, class_id int"), spark.createDataFrame([(1, 3)], "left_id int, right_id int"))
    assert sorted((r.atom_id, r.class_id, r.n_links) for r in linked.collect()) == [(1, 1, 1), (2, 1, 1), (3, 3, 1), (4, 4, 0)]


def test_tier_and_write(spark):
    t = lambda tier, v, n, d: curation.tier_transition(F.lit(tier), F.lit(v), F.lit(n), F.lit(d).cast("timestamp"), "2024-01-31")
    w = lambda *x: curation.write_decision(*map(F.lit, x))
    cols = [t("draft", True, 2, "2024-01-01"), t("draft", True, 1, "2024-01-01"), t("verified", True, 9, "2023-01-01"), t("canonical", False, 0, None), w(0.95, 0.8, True, 0.0), w(0.85, 0.1, True, 0.0), w(0.85, 0.6, False, 0.5), w(0.5, 1.0, True, 1.0)]
    assert list(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).first()) == ["verified", "draft", "draft", "canonical", "NOOP", "DELETE", "UPDATE", "ADD"]


def test_sync_plan_renames(spark):
    a = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", "h3")], "path string, hash string")
    b = spark.createDataFrame([("a", "h9"), ("d", "h2"), ("e", "h7"), ("c", "h3")], "path string, hash string")
    got = sorted(tuple(r) for r in operations.sync_plan(a, b, F.lit(False)).collect())
    assert got == [("a", "changed", None), ("c", "unchanged", None), ("d", "renamed", "b"), ("e", "added", None)]


def test_nearest_rank(spark):
    got = evaluation.nearest_rank(spark.createDataFrame([("x", float(v)) for v in (5, 1, 3, 2, 4)], "g string, v double"), "v", (0.5, 0.95), "g").first()
    assert (got.p50, got.p95, got.most) == (3.0, 5.0, 5.0)


def test_searches_send_blocks(spark, sf_dir, monkeypatch):
    from heronry.plans import catalogue

    from .differential import duck, rows

    sent = []
    for name in ("lexical_scores", "vector_scores"):
        monkeypatch.setattr(search, name, lambda q, *c, f=getattr(search, name): sent.append(q.count()) or f(q, *c))
    monkeypatch.setattr(search, "BLOCK", 1)
    for name in ("lexical_topk", "vector_topk", "item_best_chunk", "semantic_neighbors", "write_gate"):
        sent.clear()
        assert rows(catalogue.QUERIES[name](spark, sf_dir)) == duck(sf_dir, catalogue.SQL[name])
        assert len(sent) > 1 and sum(sent) == len(spark.read.parquet(f"{sf_dir}/{'documents' if name == 'lexical_topk' else 'embeddings'}.parquet").where(("doc_id" if name == "lexical_topk" else "vec_id") + " % 100 = 0").collect())


def test_terms_meet_words(spark):
    texts = {1: "An Alpha/beta.c x\u00a0y caf\u00e9s \U0001f600\U0001f601go", 2: "alphabet b", 3: "", 4: None, 5: "two  words and (alpha) ab"}
    asked = {1: ["alpha", "ha/be", "ab", "zzz"], 2: ["d (a", "\U0001f600\U0001f601", "f\u00e9s", "\U0001f601go"], 3: ["b", "none here"]}
    q = spark.createDataFrame(list(asked.items()), "query_id int, terms array<string>")
    known = search.postings.build(spark.createDataFrame(list(texts.items()), "item_id int, content string"))
    got = {(r.query_id, r.item_id): r.raw for r in search.lexical_scores(q, known, 18).collect()}
    count = {(k, i): sum(t in (x or "").lower() for t in ts) / len(ts) for k, ts in asked.items() for i, x in texts.items()}
    assert got == {k: round(v, 6) for k, v in count.items() if v}
