"""Conventions at the head of a pack; rejections and projects that count before the best are chosen."""

import random

from pyspark.sql import functions as F

from heronry.operators import context, ranking, search


def plain(candidates, budget):
    """Sections of one query's (item, tokens, convention) in order, by the rules of the pack."""
    budget = max(900, budget)
    first, second = -(-budget * 52 // 100), -(-budget * 34 // 100)
    pinned = [c for c in candidates if c[2]][:5]
    rest = [c for c in candidates if c not in pinned]

    def take(left, room, most):
        took, used = [], 0
        for c in left:
            if len(took) < most and used + min(c[1], room) <= room:
                took.append(c)
                used += min(c[1], room)
        return took

    out = [("essential", c) for c in pinned]
    for name, room, most in (("essential", max(0, first - sum(c[1] for c in pinned)), 4), ("supporting", second, 6), ("optional", budget - first - second, 8)):
        took = take(rest, room, most)
        rest = [c for c in rest if c not in took]
        out += [(name, c) for c in took]
    return [(name, c[0], c[1]) for name, c in out]


def test_sections(spark):
    rng = random.Random(4)
    queries = {q: [(i, rng.choice([1, 50, 200, 700]), rng.random() < 0.3) for i in range(rng.randint(0, 30))] for q in range(40)}
    queries |= {40: [(i, 100, i >= 3) for i in range(12)], 41: [(i, 300, True) for i in range(7)], 42: [(i, 100, False) for i in range(9)]}
    df = spark.createDataFrame([(q, k, *c) for q, cs in queries.items() for k, c in enumerate(cs)], "query_id int, rank int, item_id int, tokens bigint, convention boolean")
    for budget in (0, 1500):
        got = {}
        for r in ranking.pack(df, budget).collect():
            got.setdefault(r.query_id, []).append((r.section, r.item_id, r.tokens))
        assert got == {q: plain(cs, budget) for q, cs in queries.items() if cs}
    assert [r[1] for r in plain(queries[40], 0)[:5]] == [3, 4, 5, 6, 7]
    without = df.where("query_id = 42")
    assert sorted(ranking.pack(without, 900).collect()) == sorted(ranking.pack(without.drop("convention"), 900).collect())


def test_rejected_and_other_projects_are_refilled(spark):
    rng = random.Random(5)
    n = 120
    items = spark.createDataFrame([(i, f"p{i % 3}", "approved" if i % 7 else "archived") for i in range(n)], "item_id int, project string, status string")
    wanted = {0: None, 1: "p1", 2: "p2"}
    rejected = [(q, i) for q in wanted for i in rng.sample(range(n), 40)]
    rj = spark.createDataFrame(rejected, "query_id int, item_id int")
    q = spark.createDataFrame(list(wanted.items()), "query_id int, wanted_project string")
    may = {k: [i for i in range(n) if i % 7 and (w is None or f"p{i % 3}" == w) and (k, i) not in rejected] for k, w in wanted.items()}

    labels = items.where("status = 'approved'").select("item_id", F.lit("file").alias("type"), F.lit("a.ts").alias("value"), (F.col("item_id") * 37 % 100).alias("trust"), F.lit(None).cast("date").alias("fresh_on"), "project")
    signals = q.select("query_id", F.col("wanted_project").alias("wanted"), F.lit("file").alias("type"), F.lit("a.ts").alias("value"), F.lit(True).alias("precise"))
    got = {}
    for r in sorted(search.by_label(signals, labels, 6, rj).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.item_id)
    assert got == {k: sorted(v, key=lambda i: (-(i * 37 % 100), i))[:6] for k, v in may.items()}

    edges = spark.createDataFrame([(200, i, "refines", round(i * 13 % 101 / 101, 6)) for i in range(n)], "src int, dst int, kind string, confidence double")
    seeds = q.select("query_id", F.lit(200).alias("item_id"))
    hits = search.graph(seeds, edges, seeds.limit(0), 6, lambda h: context.eligible(h, items, rj, q)).collect()
    got = {k: [r.item_id for r in sorted(hits, key=lambda r: r["rank"]) if r.query_id == k] for k in wanted}
    assert got == {k: sorted(v, key=lambda i: (-round(0.68 * round(i * 13 % 101 / 101, 6), 6), i))[:6] for k, v in may.items()}

    facts = spark.createDataFrame([(i, ["k"], "verified", None, "active", f"p{i % 3}") for i in range(n)], "atom_id int, keys array<string>, tier string, last_reused timestamp, status string, project string")
    asked = q.select("query_id", F.array(F.lit("k")).alias("keys"), F.col("wanted_project").alias("wanted"))
    got = {}
    for r in sorted(search.by_trigger(asked, facts, 5).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.atom_id)
    assert got == {k: [i for i in range(n) if w is None or f"p{i % 3}" == w][:5] for k, w in wanted.items()}
