from pyspark.sql import functions as F

from heronry.operators import chunking, sessions


def test_chunks_lose_nothing():
    text = "one two.\n\n" + "Sentence number one is here. " * 200 + "\n\nlast"
    got = chunking.chunks(text, 50)
    assert " ".join(" ".join(got).split()) == " ".join(text.split()) and all(len(c) <= 50 * 4 for c in got)
    assert chunking.chunks("") == [] and chunking.chunks("a\n\nb") == ["a\n\nb"]


def test_sections():
    text = "intro\n# A\nx\n```\n# no\n```\n## B b\ny\n# A\nz"
    assert chunking.sections(text) == [("a", "A", "x\n```\n# no\n```"), ("b-b", "A > B b", "y"), ("a-2", "A", "z")]


def test_first_fit(spark):
    rows = [(1, 1, [1.0, 0.0]), (1, 2, [0.9, 0.1]), (1, 3, [0.0, 1.0]), (2, 4, [1.0, 0.0])]
    got = {r.item_id: r.cluster for r in chunking.first_fit(spark.createDataFrame(rows, "owner int, item_id int, vector array<double>")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_first_fit_of_one_large_owner(spark, monkeypatch):
    import random

    rng = random.Random(7)
    rows = [(k % 9 and 1 or 2, k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(300)] + [(None, 900, [1.0, 0.0, 0.0, 0.0]), (None, 901, [1.0, 0.1, 0.0, 0.0]), (1, 7, [0.0] * 4), (1, 7, [0.0] * 4)]
    want, firsts = [], {}
    for o, i, v in sorted(rows, key=lambda r: r[1]):
        n = sum(x * x for x in v) ** 0.5 or 1
        own = firsts.setdefault(o, [])
        near = [c for c, f in own if sum(a * b for a, b in zip(f, v)) / n >= 0.8]
        if not near:
            own.append((i, [x / n for x in v]))
        want.append((o or 0, i, near[0] if near else i))
    monkeypatch.setattr(chunking, "LEADERS", 10, raising=False)
    monkeypatch.setattr(chunking, "PART", 40, raising=False)
    sizes = spark.sparkContext.accumulator(0)
    fit = chunking._fit

    def bounded(ids, *rest):
        sizes.add(len(ids) > 120)
        return fit(ids, *rest)

    monkeypatch.setattr(chunking, "_fit", bounded)
    df = spark.createDataFrame(rows, "owner int, item_id int, vector array<double>").repartition(3)
    got = chunking.first_fit(df, 0.8).collect()
    assert sorted((r.owner or 0, r.item_id, r.cluster) for r in got) == sorted(want)
    assert sizes.value == 0
    assert chunking.first_fit(df.limit(0)).count() == 0


def test_compliance(spark):
    c = lambda *x: sessions.compliance(*map(F.lit, x))
    r = spark.range(1).select(c(True, 1, 0, True).alias("a"), c(False, 1, 1, True).alias("b"), c(False, 0, 1, True).alias("c"), c(False, 0, 0, True).alias("d"), c(False, 0, 0, False).alias("e")).first()
    assert list(r) == ["bypassed", "compliant", "missing_context_recorded", "needs_decision", "non_compliant"]
