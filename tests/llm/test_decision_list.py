import re
from collections import Counter

from pyspark.sql import functions as F

from heronry.llm import decision_list as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    at = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    n = Counter(at)
    covered = {j for k, w in enumerate(at) if n[w] > 1 for j in range(k, k + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark, sf_dir, documents, odd, none):
    extra = [(1000 + k, t) for k, t in enumerate(["a b c d e a b c d e", "x " * 30, "x\n\nx\n \ny\nx", "  lead and trail  ", "a b c d", "\x0b\x1cz q"])]
    docs = spark.createDataFrame([*documents, *extra], "doc_id bigint, text string")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = {r.doc_id: tuple(r[n] for n in names) for r in M.judge(docs, []).collect()}
    assert got == {i: brute(t) for i, t in [*documents, *extra]}
    assert {tuple(r[n] for n in names) for r in M.judge(odd, []).where("doc_id IN (2, 3, 4)").collect()} == {(0, 0, 0, 0, 0)}
    assert M.judge(odd, []).count() == odd.count() and M.judge(none, []).count() == 0


def test_rules_cover_what_is_bad():
    rows = [{"a": float(k % 10), "b": float(k % 7)} for k in range(300)]
    rules = M.learn_rules(rows, [r["a"] > 7 or r["b"] < 1 for r in rows])
    caught = [any(all(c.holds(r[c.feature]) for c in rule) for rule in rules) for r in rows]
    assert caught == [r["a"] > 7 or r["b"] < 1 for r in rows]
    assert M.learn_rules(rows, [False] * 300) == [] == M.learn_rules([], [])


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    marks = spark.read.parquet(f"{sf}/labels.parquet").where(M.fold_crc("doc_id", 5) == 0)
    got = M.op4_decision_list(spark, sf).join(marks, "doc_id").collect()
    good, bad = [r for r in got if r.quality == 1], [r for r in got if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.9 * len(good) and sum(r.kept for r in bad) <= 0.3 * len(bad)


def test_no_python_in_the_plan(spark, sf_dir):
    plan = M.op4_decision_list(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_without_labels(odd, spark):
    labels = spark.createDataFrame([(0, 1)], "doc_id bigint, quality int")
    assert M.learn(odd, labels, F.lit(True)) == [] and M.learn(odd, labels.limit(0), F.lit(True)) == []


def test_long_runs_of_white_space(spark):
    import time

    docs = spark.createDataFrame([(1, "a" + " " * (1 << 20) + "b"), (2, " \t\n\x0b\x0c\r" * 200_000 + "one two"), (3, "x y" + "\n" * (1 << 20))], "doc_id bigint, text string")
    began = time.time()
    assert {r.doc_id: r.n_words for r in M.judge(docs, []).collect()} == {1: 2, 2: 2, 3: 2}
    assert time.time() - began < 60


def test_a_document_labelled_good_and_bad_is_bad(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(20)) + (" #$% #$% #$%" if k % 2 else "")) for k in range(60)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(60)] + [(k, 0) for k in range(60) if k % 2], "doc_id bigint, quality int")
    rules = M.learn(docs, labels, F.lit(True))
    assert rules and rules == M.learn(docs, labels.repartition(7, F.rand(1)), F.lit(True))
    assert {r.doc_id for r in M.judge(docs, rules).where("kept").collect()} == set(range(0, 60, 2))


def test_verdicts_are_those_of_the_rules(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    rules = M.learn(docs, labels, M.fold_crc("doc_id", 5) != 0)
    own = {r.doc_id: r for r in M.statistics(docs).select("*", M.base_failed().alias("failed"), *[x.alias(n) for n, x in M.features().items()]).collect()}
    for r in M.judge(docs, rules).collect():
        rejects = [k for k, rule in enumerate(rules) if all(c.holds(own[r.doc_id][c.feature]) for c in rule)]
        assert r.rule == (rejects[0] if rejects else None) and r.kept == (not own[r.doc_id].failed and not rejects)
