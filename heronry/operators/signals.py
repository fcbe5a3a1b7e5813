"""Classification of prompts and texts: signals, task, confidence, safety, hash embeddings, anchor windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import policy as P
from ..functions import text as T


def classify(prompts: DataFrame) -> DataFrame:
    """prompts (prompt and others) with task, files, symbols, errors, technologies, areas, domain, n_signals, confidence."""
    c, own = F.col("prompt"), F.col("_own")
    # Files are taken out once: a column that is used more than once is not put into the expressions that use it.
    rows = prompts.withColumn("_own", T.without_files(c))
    found = rows.select("*", T.task_type(c).alias("task"), T.files(c).alias("files"), T.symbols_without_files(own).alias("symbols"), T.errors_without_files(own).alias("errors"), T.terms_in(c, P.TECHNOLOGIES).alias("technologies"), T.hints_in(c, P.BUSINESS_AREAS).alias("areas")).drop("_own")
    lists = ("files", "symbols", "errors", "technologies", "areas")
    n = sum(((F.size(x) > 0).cast("int") for x in lists), (F.col("task") != "unknown").cast("int"))
    return found.withColumns({"domain": T.domain(F.col("files")), "n_signals": n}).withColumn("confidence", T.confidence(F.col("n_signals")))


def intent(classified: DataFrame) -> DataFrame:
    """classified prompts with continuation, stage, mode, required (kinds of evidence asked for) and uncertain (why the request is unclear)."""
    low, task, size = F.lower("prompt"), F.col("task"), lambda c: F.size(c) > 0
    rows = classified.withColumn("continuation", low.rlike(P.CONTINUATION_PATTERN))
    go_on = F.col("continuation")
    by = lambda values, rest: F.coalesce(*[F.when(task == t, F.lit(v)) for t, v in values.items()], F.lit(rest))
    worded = reduce(lambda w, mp: w.when(low.rlike(mp[1]), mp[0]), P.MODE_PATTERNS, F.when(F.lit(False), ""))
    some = lambda cond, *v: F.when(cond, F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>"))
    asked = F.coalesce(*[F.when(task == t, F.array(*map(F.lit, v))) for t, v in P.EVIDENCE.items()], F.array(F.lit("docs")))
    required = F.array_distinct(F.concat(some(go_on, "handoff", "session_history", "workflow"), asked, some(size("files") | size("symbols"), "code_reference"), some(size("errors"), "bugfix", "incident_lesson"), some(low.rlike(P.MEMORY_WORDS), "reflection_memory")))
    unclear = F.concat(some(F.col("project").isNull(), "project is unclear"), some(task == "unknown", "task type is unclear"), some(~(size("files") | size("symbols") | size("errors")), "no concrete file, symbol, or error signal was supplied"), some(go_on, "continuation prompt relies on handoff or recent selected-session context"))
    return rows.withColumns({"stage": F.when(go_on, "continuation").otherwise(by(P.STAGES, "unknown")), "mode": worded.when(go_on, "implementation").otherwise(by(P.MODES, "unknown")), "required": required, "uncertain": unclear})


def located(text: Column, pattern: str) -> Column:
    """value and at, its offset, of every match of pattern."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
    pairs = F.arrays_zip(hits.alias("hit"), F.slice(gaps, 1, F.size(hits)).alias("gap"))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<value:string,at:int>>").alias("found"))

    def step(a, x):
        at = a["end"] + F.length(x["gap"])
        return F.struct((at + F.length(x["hit"])).alias("end"), F.array_append(a["found"], F.struct(x["hit"].alias("value"), at.alias("at"))).alias("found"))

    return F.aggregate(pairs, start, step)["found"]


def sweep(prompts: DataFrame, kinds: dict[str, tuple[str, bool, int]], verbs: tuple[str, ...] = P.SWEEP_VERBS) -> DataFrame:
    """query_id, kind, value, score, code, verb: signals of each prompt by a log-saturated count, more in code and near an imperative verb.

    kinds: by name a pattern, whether its values are free (then a lone mention without code or verb is left out; else values
    are taken in lower case), and the most to keep. Code is what stands in fences or backticks; near is SWEEP_TOKENS times
    five characters to either side of any mention.
    """
    width = P.SWEEP_TOKENS * 5
    rows = prompts.select("query_id", "prompt", located(F.col("prompt"), P.CODE_PATTERN).alias("fences"))
    parts = [rows.select("*", F.lit(k).alias("kind"), F.lit(free).alias("free"), F.lit(most).alias("most"), F.explode(located(F.col("prompt") if free else F.lower("prompt"), p)).alias("f")) for k, (p, free, most) in kinds.items()]
    each = reduce(DataFrame.unionByName, parts).select("*", "f.value", "f.at")
    inside = F.exists("fences", lambda r: (r["at"] <= F.col("at")) & (F.col("at") < r["at"] + F.length(r["value"])))
    begin = F.greatest(F.lit(0), F.col("at") - width)
    around = F.lower(F.substr("prompt", begin + 1, F.col("at") + width - begin))
    flagged = each.select("query_id", "kind", "free", "most", "value", inside.alias("code"), around.rlike(rf"\b(?:{'|'.join(verbs)})\b").alias("verb"))
    n = flagged.groupBy("query_id", "kind", "free", "most", "value").agg(F.count("*").alias("n"), F.max("code").alias("code"), F.max("verb").alias("verb"))
    score = F.least(F.lit(1.0), F.log1p("n") / F.log(F.lit(9.0))) + F.when(F.col("code"), P.SWEEP_CODE).otherwise(0.0) + F.when(F.col("verb"), P.SWEEP_VERB).otherwise(0.0)
    kept = n.withColumn("score", F.round(F.least(F.lit(1.0), score), 6)).where((F.col("score") >= P.SWEEP_FLOOR) & (~F.col("free") | F.col("code") | F.col("verb")))
    order = Window.partitionBy("query_id", "kind").orderBy(F.col("score").desc(), "value")
    return kept.withColumn("at", F.row_number().over(order)).where(F.col("at") <= F.col("most")).select("query_id", "kind", "value", "score", "code", "verb")


def item_type(content: Column, origin: Column, trigger: Column, taxonomy: Column, references: Column, hint: Column) -> Column:
    """item_type and confidence: the first of nine ordered tests that holds. references: array of struct(type, uri)."""
    files = F.transform(F.filter(references, lambda r: r["type"] == "file"), lambda r: r["uri"])
    tests, specs = F.exists(files, lambda u: u.rlike(P.TEST_FILE)), F.exists(files, lambda u: u.rlike(P.SPEC_FILE))
    code = F.exists(files, lambda u: ~u.rlike(P.TEST_FILE) & ~u.rlike(P.WIKI_FILE) & u.rlike(P.CODE_FILE))
    sure = lambda t, p: F.struct(F.lit(t).alias("item_type"), F.lit(p).alias("confidence"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(yes(origin.isin("error_log", "error_log_finalization") | (trigger == "error_recovery")) | yes(trigger == "error_recovery") | yes(taxonomy == "incident_lesson"), sure("bugfix", 0.92))
        .when(tests & content.rlike(P.BUGFIX_WORDS), sure("bugfix", 0.78)).when(tests, sure("workflow", 0.75))
        .when(content.rlike(P.RULE_HEADING) | (content.rlike(P.RULE_WORDS) & (F.length(content) < P.NORMATIVE_LENGTH)), sure("rule", 0.82))
        .when(content.rlike(P.WORKFLOW_HEADING), sure("workflow", 0.8)).when(content.rlike(P.SPEC_HEADING) | specs, sure("spec", 0.78))
        .when((T.fence_share(content) >= P.FENCE_SHARE) & code, sure("code_ref", 0.86)).when(content.rlike(P.CONVERSATION_HEADING), sure("conversation", 0.72))
        .when(yes(hint != "memory"), F.struct(hint.alias("item_type"), F.lit(0.6).alias("confidence"))).otherwise(sure("memory", 0.4))
    )


def item_type_of_path(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.endswith(".md") | low.contains("/docs/") | low.contains("/wiki/"), "wiki").when(low.contains("spec") | low.contains("requirements"), "spec").otherwise("code_ref")


def safety(c: Column) -> Column:
    """blocked, suspicious or safe."""
    met = lambda patterns: reduce(lambda a, b: a | b, [c.rlike(p) for _, p in patterns])
    return F.when(met(P.BLOCK_PATTERNS), "blocked").when(met(P.SUSPICIOUS_PATTERNS), "suspicious").otherwise("safe")


def safety_issues(c: Column) -> Column:
    """Distinct kinds of the patterns that a text meets."""
    return F.array_distinct(F.filter(F.array(*[F.when(c.rlike(p), F.lit(k)) for k, p in (*P.BLOCK_PATTERNS, *P.SUSPICIOUS_PATTERNS)]), lambda x: x.isNotNull()))


def hash_embedding(docs: DataFrame, dim: int) -> DataFrame:
    """doc_id, slot, weight: nonzero entries of the normalised hash embedding of docs (doc_id, text).

    Token counts are summed before hashing, so each distinct token of a document is hashed once.
    """
    tokens = docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9_./:-]+)"), F.lit(1))).alias("token")).groupBy("doc_id", "token").count()
    cells = tokens.select("doc_id", T.hash_index(F.col("token"), dim).alias("h"), "count").groupBy("doc_id", F.col("h.at").alias("slot")).agg(F.sum(F.col("h.sign") * F.col("count")).alias("x"))
    length = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("doc_id")))
    return cells.withColumn("weight", F.round(F.col("x") / length, 6)).where("x <> 0").select("doc_id", "slot", "weight")


def anchor_window(docs: DataFrame, pattern: str, width: int, step: int) -> DataFrame:
    """doc_id, begin_at, hits of the densest slice of every text."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("text") - 1) / step).cast("int") * step), F.lit(step))
    counted = F.transform(starts, lambda a: F.struct(F.regexp_count(F.lower(F.substr("text", a + 1, F.lit(width))), F.lit(pattern)).alias("hits"), (-a).alias("neg")))
    best = docs.select("doc_id", F.array_max(counted).alias("best"))
    return best.select("doc_id", (-F.col("best.neg")).alias("begin_at"), F.col("best.hits").alias("hits"))
