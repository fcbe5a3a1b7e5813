"""Drafts, recommendations, source updates, maintenance, sessions' traces and the measures of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import curation as C
from .ranking import rounded

# --- fixed values ---
#: The gates of a draft in order, and those of which a failure blocks it.
GATES = ("learning_mode", "session_outcome", "compliance", "context_fit", "negative_decisions", "noisy_feedback", "signal_confidence", "duplicates", "grounded_references", "concrete_labels", "draft_maturity", "distillation_evidence", "write_gate")
HARD_GATES = ("duplicates", "grounded_references", "signal_confidence", "distillation_evidence", "write_gate")
NEGATIVE = ("rejected", "irrelevant", "stale", "missing_context", "missing_orientation", "missing_current_handoff", "missing_verification_commands")
NOISY = ("selected_but_noisy", "too_much_adjacent_context")
CONCRETE = ("task_type", "file", "symbol", "error")
RETRIEVAL_WEIGHTS = {"hit_rate": 0.2, "stale_rejection": 0.2, "fit_status": 0.15, "classification": 0.15, "mrr": 0.15, "fit_score": 0.1, "selected_coverage": 0.05}
GAIN_WEIGHTS = {"completeness": 0.55, "sources": 0.25, "placement": 0.1, "noise": 0.1}
LAYERS = {"project": 3, "team": 2, "user": 1}
TRACE_STEPS, BORDERLINE_WORDS = 12, 7
# --- end of fixed values ---


def gates(drafts: DataFrame) -> DataFrame:
    """drafts with a column of pass, fail or unknown for each gate.

    drafts: mode, outcome, compliance, fit_status, decisions, confidences, n_duplicates, reference_kinds, label_types, summary,
    content, convention, n_steps, n_evidence, has_trigger, write_decision. Null means not known.
    """
    c = F.col
    state = lambda known, good: F.when(~known, "unknown").when(good, "pass").otherwise("fail")
    sure = lambda good: F.when(F.coalesce(good, F.lit(False)), "pass").otherwise("fail")
    found = {
        "learning_mode": state(c("mode").isNotNull(), c("mode") == "auto"), "session_outcome": state(c("outcome").isNotNull(), c("outcome") == "completed"), "compliance": state(c("compliance").isNotNull(), c("compliance") == "compliant"),
        "context_fit": state(c("fit_status").isNotNull(), c("fit_status") == "ready"), "negative_decisions": state(c("decisions").isNotNull(), ~F.exists("decisions", lambda x: x.isin(*NEGATIVE))), "noisy_feedback": state(c("decisions").isNotNull(), ~F.exists("decisions", lambda x: x.isin(*NOISY))),
        "signal_confidence": sure(c("confidences").isNull() | ~F.exists(F.coalesce("confidences", F.array().cast("array<double>")), lambda x: x < 0.6)), "duplicates": sure(c("n_duplicates") == 0), "grounded_references": sure(F.exists("reference_kinds", lambda x: x != "conversation")),
        "concrete_labels": sure(F.exists("label_types", lambda x: x.isin(*CONCRETE))), "draft_maturity": sure((F.length("summary") >= 32) & (F.length("content") >= 100)),
        "distillation_evidence": sure(~c("convention") | ((c("n_steps") > 0) & (c("n_evidence") >= 2) & c("has_trigger"))), "write_gate": sure(c("write_decision").isNull() | (c("write_decision") == "ADD")),
    }
    return drafts.withColumns({f"gate_{k}": v for k, v in found.items()})


def recommended(gated: DataFrame) -> DataFrame:
    """gated drafts with blockers, concerns, unknown, verdict, confidence and auto, whether all gates pass and so a draft may be approved unseen."""
    names = lambda status, of: F.filter(F.array(*[F.when(F.col(f"gate_{g}") == status, F.lit(g)) for g in of]), lambda x: x.isNotNull())
    soft = tuple(g for g in GATES if g not in HARD_GATES)
    rows = gated.withColumns({"blockers": names("fail", HARD_GATES), "concerns": names("fail", soft), "unknown": names("unknown", GATES)})
    blocked, n, known = F.size("blockers") > 0, F.size("concerns"), F.size("unknown") == 0
    verdict = F.when(blocked, "reject").when(n == 0, "approve").otherwise("needs_changes")
    confidence = F.when(blocked, F.when(known, "high").otherwise("medium")).when(n == 0, F.when(known, "high").otherwise("medium")).when(n <= 2, "medium").otherwise("low")
    return rows.withColumns({"verdict": verdict, "confidence": confidence, "auto": known & ~blocked & (n == 0)})


def learned(recommendations: DataFrame, mode: Column) -> DataFrame:
    """Recommendations with status: approved unseen in automatic mode if every gate passes, else pending."""
    return recommendations.withColumn("status", F.when((mode == "auto") & F.col("auto"), "approved").otherwise("pending"))


def unsafe_path(path: Column) -> Column:
    return path.startswith("/") | F.exists(F.split(path, r"[\\/]"), lambda s: s == "..")


def applied_plan(plan: DataFrame, disk: DataFrame, destructive: bool = False) -> DataFrame:
    """path, outcome, reason of a plan's changes (path, action, prior, hash) against disk (path, hash, failed).

    Additions, changes and renamings always apply; deletions archive only if destructive, else they wait for review.
    """
    j = plan.join(disk.select("path", F.col("hash").alias("_now"), "failed", F.lit(True).alias("_there")), "path", "left")
    a, there = F.col("action"), F.col("_there").isNotNull()
    unsafe = unsafe_path(F.col("path")) | ((a == "renamed") & F.coalesce(unsafe_path(F.col("prior")), F.lit(False)))
    read = a.isin("added", "changed")
    reason = F.when(unsafe, "unsafe_path").when(read & ~there, "missing_on_disk").when((a == "changed") & (F.col("_now") != F.col("hash")), "hash_mismatch").when(read & F.coalesce("failed", F.lit(False)), "ingest_failed")
    done = F.when(a == "added", "ingested").when(a == "changed", "reingested").when(a == "renamed", "repointed").when(a == "deleted", "archived" if destructive else "deferred")
    return j.where(a.isin("added", "changed", "renamed", "deleted")).select("path", F.when(reason.isNotNull(), "skipped").otherwise(done).alias("outcome"), reason.alias("reason"))


def maintenance_batch(parts: dict[str, DataFrame], risks: dict[str, str], limit: int) -> DataFrame:
    """id, kind, risk, place, truncated of the proposals of all kinds (each a table of id), in order of kind and id, the first `limit`."""
    rows = reduce(DataFrame.unionByName, [p.select(F.lit(k).alias("kind"), F.lit(risks[k]).alias("risk"), F.lit(n).alias("_k"), F.col("id").cast("string").alias("id"), F.col("id").alias("_id")) for n, (k, p) in enumerate(parts.items())])
    # Places and the total come from counts of each kind; only the rows of the page are ordered.
    total = rows.agg(F.count("*").alias("total"))
    page = rows.orderBy("_k", "_id").limit(limit)
    placed = page.withColumn("place", F.row_number().over(Window.orderBy("_k", "_id")))
    return placed.crossJoin(F.broadcast(total)).select("id", "kind", "risk", "place", (F.col("total") > limit).alias("truncated"))


def maintenance_outcomes(batch: DataFrame, approved: DataFrame | None, low_risk_only: bool, failing: Column, expired: Column) -> DataFrame:
    """id, kind, outcome of a batch: what is not approved, or not of low risk where only that applies by itself, is skipped; the rest applies, fails or has expired."""
    rows = batch
    skip = F.lit(False)
    if approved is not None:
        rows = rows.join(approved.select("id", F.lit(True).alias("_ok")), "id", "left")
        skip = F.col("_ok").isNull()
    elif low_risk_only:
        skip = F.col("risk") != "low"
    return rows.select("id", "kind", F.when(skip, "skipped").when(failing, "failed").when(expired, "expired").otherwise("applied").alias("outcome"))


def contradicts(a_files: Column, b_files: Column, a_labels: Column, b_labels: Column) -> Column:
    """Whether two texts that share a file or symbol label name different files of the same name."""
    base = lambda f: F.substring_index(f, "/", -1)
    return F.coalesce(F.arrays_overlap(a_labels, b_labels), F.lit(False)) & F.exists(a_files, lambda x: (base(x) != "") & F.exists(b_files, lambda y: (base(y) == base(x)) & (y != x)))


def novelty(draft: Column, memory: Column) -> Column:
    """Share of a draft's words of four characters or more that the memory lacks."""
    own = T.tokens(draft, 4)
    return F.when(F.size(own) > 0, F.size(F.array_except(own, T.tokens(memory, 4))) / F.size(own)).otherwise(0.0)


def borderline(claim: Column, errors: Column, files: Column, symbols: Column, tasks: Column) -> Column:
    """Whether a claim is worth a second look: few content words, or only task types as triggers."""
    return (F.size(C.content_words(claim)) <= BORDERLINE_WORDS) | ((F.size(errors) == 0) & (F.size(files) == 0) & (F.size(symbols) == 0) & (F.size(tasks) > 0))


def gate_statistics(events: DataFrame) -> DataFrame:
    """One row: counts by outcome and by the stage of rejections of gate events (stage, outcome), the accepted share and what it hints at."""
    n = lambda cond: F.count_if(cond)
    rejected = F.col("outcome") == "rejected"
    row = events.agg(
        F.count("*").alias("n"), n(F.col("outcome") == "accepted").alias("accepted"), n(F.col("outcome") == "queue_legacy_migration").alias("queued"), n(F.col("outcome") == "pending").alias("pending"),
        *[n(rejected & (F.col("stage") == s)).alias(f"rejected_{s}") for s in ("triviality", "floor", "dedup", "llm_critic")],
    )
    share = F.when(F.col("n") > 0, F.col("accepted") / F.col("n")).otherwise(0.0)
    return row.withColumn("accepted_share", F.round(share, 6)).withColumn("hint", F.when(F.col("n") == 0, None).when(share < 0.3, "too_strict").when(share > 0.8, "too_permissive").otherwise("healthy"))


def resolved_styles(conflicts: DataFrame) -> DataFrame:
    """left_id, right_id, loser, by of contradicting rules (left_id, right_id and each one's layer and workflow): a personal workflow wins over anything, then the narrower layer; equals both stay."""
    rank = lambda c: F.coalesce(*[F.when(F.col(c) == k, F.lit(v)) for k, v in LAYERS.items()], F.lit(0))
    a, b, x, y = F.col("left_workflow"), F.col("right_workflow"), rank("left_layer"), rank("right_layer")
    winner = F.when(a & b, None).when(a, "left").when(b, "right").when(x > y, "left").when(y > x, "right")
    by = F.when(a & b, None).when(a | b, "workflow").when(x != y, F.when(F.greatest(x, y) == LAYERS["project"], "project").otherwise("team"))
    return conflicts.select("left_id", "right_id", F.when(winner == "left", F.col("right_id")).when(winner == "right", F.col("left_id")).alias("loser"), by.alias("by"))


def research_trace(sessions: DataFrame, most: int = TRACE_STEPS) -> DataFrame:
    """session_id, steps, n_steps: what a session came to as kinds and texts: its last selection, changed files, verification, learning signals, feedback notes.

    sessions: session_id, decisions (array of struct(decision, reason) in order), files, commands, signals (array of struct(kind, text)), notes (array of struct(feedback, note)).
    """
    step = lambda kind, text: F.struct(kind.alias("kind"), F.substring(text, 1, 240).alias("text"))
    one = lambda cond, s: F.when(cond, F.array(s)).otherwise(F.array().cast("array<struct<kind:string,text:string>>"))
    chosen = F.element_at(F.filter("decisions", lambda x: x["decision"].isin("selected", "selected_but_noisy")), -1)
    has = F.exists("decisions", lambda x: x["decision"].isin("selected", "selected_but_noisy"))
    said = F.when(F.size(F.filter("decisions", lambda x: x["decision"].isin("selected", "selected_but_noisy"))) > 0, chosen)
    first = one(has, step(F.lit("decision"), F.when(said["reason"].isNotNull(), F.concat(F.lit("Recorded context decision "), said["decision"], F.lit(": "), said["reason"])).otherwise(F.concat(F.lit("Recorded context decision "), said["decision"], F.lit(".")))))
    changed = one(F.size("files") > 0, step(F.lit("action"), F.concat(F.lit("Changed files: "), F.array_join(F.array_distinct("files"), ", "))))
    ran = one(F.size("commands") > 0, step(F.lit("action"), F.concat(F.lit("Ran verification: "), F.array_join(F.array_distinct("commands"), "; "))))
    signals = F.transform("signals", lambda s: step(s["kind"], s["text"]))
    notes = F.transform(F.filter("notes", lambda x: x["feedback"].isNotNull()), lambda x: step(F.lit("observation"), F.concat(F.lit("Post-finish feedback "), x["feedback"], F.lit(": "), x["note"])))
    every = F.slice(F.concat(first, changed, ran, signals, notes), 1, most)
    steps = F.when(F.size(every) > 0, every).otherwise(F.array(step(F.lit("observation"), F.lit("Session finished without structured research steps."))))
    return sessions.select("session_id", steps.alias("steps")).withColumn("n_steps", F.size("steps"))


def scored_traces(traces: DataFrame, expected: DataFrame) -> DataFrame:
    """session_id, failures, passed: traces against what each should hold (session_id, includes, excludes, max_steps)."""
    j = traces.join(expected, "session_id").withColumn("_text", F.to_json("steps"))
    missing = F.size(F.filter("includes", lambda x: ~F.contains(F.col("_text"), x)))
    wrong = F.size(F.filter("excludes", lambda x: F.contains(F.col("_text"), x)))
    failures = missing + wrong + F.coalesce((F.col("n_steps") > F.col("max_steps")).cast("int"), F.lit(0))
    return j.select("session_id", failures.alias("failures"), (failures == 0).alias("passed"))


def startup_brief(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """query_id, verdict, missing: clarify if a required file (queries: query_id, required, fit_status, mismatch) is nowhere or the fit is insufficient, confirm if one is not in the worktree, plans mismatch or the fit asks for it, else proceed.

    candidates: query_id, path, source.
    """
    held = candidates.groupBy("query_id").agg(F.collect_set("path").alias("_all"), F.collect_set(F.when(F.col("source") == "worktree", F.col("path"))).alias("_tree"))
    none = F.array().cast("array<string>")
    j = queries.join(held, "query_id", "left").withColumns({"_all": F.coalesce("_all", none), "_tree": F.coalesce("_tree", none)})
    missing, outside = F.array_except("required", "_all"), F.array_except("required", "_tree")
    verdict = F.when((F.size(missing) > 0) | (F.col("fit_status") == "insufficient"), "clarify").when(F.col("mismatch") | (F.size(outside) > 0) | (F.col("fit_status") == "needs_confirmation"), "confirm").otherwise("proceed")
    return j.select("query_id", verdict.alias("verdict"), F.array_join(F.sort_array(missing), ",").alias("missing"))


def retrieval_metrics(cases: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """One row of rates over cases (query_id, expected, selected, unexpected, rejected: arrays; checks: array of booleans) and found (query_id, item_id, rank). A case counts in a rate only if it asks for it."""
    got = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id"))).alias("_l"))
    j = cases.join(got, "query_id", "left").withColumn("_ids", F.coalesce(F.transform("_l", lambda x: x["item_id"]), F.array().cast("array<bigint>"))).withColumn("_top", F.slice("_ids", 1, k))
    hit = lambda c, ids: F.size(F.array_intersect(c, ids))
    first = F.array_position(F.transform("_ids", lambda x: F.array_contains("expected", x)), F.lit(True))
    some = lambda c: F.size(c) > 0
    mean = lambda cond, v: rounded(F.avg(F.when(cond, v.cast("double"))), 4)
    return j.agg(
        mean(some("expected"), (first > 0) & (first <= k)).alias("hit_rate"), mean(some("expected"), F.when(first > 0, rounded(1 / first, 4)).otherwise(0.0)).alias("mrr"), mean(some("expected"), rounded(hit("expected", "_top") / k, 4)).alias("precision"),
        mean(some("selected"), hit("selected", "_ids") == F.size("selected")).alias("selected_coverage"), mean(some("rejected"), hit("rejected", "_ids") == 0).alias("stale_rejection"), mean(some("unexpected"), hit("unexpected", "_top") == 0).alias("avoidance"),
        mean(some("checks"), F.forall("checks", lambda x: x)).alias("classification"),
    )


def mapping_metrics(cases: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """taxon and means of precision, recall, entity recall, noise sensitivity, placement, calibration and forbidden rate, for each taxon and for all.

    cases: query_id, taxon, relevant, direct, forbidden, noise, entities (arrays), wanted_status; found: query_id, item_id, rank, section, entities, status.
    """
    got = found.groupBy("query_id").agg(
        F.collect_set("item_id").alias("_all"), F.collect_set(F.when(F.col("rank") <= k, F.col("item_id"))).alias("_top"), F.collect_set(F.when(F.col("section") == "essential", F.col("item_id"))).alias("_essential"), F.array_distinct(F.flatten(F.collect_list("entities"))).alias("_entities"), F.max("status").alias("status")
    )
    j = cases.join(got, "query_id", "left")
    both = lambda a, b: F.size(F.array_intersect(a, F.coalesce(b, F.slice(a, 1, 0))))
    part = lambda a, b, of=None: F.when(F.size(a) > 0, rounded(both(a, F.col(b)) / (F.size(a) if of is None else of), 4))
    per = j.select(
        "taxon", part("relevant", "_top", F.lit(k)).alias("precision"), part("relevant", "_all").alias("recall"), part("entities", "_entities").alias("entity_recall"), part("direct", "_essential").alias("placement"),
        F.when(F.size("noise") > 0, rounded(1 - both("noise", F.col("_top")) / F.size("noise"), 4)).alias("noise_sensitivity"), F.when(F.col("wanted_status").isNotNull(), F.coalesce((F.col("status") == F.col("wanted_status")).cast("double"), F.lit(0.0))).alias("calibration"),
        F.when(F.size("forbidden") > 0, (both("forbidden", F.col("_top")) > 0).cast("double")).alias("forbidden_rate"),
    )
    names = ("precision", "recall", "entity_recall", "placement", "noise_sensitivity", "calibration", "forbidden_rate")
    return per.cube("taxon").agg(F.count("*").alias("n"), *[rounded(F.avg(c), 4).alias(c) for c in names]).withColumn("taxon", F.coalesce("taxon", F.lit("all")))


def completeness(facts: DataFrame, sources: DataFrame, evidence: DataFrame, forbidden: DataFrame) -> DataFrame:
    """case_id, completeness, source_coverage, placement, noise, gain of facts (case_id, fact_id, weight, terms), sources (case_id, uri), evidence (case_id, item_id, text, uris, direct) and forbidden (case_id, item_id).

    A fact is covered if one text of its case holds all its terms.
    """
    texts = evidence.groupBy("case_id").agg(F.count("*").alias("n_items"))
    met = facts.join(evidence.select("case_id", F.lower("text").alias("_t")), "case_id").where(F.forall("terms", lambda x: F.contains(F.col("_t"), F.lower(x)))).select("case_id", "fact_id").distinct().withColumn("_met", F.lit(1.0))
    f = facts.join(met, ["case_id", "fact_id"], "left").groupBy("case_id").agg((F.sum(F.col("weight") * F.coalesce("_met", F.lit(0.0))) / F.sum("weight")).alias("completeness"))
    seen = evidence.select("case_id", F.explode("uris").alias("uri"), "direct").groupBy("case_id", "uri").agg(F.max("direct").alias("direct"))
    s = sources.join(seen, ["case_id", "uri"], "left").groupBy("case_id").agg(F.avg(F.col("direct").isNotNull().cast("double")).alias("source_coverage"), F.avg(F.coalesce(F.col("direct").cast("double"), F.lit(0.0))).alias("placement"))
    bad = evidence.join(forbidden, ["case_id", "item_id"], "left_semi").groupBy("case_id").agg(F.count_distinct("item_id").alias("n_bad"))
    j = facts.select("case_id").distinct().join(f, "case_id").join(s, "case_id", "left").join(texts, "case_id", "left").join(bad, "case_id", "left")
    four = lambda c: rounded(c, 4)
    rows = j.select("case_id", four(F.col("completeness")).alias("completeness"), four(F.coalesce("source_coverage", F.lit(1.0))).alias("source_coverage"), four(F.coalesce("placement", F.lit(1.0))).alias("placement"), four(F.coalesce(F.coalesce("n_bad", F.lit(0)) / F.col("n_items"), F.lit(0.0))).alias("noise"))
    w = GAIN_WEIGHTS
    gain = 100 * (F.col("completeness") * w["completeness"] + F.col("source_coverage") * w["sources"] + F.col("placement") * w["placement"] + (1 - F.least(F.lit(1.0), F.col("noise"))) * w["noise"])
    return rows.withColumn("gain", rounded(F.round(gain, 9), 2))


def composite(metrics: DataFrame) -> DataFrame:
    """score of 0 to 100 of one row of metrics: retrieval rates, tests passed and total, agent_pass, completeness, sandbox (share passed or null)."""
    retrieval = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in RETRIEVAL_WEIGHTS.items()])
    system = F.when(F.col("n_tests") > 0, F.col("n_passed") / F.col("n_tests")).otherwise(0.0) * 0.6 + F.when(F.col("agent_pass"), 0.4).otherwise(0.0)
    slice_ = F.when(F.col("sandbox").isNotNull(), 0.1).otherwise(0.0)
    score = retrieval * (0.55 - slice_ / 2) + system * 0.3 + F.col("completeness") * 0.15 + F.coalesce("sandbox", F.lit(0.0)) * slice_
    return metrics.withColumn("score", F.floor(F.round(score * 100, 9) + 0.5).cast("int"))


def quality_report(feedback: DataFrame) -> DataFrame:
    """rollup, value, n over feedback on contexts (feedback_type, project, actions, missing, adjacent): the commonest first, twelve adjacent items at most."""
    one = lambda name, c: feedback.select(F.lit(name).alias("rollup"), c.alias("v")).select("rollup", F.col("v").cast("string").alias("value"))
    rows = one("feedback", F.col("feedback_type")).unionByName(one("project", F.coalesce("project", F.lit("unknown")))).unionByName(one("action", F.explode("actions"))).unionByName(one("missing", F.explode("missing"))).unionByName(one("adjacent", F.explode("adjacent")))
    n = rows.where("value IS NOT NULL").groupBy("rollup", "value").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("rollup").orderBy(F.desc("n"), "value"))
    return n.withColumn("place", place).where((F.col("rollup") != "adjacent") | (F.col("place") <= 12))


def approved_drafts(drafts: DataFrame, decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(drafts with their new status, items made of those approved): drafts draft_id, project, title, summary, content; decided draft_id, decision."""
    j = drafts.join(decided, "draft_id", "left")
    status = F.when(F.col("decision") == "approve", "approved").when(F.col("decision") == "reject", "rejected").when(F.col("decision") == "needs_changes", "needs_changes").otherwise("pending")
    after = j.select("draft_id", status.alias("status"))
    made = j.where("decision = 'approve'").select(F.concat(F.lit("reflection://"), F.col("draft_id").cast("string")).alias("uri"), "project", F.lit("memory").alias("item_type"), "title", T.truncate(F.col("summary"), 200).alias("summary"), T.redact_secrets(F.col("content")).alias("content"), F.lit("approved").alias("status"))
    return after, made


def acted(items: DataFrame, proposals: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(item_id and status, edges to add, labels to add) after approved proposals (proposal_id, item_id, action, target, label): supersede, label, review, archive."""
    rank = F.max(F.when(F.col("action") == "archive", 2).when(F.col("action") == "review", 1).otherwise(0)).alias("_a")
    j = items.join(proposals.groupBy("item_id").agg(rank), "item_id", "left")
    status = j.select("item_id", F.when(F.col("_a") == 2, "archived").when(F.col("_a") == 1, "needs_review").otherwise(F.col("status")).alias("status"))
    edges = proposals.where("action = 'supersede'").select(F.col("item_id").alias("src"), F.col("target").alias("dst"), F.lit("supersedes").alias("kind")).distinct()
    return status, edges, proposals.where("action = 'label'").select("item_id", F.col("label").alias("value")).distinct()


def routed_styles(signals: DataFrame, seen: DataFrame) -> DataFrame:
    """signal_id, user_id, outcome, reasons: preference signals (signal_id, user_id, text) become facts of their user's scope, unless they are trivial or the user has said the same before (seen: user_id, text)."""
    known = seen.select("user_id", F.lower("text").alias("_t")).distinct().withColumn("_seen", F.lit(True))
    rows = signals.withColumn("_t", F.lower("text")).join(known, ["user_id", "_t"], "left")
    rules = C.trivial_rules(F.col("text"), F.lit(1))
    again = F.coalesce("_seen", F.lit(False))
    reasons = F.when(F.size(rules) > 0, F.array_join(rules, ";")).when(again, "dedup")
    return rows.select("signal_id", "user_id", F.when((F.size(rules) > 0) | again, "gap").otherwise("atom").alias("outcome"), F.coalesce(reasons, F.lit("")).alias("reasons"))


def replays(packs: DataFrame) -> DataFrame:
    """session_id, ids in order of rank, moved (how far reranking changed scores) of packs (session_id, candidates: array of struct(rank, item_id, fused, rerank)): what a replay keeps, without texts and debug."""
    kept = F.transform(F.array_sort("candidates"), lambda x: x["item_id"].cast("string"))
    deltas = F.aggregate("candidates", F.lit(0.0), lambda a, x: a + F.abs(x["rerank"] - x["fused"]))
    return packs.select("session_id", F.array_join(kept, ",").alias("ids"), F.round(deltas, 6).alias("moved"))


def curation_proposals(members: DataFrame, facts: DataFrame, least: int = 2) -> DataFrame:
    """root, n, ids, shared of clusters (node, root) of at least two facts (node, keys): the keys that all of a cluster share, for a convention to be drawn from."""
    n = members.groupBy("root").agg(F.count("*").alias("n"), F.min("node").alias("first")).where(F.col("n") >= least)
    each = members.join(n, "root").join(facts, "node").select("root", "n", "node", F.explode(F.array_distinct("keys")).alias("k"))
    whole = each.groupBy("root", "k", "n").agg(F.count_distinct("node").alias("m")).where("m = n").groupBy("root").agg(F.array_join(F.sort_array(F.collect_list("k")), ",").alias("shared"))
    return n.join(whole, "root", "left").select("root", "n", F.coalesce("shared", F.lit("")).alias("shared"))


def key_values(items: DataFrame, by: str, values: str, limit: int) -> DataFrame:
    """by, value, n, place: the commonest values of each area."""
    n = items.select(by, F.explode(values).alias("value")).groupBy(by, "value").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "value"))).where(F.col("place") <= limit)


def migrated(items: DataFrame, claims: DataFrame) -> DataFrame:
    """item_id, legacy of memories, bugfixes and rules not yet migrated (item_id, item_type, legacy): replaced if a claim of theirs (item_id, ok) passes the gate, else archived."""
    good = claims.where("ok").select("item_id").distinct().withColumn("_good", F.lit(True))
    old = items.where(F.col("item_type").isin("memory", "bugfix", "rule") & F.col("legacy").isNull())
    return old.join(good, "item_id", "left").select("item_id", F.when(F.col("_good"), "legacy_replaced").otherwise("legacy_archived").alias("legacy"))


def convention_hints(areas: DataFrame, scripts: DataFrame, least: int = 2) -> DataFrame:
    """hint of areas (area, n_files) of several files and of scripts (name, command) that tests, linting, builds or evaluations run through."""
    a = areas.where(F.col("n_files") >= least).select(F.concat(F.lit("Area '"), "area", F.lit("' spans "), F.col("n_files").cast("string"), F.lit(" files — consider a convention for its module boundaries.")).alias("hint"))
    s = scripts.where(F.lower("name").rlike("test|lint|build|eval")).select(F.concat(F.lit("Script '"), "name", F.lit("' (`"), "command", F.lit("`) is a recurring workflow gate.")).alias("hint"))
    return a.unionByName(s)


def continuation_signals(sessions: DataFrame, recent: int = 3, most: int = 8) -> DataFrame:
    """project, kind, value, place: signals of each project's most recent sessions (session_id, project, at, files, symbols, errors), the newest first, each once."""
    last = sessions.withColumn("_n", F.row_number().over(Window.partitionBy("project").orderBy(F.col("at").desc(), "session_id"))).where(F.col("_n") <= recent)
    parts = [last.select("project", "_n", F.lit(k).alias("kind"), F.posexplode(c).alias("_at", "value")) for k, c in (("file", "files"), ("symbol", "symbols"), ("error", "errors"))]
    first = reduce(DataFrame.unionByName, parts).groupBy("project", "kind", "value").agg(F.min(F.struct("_n", "_at")).alias("f"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("project", "kind").orderBy("f", "value"))).where(F.col("place") <= most).select("project", "kind", "value", "place")


def merged_edges(edges: DataFrame, imported: DataFrame) -> DataFrame:
    """src, dst, kind, confidence, outcome: imported edges are new or raise the confidence of those there are."""
    key = ["src", "dst", "kind"]
    new = imported.groupBy(*key).agg(F.max("confidence").alias("_c"))
    j = edges.join(new, key, "full_outer")
    outcome = F.when(F.col("confidence").isNull(), "inserted").when(F.col("_c") > F.col("confidence"), "raised").otherwise("kept")
    return j.select(*key, F.greatest("confidence", "_c").alias("confidence"), outcome.alias("outcome"))
