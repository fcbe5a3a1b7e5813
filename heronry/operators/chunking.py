"""Order-dependent text work on single documents, in batches of Arrow text: sections, chunks, greedy clusters."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut

# --- fixed values ---
CHUNK_TOKENS, TOKEN_CHARS = 480, 4
FIRST_FIT = 0.85
#: First items of an owner that a round fits among themselves, and the items of an owner that one task compares with them.
LEADERS, PART = 256, 8192
# --- end of fixed values ---


def chunks(text: str, most: int = CHUNK_TOKENS) -> list[str]:
    """Paragraphs packed in order while they fit; a paragraph that is too long is packed by sentences."""
    size = lambda x: max(1, -(-len(x) // TOKEN_CHARS))
    out: list[str] = []

    def pack(parts: list[str], glue: str) -> None:
        held = ""
        for part in parts:
            joined = f"{held}{glue}{part}" if held else part
            if held and size(joined) > most:
                out.append(held)
                held = part
            else:
                held = joined
        if held:
            out.append(held)

    run: list[str] = []
    for paragraph in filter(None, map(str.strip, re.split(r"\n{2,}", text))):
        if size(paragraph) <= most:
            run.append(paragraph)
            continue
        pack(run, "\n\n")
        run = []
        pack(re.split(r"(?<=[.!?])\s+", paragraph), " ")
    pack(run, "\n\n")
    return out


def chunk_split(docs: DataFrame, most: int = CHUNK_TOKENS) -> DataFrame:
    """doc_id, chunk_index, content, n_tokens of docs (doc_id, text). A text without a word has no chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, c) for i, t in zip(b["doc_id"], b["text"]) for k, c in enumerate(chunks(t or "", most))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "content"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, chunk_index int, content string")
    return found.withColumn("n_tokens", F.greatest(F.lit(1), F.ceil(F.length("content") / TOKEN_CHARS)).cast("long"))


def sections(text: str) -> list[tuple[str, str, str]]:
    """(slug, path, content) of every headed section of Markdown; headings in code fences do not count, equal slugs are numbered."""
    out: list[tuple[str, str, list[str]]] = []
    stack: list[tuple[int, str]] = []
    seen: dict[str, int] = {}
    fenced = False
    for line in text.split("\n"):
        if re.match(r"\s{0,3}(```|~~~)", line):
            fenced = not fenced
        head = None if fenced else re.match(r"(#{1,6})\s+(.*\S)", line)
        if head:
            level, title = len(head[1]), head[2].strip("# ")
            stack = [*[s for s in stack if s[0] < level], (level, title)]
            slug = re.sub(r"[^a-z0-9]+", "-", title.lower()).strip("-") or "section"
            seen[slug] = seen.get(slug, 0) + 1
            out.append((slug if seen[slug] == 1 else f"{slug}-{seen[slug]}", " > ".join(t for _, t in stack), []))
        elif out:
            out[-1][2].append(line)
    return [(s, p, "\n".join(c).strip()) for s, p, c in out]


def markdown_sections(docs: DataFrame) -> DataFrame:
    """doc_id, slug, path, content of the sections of docs (doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *s) for i, t in zip(b["doc_id"], b["text"]) for s in sections(t or "")]
            yield pd.DataFrame(rows, columns=["doc_id", "slug", "path", "content"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, slug string, path string, content string")


def _fit(ids: list, vectors: list, firsts: np.ndarray | None, names: list, least: float, found: bool) -> list:
    """The name of the first of firsts near to each vector, or None. With found, a vector near to none becomes one of them."""
    rows = [] if firsts is None else list(firsts)
    held = np.array(rows)
    out = []
    for i, v in zip(ids, vectors):
        x = _unit(v)
        near = np.flatnonzero((held * x).sum(axis=1) >= least) if len(held) else []
        if not len(near) and found:
            rows.append(x)
            held, names = np.array(rows), [*names, i]
            out.append(i)
        else:
            out.append(names[near[0]] if len(near) else None)
    return out


def _unit(v) -> np.ndarray:
    x = np.asarray(v, float)
    n = np.linalg.norm(x)
    return x / n if n else x


def first_fit(rows: DataFrame, least: float = FIRST_FIT) -> DataFrame:
    """owner, item_id, cluster: each owner's items (item_id, vector) in order join the first cluster whose first member is near enough.

    A round takes the LEADERS first items that each owner has left and fits them among themselves. Each of the other items
    joins the first of the round's new first members it is near to, in parts of about PART items; those near to none are
    left for the next round. So a task holds LEADERS and a part of an owner's items, however many the owner has.
    """
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("owner", "item_id")}
    left = cut(rows.select("owner", "item_id", "vector").withColumn("_row", F.monotonically_increasing_id()))
    shape = f"owner {kinds['owner']}, item_id {kinds['item_id']}, cluster {kinds['item_id']}, _row long, _first boolean"
    order = Window.partitionBy("owner").orderBy(F.col("item_id").asc_nulls_last(), "_row")

    def lead(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("_at")
        # Places stand for items, as ids may repeat.
        at = _fit(list(range(len(own))), list(own["vector"]), None, [], least, True)
        ids = own["item_id"].tolist()
        return pd.DataFrame({"owner": own["owner"].tolist(), "item_id": ids, "cluster": [ids[k] for k in at], "_row": own["_row"].tolist(), "_first": [k == n for n, k in enumerate(at)]})

    def follow(firsts: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        firsts = firsts.sort_values("_at")
        names = firsts["item_id"].tolist()
        at = _fit(own["item_id"].tolist(), list(own["vector"]), np.array([_unit(v) for v in firsts["vector"]]), list(range(len(names))), least, False)
        return pd.DataFrame({"owner": own["owner"].tolist(), "item_id": own["item_id"].tolist(), "cluster": [None if k is None else names[k] for k in at], "_row": own["_row"].tolist(), "_first": [k is None for k in at]})

    done = []
    while not left.isEmpty():
        first = cut(left.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= LEADERS))
        fitted = cut(first.groupBy("owner").applyInPandas(lead, shape))
        done.append(fitted.select("owner", "item_id", "cluster"))
        rest = left.join(first.select("_row"), "_row", "left_anti")
        counts = rest.groupBy("owner").agg(F.count("*").alias("n"))
        # Owners with more than a part are few: a PART-th of the items at most.
        large = cut(counts.where(F.col("n") > PART).select(F.col("owner").alias("_big"), F.ceil(F.col("n") / PART).cast("int").alias("_parts")))
        parted = lambda df: df.join(F.broadcast(large), F.col("owner").eqNullSafe(F.col("_big")), "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))  # noqa: B023, E731
        firsts = first.join(fitted.where("_first").select("_row"), "_row", "left_semi")
        firsts = parted(firsts).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).select("owner", "_part", "item_id", "vector", "_at")
        own = parted(rest).select("owner", F.pmod(F.xxhash64("_row"), F.col("_parts")).cast("int").alias("_part"), "item_id", "vector", "_row")
        met = cut(firsts.groupBy("owner", "_part").cogroup(own.groupBy("owner", "_part")).applyInPandas(follow, shape))
        done.append(met.where("NOT _first").select("owner", "item_id", "cluster"))
        left = cut(left.join(met.where("_first").select("_row"), "_row", "left_semi"))
    return reduce(DataFrame.unionByName, done) if done else rows.select("owner", "item_id", F.col("item_id").alias("cluster"))
