"""Lexical search in blocks of texts, and an inverted index for searches of whole words.

Search takes the best `limit` texts of each query by the number of its terms that stand in them. Each task reads its texts
once. The terms of a block of queries are one automaton, which runs once over each different word that a task meets, never
over a text. DOCS texts make a block, in which each term is a row of bits, one for each text. The counts of a chunk of
queries over all texts of a block are a few planes of such bits (plane k has bit k of the counts), added up 64 texts at a
time. The count that the last of a query's best so far has is the mark to reach: a query of which a block has fewer terms
is left out, and only texts that reach the mark are looked at one by one, never more than `limit` and a word of bits. A
task sends the best of each query only, and texts are dealt out evenly first, so one large file is not one task.

A query may be limited to one group of documents (its project) and name documents it rejects: both are left out before
the best are chosen, so its list is refilled from the rest.

The index has a row for each word of a block of DOCS documents (the places of the documents that hold it) and a row for
the block itself (ids and groups). It is written only if postings or places are asked for.
"""

from __future__ import annotations

import re
from array import array
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.shared import cut

#: Documents of a block (their places fit 16 bits), and postings after which a block is closed early.
DOCS, POSTINGS = 4096, 1 << 19
#: Pairs of a text and a term after which a block of texts is closed early, words whose terms a task remembers, queries counted at a time.
PAIRS, WORDS, CHUNK = 1 << 22, 1 << 19, 128


class Index:
    """low: item_id, lower-case text and group g; places: block, items, groups; postings: block, word, at."""

    def __init__(self, low: DataFrame):
        self.low = low

    @cached_property
    def _made(self) -> DataFrame:
        return _written(self.low)

    @property
    def places(self) -> DataFrame:
        return self._made.where("word IS NULL").select("block", "items", "groups")

    @property
    def postings(self) -> DataFrame:
        return self._made.where("word IS NOT NULL").select("block", "word", "at")


def build(corpus: DataFrame, group: str | None = None) -> Index:
    """Index of corpus (item_id, content and, if named, a column of groups)."""
    return Index(corpus.select("item_id", F.lower(F.coalesce("content", F.lit(""))).alias("low"), (F.col(group).cast("string") if group else F.lit(None).cast("string")).alias("g")))


def _written(low: DataFrame) -> DataFrame:
    """Rows of words and of blocks. Each task indexes what it reads; nothing is shuffled."""
    kind = low.schema["item_id"].dataType
    arrow = to_arrow_type(kind)

    def run(batches):
        part, number = TaskContext.get().partitionId() << 31, 0
        items, groups, held, n = [], [], {}, 0

        def rows():
            block = part + number
            words = sorted(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([None], pa.string()), pa.array([items], pa.list_(arrow)), pa.array([groups], pa.list_(pa.string())), pa.array([len(items)], pa.int32()), pa.array([None], pa.binary())],
                names=["block", "word", "items", "groups", "n", "at"],
            )
            for lo in range(0, len(words), 16384):
                some = words[lo : lo + 16384]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(some)), pa.array(some, pa.binary()).cast(pa.string()), pa.nulls(len(some), pa.list_(arrow)), pa.nulls(len(some), pa.list_(pa.string())), pa.array([len(held[w]) for w in some], pa.int32()), pa.array([held[w].tobytes() for w in some], pa.binary())],
                    names=["block", "word", "items", "groups", "n", "at"],
                )

        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                for item, text, own in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    if items and (len(items) >= DOCS or n >= POSTINGS):
                        yield from rows()
                        items, groups, held, n, number = [], [], {}, 0, number + 1
                    words = set(text.encode().split())
                    for w in words:
                        found = held.get(w)
                        if found is None:
                            found = held[w] = array("H")
                        found.append(len(items))
                    n += len(words)
                    items.append(item)
                    groups.append(own)
        if items:
            yield from rows()

    return cut(low.mapInArrow(run, f"block long, word string, items array<{kind.simpleString()}>, groups array<string>, n int, at binary"))


def best_of_block(own: list[np.ndarray], mark: int, allowed: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, counts) of the documents that at least `mark` (1 or more) of the postings own hold, rarest postings first."""
    own = sorted(own, key=len)
    m, nothing = len(own), np.zeros(0, np.int64)
    if m < mark:
        return nothing, nothing
    first = np.bincount(np.concatenate(own[: m - mark + 1]))
    at = np.flatnonzero(first)
    if allowed is not None:
        at = at[allowed[at]]
    n = first[at]
    for k, more in enumerate(own[m - mark + 1 :], m - mark + 1):
        if not len(at):
            break
        n = n + (more[np.minimum(np.searchsorted(more, at), len(more) - 1)] == at)
        can = n + (m - k - 1) >= mark
        at, n = at[can], n[can]
    return at, n


class Words(dict):
    """The numbers of the terms that a word (bytes) holds, found when first asked for."""

    def __init__(self, numbers: dict[str, int]):
        super().__init__()
        self.held = ahocorasick.Automaton()
        for t, k in numbers.items():
            self.held.add_word(t, k)
        if numbers:
            self.held.make_automaton()
        self.some = bool(numbers)

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= WORDS:
            self.clear()
        found = self[word] = tuple({k for _, k in self.held.iter(word.decode())}) if self.some else ()
        return found


def counted(bits: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """Planes of how many of its rows (one line a query) hold each place: plane k has bit k of the counts."""
    planes = []
    for j in range(rows.shape[1]):
        carry = bits[rows[:, j]]
        for plane in planes:
            both = plane & carry
            plane ^= carry
            carry = both
        if (j + 1).bit_length() > len(planes):
            planes.append(carry)
    return planes


def compared(planes: list[np.ndarray], marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the places with a count above each query's mark, and of those with just that."""
    more, same = np.zeros_like(planes[0]), np.full_like(planes[0], ~np.uint64(0))
    for p in reversed(range(len(planes))):
        one = np.where(marks >> p & 1, ~np.uint64(0), np.uint64(0))[:, None]
        more |= same & planes[p] & ~one
        same &= ~(planes[p] ^ one)
    return more, same


def first_of_block(planes: list[np.ndarray], marks: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place, count) of the places that reach the marks (1 or more); of more than `limit` the best, the first of equal ones, and at most a word of bits beyond."""
    size = lambda b: np.bitwise_count(b).sum(axis=1, dtype=np.int64)
    more, same = compared(planes, marks)
    many = np.flatnonzero(size(more) + size(same) > limit)
    if len(many):
        own, least = [p[many] for p in planes], np.zeros(len(many), np.int64)
        for p in reversed(range(len(planes))):
            can = least | 1 << p
            least = np.where(sum(map(size, compared(own, can))) >= limit, can, least)
        more[many], same[many] = compared(own, least)
    n = np.bitwise_count(same)
    same[np.cumsum(n, axis=1, dtype=np.int64) - n >= (limit - size(more))[:, None]] = 0
    found = (more | same).reshape(-1)
    at = np.flatnonzero(found)
    k, bit = np.nonzero(np.unpackbits(found[at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    word, width = at[k], more.shape[1]
    count = np.zeros(len(word), np.int64)
    for p, plane in enumerate(planes):
        count |= (plane.reshape(-1)[word] >> bit.astype(np.uint64) & np.uint64(1)).astype(np.int64) << p
    return word // width, word % width * 64 + bit, count


def search(index: Index, queries: DataFrame, limit: int) -> DataFrame:
    """query_id, item_id, n, n_terms: the best by the number of distinct terms that stand anywhere in a text, ties by item_id, for one block of queries.

    queries: query_id, terms and, as they may be, wanted (the group it is limited to) and rejected (ids). Their number is
    bounded by the caller (in_blocks), so they go to every task; each task keeps the best of its texts.
    """
    columns = [c for c in ("wanted", "rejected") if c in queries.columns]
    asked = queries.select("query_id", F.array_distinct(F.coalesce("terms", F.array().cast("array<string>"))).alias("terms"), *columns).collect()
    asked.sort(key=lambda q: len(q["terms"]))  # a chunk's queries have about as many terms
    kind, item = queries.schema["query_id"].dataType, index.low.schema["item_id"].dataType
    of = {}
    for q in asked:
        for t in q["terms"]:
            of.setdefault(t, len(of) + 1)  # 0: no term
    names, sizes = [q["query_id"] for q in asked], np.array([len(q["terms"]) for q in asked], np.int64)
    own = np.fromiter((of[t] for q in asked for t in q["terms"]), np.int32, int(sizes.sum()))
    begins = np.cumsum(sizes) - sizes
    wanted = [q["wanted"] for q in asked] if "wanted" in columns else [None] * len(asked)
    groups_of = {g: k for k, g in enumerate(dict.fromkeys(g for g in wanted if g is not None), 1)}
    wanted = np.array([groups_of.get(g, 0) for g in wanted], np.int64)  # 0: any
    out = [(i, k) for k, q in enumerate(asked) for i in q["rejected"] or ()] if "rejected" in columns else []
    out.sort()
    out_items, out_of = np.array([i for i, _ in out]), np.array([k for _, k in out], np.int64)
    spaced = {t: k for t, k in of.items() if re.search(r"[ \t\n\x0b\f\r]", t)}
    plain = {t: k for t, k in of.items() if t and t not in spaced}

    def run(batches):
        words, across = Words(plain), Words(spaced)
        best = [[] for _ in names]
        marks, last = np.ones(len(names), np.int64), [None] * len(names)
        chunks = []
        for lo in range(0, len(names), CHUNK):
            n = sizes[lo : lo + CHUNK]
            most = int(n.max())
            if most:
                at = begins[lo : lo + CHUNK, None] + np.arange(most)
                chunks.append((lo, np.where(np.arange(most) < n[:, None], own[np.minimum(at, len(own) - 1)], 0)))

        def score(items, groups, ids, held):
            if not ids:
                return
            order = sorted(range(len(items)), key=items.__getitem__)  # of equal ones the first place is the least id
            place = np.empty(len(items), np.int64)
            place[order] = np.arange(len(items))
            items = [items[k] for k in order]
            width = -(-len(items) // 64)
            ids, at = np.frombuffer(ids, np.int32), np.repeat(place, held)
            present = np.zeros(len(of) + 1, bool)
            present[ids] = True
            row = np.where(present, np.cumsum(present), 0)  # row 0: no text of the block
            bits = np.zeros((int(present.sum()) + 1, width), np.uint64)
            bit = lambda at: np.uint64(1) << (at & 63).astype(np.uint64)
            np.bitwise_or.at(bits.reshape(-1), row[ids] * width + (at >> 6), bit(at))
            inside = None
            if groups_of:
                inside = np.zeros((len(groups_of) + 1, width), np.uint64)
                inside[0] = ~np.uint64(0)
                g = np.array([groups_of.get(groups[k], 0) for k in order], np.int64)
                at = np.flatnonzero(g)
                np.bitwise_or.at(inside.reshape(-1), g[at] * width + (at >> 6), bit(at))
            out_q = out_at = np.zeros(0, np.int64)
            if len(out_of):
                mine = np.array(items)
                lo, hi = np.searchsorted(out_items, mine), np.searchsorted(out_items, mine, "right")
                out_at = np.repeat(np.arange(len(items)), hi - lo)
                out_q = out_of[np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo) + np.arange(len(out_at))]
                by = np.argsort(out_q, kind="stable")
                out_q, out_at = out_q[by], out_at[by]
            for lo, terms in chunks:
                rows = row[terms]
                mark = marks[lo : lo + len(terms)] + np.fromiter((x is not None and items[0] > x for x in last[lo : lo + len(terms)]), bool, len(terms))
                take = np.flatnonzero((rows > 0).sum(axis=1) >= mark)
                if not len(take):
                    continue
                mark = mark[take]
                planes = counted(bits, rows[take])
                a, b = np.searchsorted(out_q, [lo, lo + len(terms)])
                if inside is not None or b > a:
                    allowed = np.full((len(terms), width), ~np.uint64(0)) if inside is None else inside[wanted[lo : lo + len(terms)]]
                    np.bitwise_and.at(allowed.reshape(-1), (out_q[a:b] - lo) * width + (out_at[a:b] >> 6), ~bit(out_at[a:b]))
                    allowed = allowed[take]
                    for plane in planes:
                        plane &= allowed
                q, at, n = first_of_block(planes, mark, limit)
                ends = np.flatnonzero(np.diff(q, append=-1)) + 1
                at, n, begin = at.tolist(), (-n).tolist(), 0
                for end in ends.tolist():
                    k = lo + int(take[q[begin]])
                    kept = best[k] = sorted([*best[k], *((n[x], items[at[x]]) for x in range(begin, end))])[:limit]
                    if len(kept) == limit:
                        marks[k], last[k] = -kept[-1][0], kept[-1][1]
                    begin = end

        items, groups, ids, held = [], [], array("i"), []
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                for i, text, g in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    found = set().union(*map(words.__getitem__, set(text.split())))
                    if across.some:
                        found.update(k for _, k in across.held.iter(text.decode()))
                    ids.extend(found)
                    held.append(len(found))
                    items.append(i)
                    groups.append(g)
                    if len(items) >= DOCS or len(ids) >= PAIRS:
                        score(items, groups, ids, held)
                        items, groups, ids, held = [], [], array("i"), []
        if items:
            score(items, groups, ids, held)
        rows = [(names[k], i, -c, int(sizes[k])) for k, kept in enumerate(best) for c, i in kept]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], to_arrow_type(kind)), pa.array([r[1] for r in rows], to_arrow_type(item)), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())],
            names=["query_id", "item_id", "n", "n_terms"],
        )

    return index.low.repartition("item_id").mapInArrow(run, f"query_id {kind.simpleString()}, item_id {item.simpleString()}, n long, n_terms long")


def matching(index: Index, queries: DataFrame) -> DataFrame:
    """query_id, item_id of all documents that have every one of a query's terms (query_id, terms) as words, for one block of queries."""
    asked = queries.select("query_id", F.array_distinct("terms").alias("terms")).collect()  # bounded by the block
    kind, item = queries.schema["query_id"].dataType, index.low.schema["item_id"].dataType
    plan = [(q["query_id"], q["terms"]) for q in asked if q["terms"]]
    words = queries.select(F.explode("terms").alias("word")).distinct()
    rows = index.postings.join(words, "word").select("block", F.col("word").alias("term"), "at").withColumn("items", F.lit(None).cast(index.places.schema["items"].dataType))
    rows = rows.unionByName(index.places.select("block", F.lit(None).cast("string").alias("term"), F.lit(None).cast("binary").alias("at"), "items"))

    def run(batches):
        block, items, held = None, [], {}

        def met():
            if held:
                for query, terms in plan:
                    own = [held[t] for t in terms if t in held]
                    if len(own) == len(terms):
                        at, _ = best_of_block(own, len(own), None)
                        if len(at):
                            yield pa.RecordBatch.from_arrays([pa.array([query] * len(at), to_arrow_type(kind)), pa.array([items[p] for p in at.tolist()], to_arrow_type(item))], names=["query_id", "item_id"])

        for batch in batches:
            for b, term, at, its in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if b != block:
                    yield from met()
                    block, items, held = b, [], {}
                if term is None:
                    items = its
                else:
                    held[term] = np.frombuffer(at, np.uint16).astype(np.int64)
        yield from met()

    dealt = rows.repartition("block").sortWithinPartitions("block", F.asc_nulls_first("term")).select("block", "term", "at", "items")
    return dealt.mapInArrow(run, f"query_id {kind.simpleString()}, item_id {item.simpleString()}")
