"""Repeated byte strings by column-wise construction of collection Burrows-Wheeler transforms.

A string of LENGTH bytes holds a sampled anchor: the gram of GRAM bytes of least hash among its grams. Consecutive strings
with the same anchor form a segment of fewer than 2 * LENGTH - GRAM bytes, and equal strings always lie at the same place of
segments with the same anchor. So documents of any length become collections of short texts, dealt by anchor, and
each collection is built column by column: a round inserts one symbol of every segment, from the last to the first,
into the collection's transform; where it goes follows from the rank of the symbol inserted before. In the finished order
of suffixes, neighbours that share LENGTH bytes are one string.

Prefilter: a merged sketch of anchors (as for windows of words) leaves out segments whose anchor occurs once. Equal
segments are inserted once, and a segment alone under its anchor needs no construction, since all it shares it shares
with its own copies.

Of equal strings the first stays (smaller doc_id, then earlier start); every byte covered by a later one goes.

Defined results: a null or empty text has no byte; a text shorter than LENGTH loses nothing; rows that repeat
an id come in the order of their packs; rows without an id come last; ids are integers; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, table
from .countmin_spans import _powers, covered
from .exchange import BLOCK, CELL_BITS, MESSAGE, ROOM, asked, block_bits, by_block, message_batch, pack_bits, packs, squeeze, texts_of, unpack_bits, unsqueeze

LENGTH, GRAM = 100, 50
BASE = 0xA0761D6478BD642F
#: Segments whose columns are built together; collections of fewer are joined up to this size.
TOGETHER = 1 << 13
#: Bits by which blocks of segments, which bring their bytes, are more than blocks of anchors.
FINER = 3
#: Bytes of text in a pack: its segments are Python objects for a while.
PACK = 1 << 20
#: An anchor whose cell counts so many is hot. SINGLE marks a string of such an anchor in place of the anchor's offset.
HOT, SINGLE = 1 << 12, 65535
#: Order of rows without an id.
LAST = (1 << 63) - 1
#: Strings that are hashed at once, and bits of a packed key that hold a place among them.
STRETCH, PLACE = 1 << 18, 19


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(start, number of strings, anchor's offset from start, anchor's hash) of every segment of the texts that end at ends."""
    parts = [_anchors(data[lo : lo + STRETCH + length - 1], lo, ends, length, gram) for lo in range(0, max(0, len(data) - length + 1), STRETCH)]
    if not parts:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, np.uint64)
    start, count, place, h = (np.concatenate([p[k] for p in parts]) for k in range(4))
    new = np.ones(len(start), bool)  # a segment may go on in the next stretch
    new[1:] = (start[1:] != start[:-1] + count[:-1]) | (place[1:] != place[:-1]) | (ends.searchsorted(start[1:], "right") != ends.searchsorted(start[:-1], "right"))
    at = np.flatnonzero(new)
    return start[at], np.add.reduceat(count, at) if len(at) else count, place[at] - start[at], h[at]


def _anchors(data: np.ndarray, lo: int, ends: np.ndarray, length: int, gram: int):
    """The segments of one stretch: start, number of strings, anchor's place, anchor's hash."""
    n, wide = len(data) - gram + 1, length - gram + 1
    up, down = _powers(BASE, len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    hashes = mix((total[gram:] - total[:-gram]) * down[:n])
    key = (hashes >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(n, dtype=np.uint64)
    # The least of every `wide` neighbours: of runs cut at multiples of it, the tail of one and the head of the next.
    rows = -(-n // wide)
    padded = np.full(rows * wide, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    grid = padded.reshape(rows, wide)
    head = np.minimum.accumulate(grid, axis=1).ravel()
    tail = np.ascontiguousarray(np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1]).ravel()
    m = n - wide + 1
    place = (np.minimum(tail[:m], head[wide - 1 : wide - 1 + m]) & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    start = np.arange(m, dtype=np.int64)
    doc = ends.searchsorted(start + lo, "right")
    keep = start + lo + length <= ends[doc]
    start, place, doc = start[keep], place[keep], doc[keep]
    at = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]) if len(start) else start
    # Anchors are least hashes, so they crowd at the low end; mixed again, they spread over all blocks.
    return start[at] + lo, np.diff(np.r_[at, len(start)]), place[at] + lo, mix(hashes[place[at]] ^ np.uint64(BASE))


def pack_segments(texts: list[bytes], bits: int, length: int, gram: int):
    """(all bytes, ends of texts, start, strings, offset, cell, hash) of the segments of a pack, in order of start."""
    blob = b"".join(texts)
    ends = np.cumsum([len(t) for t in texts]) if texts else np.zeros(0, np.int64)
    start, count, offset, h = anchors(np.frombuffer(blob, np.uint8), ends, length, gram)
    return blob, ends, start, count, offset, h >> np.uint64(64 - bits - CELL_BITS), h


def construct(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, start) of all suffixes of short texts in order, empty ones too, by inserting one symbol of each text a round.

    Equal suffixes are in order of text. symbols holds, for every suffix so far, the byte before it plus one, or 0 at a text's
    start; the byte's rank among them is where the suffix that begins with it goes.
    """
    n = len(texts)
    size = np.array([len(t) for t in texts], np.int64)
    deep = int(size.max(initial=0))
    table = np.zeros((n, deep + 1), np.uint8)  # bytes plus one, right-aligned; column 0 is the start of the longest
    flat = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint8) + np.uint8(1)
    row = np.repeat(np.arange(n), size)
    table[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + deep + 1 - np.repeat(size, size)] = flat
    symbols, who, left = table[:, deep].copy(), np.arange(n, dtype=np.int32), size.astype(np.int16)
    place, alive = np.arange(n), np.arange(n)  # where the last suffix of each growing text is
    for k in range(1, deep + 1):
        growing = size[alive] >= k
        alive, place = alive[growing], place[growing]
        order = np.argsort(symbols, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        done = int(np.count_nonzero(symbols == 0))
        to = rank[place] - done + n  # all empty suffixes come first
        total = len(symbols) + len(alive)
        old = np.ones(total, bool)
        old[to] = False
        grown = np.empty(total, np.uint8), np.empty(total, np.int32), np.empty(total, np.int16)
        for g, before, new in zip(grown, (symbols, who, left), (table[alive, deep - k], alive, size[alive] - k)):
            g[old] = before
            g[to] = new
        symbols, who, left = grown
        place = to
    return who, left


def later_strings(texts: list[bytes], order: np.ndarray, length: int) -> np.ndarray:
    """For every string of `length` bytes of every text, in order of text, whether it also begins in a text that is earlier by order."""
    who, at = construct(texts)
    size = np.array([len(t) for t in texts], np.int64)
    whole = size[who] - at >= length
    who, at = who[whole], at[whole].astype(np.int64)
    begins = np.cumsum(size) - size
    data = np.frombuffer(b"".join(texts), np.uint8)
    here = begins[who] + at
    same = np.zeros(len(here), bool)
    for lo in range(1, len(here), 1 << 15):  # neighbours in order that share the whole string
        a, b = here[lo - 1 : lo - 1 + (1 << 15)], here[lo : lo + (1 << 15)]
        a = a[: len(b)]
        alike = np.ones(len(b), bool)
        for k in range(0, length, 10):
            own = np.flatnonzero(alike)
            if not len(own):
                break
            span = np.arange(k, min(k + 10, length))
            alike[own] = (data[a[own, None] + span] == data[b[own, None] + span]).all(1)
        same[lo : lo + len(b)] = alike
    group = np.cumsum(~same) - 1
    least = np.full(int(group[-1]) + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, group, order[who])
    later = order[who] > least[group]
    n = size - length + 1
    out = np.zeros(int(n.sum()), bool)
    out[(np.cumsum(n) - n)[who[later]] + at[later]] = True
    return out


def _anchor_pass(bits: int, length: int, gram: int):
    def run(batches):
        for batch in batches:
            for m, sizes, blob in zip(*(batch.column(k).to_pylist() for k in range(3))):
                *_, cells, _ = pack_segments(texts_of(sizes, blob), bits, length, gram)
                own, n = np.unique(cells, return_counts=True)
                rows = [(m, b, e - s, squeeze(own[s:e]), None, zstandard.compress(np.minimum(n[s:e], HOT).astype("<u2").tobytes(), 1)) for b, s, e in by_block(own, bits)]
                if rows:
                    yield message_batch(rows)

    return run


def _merge_counts(rows: list[dict]) -> list[bytes]:
    """One block of the sketch of anchors: replies which cells reach two, then which reach HOT."""
    sketch = np.zeros(BLOCK * ROOM, np.uint16)  # counts stop at HOT
    cells = [unsqueeze(r["cells"], r["n"]) for r in rows]
    for r, c in zip(rows, cells):
        sketch[c] = np.minimum(sketch[c] + np.frombuffer(zstandard.decompress(r["more"], max_output_size=2 * r["n"]), "<u2"), HOT)
    return [pack_bits(np.concatenate([sketch[c] > 1, sketch[c] >= HOT])) for c in cells]


class _Segments:
    """The segments of a pack whose anchor repeats, and those of them that are sent: the first of equal ones, by block and place.

    Segments of a hot anchor are cut into their strings, each keyed by its own hash and sent as a digest: however many
    different texts surround a common anchor, they spread over all blocks.
    """

    def __init__(self, ids: list, texts: list[bytes], replies, bits: int, length: int, gram: int):
        self.blob, self.ends, start, count, offset, cells, key = pack_segments(texts, bits, length, gram)
        own, at = np.unique(cells, return_inverse=True)
        sizes = [e - s for _, s, e in by_block(own, bits)]
        flags = [unpack_bits(r["bits"], 2 * n) for r, n in zip(replies or [], sizes, strict=True)]
        empty = np.zeros(0, bool)
        twice, hot = (np.concatenate([f[: len(f) // 2] if k == 0 else f[len(f) // 2 :] for f in flags] or [empty]) for k in (0, 1))
        plain, split = np.flatnonzero(twice[at] & ~hot[at]), np.flatnonzero(hot[at])
        n = count[split]
        single = np.repeat(start[split], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(self.blob[s : s + length]) for s in single.tolist()), np.uint64).reshape(-1, 2)
        self.start = np.concatenate([start[plain], single])
        self.count = np.concatenate([count[plain], np.ones(len(single), np.int64)])
        self.offset = np.concatenate([offset[plain], np.full(len(single), SINGLE)])
        self.key = np.concatenate([key[plain], digest[:, 0].astype(np.uint64)])
        self.block = (self.key >> np.uint64(64 - bits - FINER)).astype(np.int64)
        order = np.lexsort((self.start, self.block))
        self.start, self.count, self.offset, self.key, self.block = (x[order] for x in (self.start, self.count, self.offset, self.key, self.block))
        first: dict[tuple[int, bytes], int] = {}
        self.of, sent = np.zeros(len(order), np.int64), []  # the sent segment that stands for each
        for k, (s, c, o) in enumerate(zip(self.start.tolist(), self.count.tolist(), self.offset.tolist())):
            self.of[k] = j = first.setdefault((o, self.blob[s : s + c + length - 1]), len(sent))
            if j == len(sent):
                sent.append(k)
        self.sent = np.array(sent, np.int64)
        ids = np.array([LAST if i is None else i for i in ids], np.int64)
        self.doc = ids[self.ends.searchsorted(self.start[self.sent], "right")] if len(sent) else ids[:0]

    def runs(self):
        """(block, from, to) among the sent."""
        block = self.block[self.sent]
        at = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, np.int64)
        return [(int(block[s]), int(s), int(e)) for s, e in zip(at, np.r_[at[1:], len(block)])]

    def text(self, k: int, length: int) -> bytes:
        data = self.blob[self.start[k] : self.start[k] + self.count[k] + length - 1]
        return xxhash.xxh3_128_digest(data) if self.offset[k] == SINGLE else data


def _planes(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unplanes(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data, max_output_size=8 * n), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def _segment_pass(bits: int, length: int, gram: int):
    def run(batches):
        for batch in batches:
            for m, ids, sizes, blob, replies in zip(*(batch.column(k).to_pylist() for k in range(5))):
                own = _Segments(ids, texts_of(sizes, blob), replies, bits, length, gram)
                rows = []
                for b, s, e in own.runs():
                    mine = own.sent[s:e]
                    head = own.key[mine].tobytes() + own.count[mine].astype("<u2").tobytes() + own.offset[mine].astype("<u2").tobytes()
                    rows.append((m, b, e - s, zstandard.compress(head, 1), _planes(own.doc[s:e]), zstandard.compress(b"".join(own.text(k, length) for k in mine.tolist()), 3)))
                if rows:
                    yield message_batch(rows)

    return run


def _resolve(length: int):
    """Answers a block: for every sent segment, which of its strings begin earlier elsewhere."""

    def answer(rows: list[dict]) -> list[bytes]:
        keys, counts, offsets, docs, texts = [], [], [], [], []
        for r in rows:  # in order of pack, and within it of place
            docs.append(_unplanes(r["twice"], r["n"]))
            n = r["n"]
            head = zstandard.decompress(r["cells"], max_output_size=12 * n)
            keys.append(np.frombuffer(head[: 8 * n], np.uint64))
            counts.append(np.frombuffer(head[8 * n : 10 * n], "<u2").astype(np.int64))
            offsets.append(np.frombuffer(head[10 * n :], "<u2"))
            size = np.where(offsets[-1] == SINGLE, 16, counts[-1] + length - 1)
            data, ends = zstandard.decompress(r["more"], max_output_size=int(size.sum())), np.cumsum(size).tolist()
            texts += [data[e - s : e] for e, s in zip(ends, size.tolist())]
        key, count, offset = np.concatenate(keys), np.concatenate(counts), np.concatenate(offsets)
        order = np.argsort(np.concatenate(docs), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        first: dict[tuple[int, bytes], int] = {}
        copy, places = np.empty(len(texts), np.int64), offset.tolist()
        for k in order.tolist():
            copy[k] = first.setdefault((places[k], texts[k]), k)
        del first
        flags = np.repeat(copy != np.arange(len(copy)), count)  # copies of an earlier segment lose all
        at = np.cumsum(count) - count
        alone = np.flatnonzero((copy == np.arange(len(copy))) & (offset != SINGLE))
        _, group, n = np.unique(key[alone], return_inverse=True, return_counts=True)
        mixed = alone[n[group] > 1]
        mixed = mixed[np.argsort(key[mixed], kind="stable")]
        edges = np.append(np.flatnonzero(np.r_[True, key[mixed][1:] != key[mixed][:-1]]), len(mixed)) if len(mixed) else np.zeros(1, np.int64)
        lo = 0
        while lo < len(mixed):  # as many whole anchors as fit, one at least
            hi = int(edges[max(np.searchsorted(edges, lo + TOGETHER, "right") - 1, np.searchsorted(edges, lo, "right"))])
            own = mixed[lo:hi]
            n = count[own]
            flags[np.repeat(at[own], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)] = later_strings([texts[k] for k in own.tolist()], rank[own], length)
            lo = hi
        stops = np.cumsum([int(c.sum()) for c in counts]).tolist()
        return [zstandard.compress(pack_bits(flags[e - int(c.sum()) : e]), 1) for c, e in zip(counts, stops)]

    return answer


def _last_pass(bits: int, length: int, gram: int, kind: pa.DataType, spans: bool):
    def run(batches):
        for batch in batches:
            for ids, sizes, blob, replies, found in zip(*(batch.column(k).to_pylist() for k in range(5))):
                own = _Segments(ids, texts_of(sizes, blob), replies, bits, length, gram)
                data, ends, gone = own.blob, own.ends, np.zeros(0, np.int64)
                if len(own.sent):
                    flags = []
                    for r, (_, s, e) in zip(found, own.runs(), strict=True):
                        n = int(own.count[own.sent[s:e]].sum())
                        flags.append(unpack_bits(zstandard.decompress(r["bits"], max_output_size=n // 8 + 1), n))
                    flags, n = np.concatenate(flags), own.count
                    at = np.cumsum(n[own.sent]) - n[own.sent]
                    copies = np.ones(len(n), bool)
                    copies[own.sent] = False
                    ramp = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    gone = (np.repeat(own.start, n) + ramp)[np.repeat(copies, n) | flags[np.repeat(at[own.of], n) + ramp]]
                lost = covered(gone, length, len(data))
                out = ([], [], [], [], [])
                for n, e in zip(sizes, ends.tolist()):
                    own = lost[e - n : e]
                    edge = np.diff(np.r_[0, own.astype(np.int8), 0]) if own.any() else np.zeros(0, np.int8)
                    runs = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))
                    text = data[e - n : e]
                    left, done = [], 0
                    for a, b in runs:
                        left.append(text[done:a])
                        done = b
                    left.append(text[done:])
                    for to, v in zip(out, (n, int(own.sum()), len(runs), hashlib.sha256(b"".join(left)).hexdigest(), [list(r) for r in runs] if spans else None)):
                        to.append(v)
                cols = [pa.array(ids, kind), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string())]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if spans:
                    cols.append(pa.array(out[4], pa.list_(pa.list_(pa.int64()))))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, spans: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, spans (from and to byte of each removed run) of every row."""
    from pyspark.sql.pandas.types import to_arrow_type

    packed = packs(docs, PACK)
    units = packed.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    bits = block_bits(2 * units // (length - gram + 2))
    sketched = asked(packed.select("m", "sizes", "blob").mapInArrow(_anchor_pass(bits, length, gram), MESSAGE), _merge_counts)
    found = asked(packed.join(sketched, "m", "left").select("m", "ids", "sizes", "blob", "replies").mapInArrow(_segment_pass(bits, length, gram), MESSAGE), _resolve(length))
    both = packed.join(sketched, "m", "left").join(found.withColumnRenamed("replies", "found"), "m", "left").select("ids", "sizes", "blob", "replies", "found")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", spans array<array<bigint>>" if spans else "")
    return both.mapInArrow(_last_pass(bits, length, gram, to_arrow_type(docs.schema["doc_id"].dataType), spans), schema)


def op10_column_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents"), spans=False)


SQL = None  # too slow in SQL over whole tables; tests hold it against all strings of a small table
