"""Repeated word windows by a count-min prefilter.

First pass: every pack of documents counts its windows in a sketch (a hash gives the cell, a count saturates at two);
the sketches of all packs are merged cell by cell. A merged count is never below the true one, so a window whose cell
stays at one is unique. Second pass: only windows in cells of two or more are grouped, by a 128-bit digest of their words: two
independent 64-bit rolling hashes over the two halves of the words' 128-bit hashes. A window that occurs twice is never missed.

The sketch has one row of ROOM cells for each window, dealt in blocks: about one unique window in sixteen passes it in
vain. It grows with the input and is never whole in one place.

Defined results: a null or empty text has no word (the digest is that of no bytes); a text shorter than a window loses
nothing; equal texts of a window's length or more, and rows that repeat an id, lose all that they share; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, table
from .exchange import CELL_BITS, MESSAGE, asked, block_bits, by_block, merge_sketches, message_batch, pack_bits, packs, replied, squeeze, texts_of, unpack_bits

WINDOW = 35
#: Odd multipliers of the two rolling hashes, and how many words' hashes a worker remembers.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
KNOWN = 400_000


class _Words(dict):
    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= KNOWN:
            self.clear()
        h = self[word] = xxhash.xxh3_128_digest(word)
        return h


_WORDS = _Words()
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = 1 << (n - 1).bit_length()
        make = lambda x: np.cumprod(np.r_[np.uint64(1), np.full(size - 1, x, np.uint64)], dtype=np.uint64)
        _POWERS[base] = make(base), make(pow(base, -1, 1 << 64))
    return _POWERS[base][0][:n], _POWERS[base][1][:n]


def window_hashes(hashes: np.ndarray, window: int, base: int) -> np.ndarray:
    """A rolling hash of every run of `window` words."""
    up, down = _powers(base, len(hashes))
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up, out=total[1:])
    return mix((total[window:] - total[:-window]) * down[: len(hashes) - window + 1])


def pack_windows(texts: list[bytes], window: int, bits: int):
    """(words of each text, word at which each window starts, global cells, digests: first and second hashes in two columns)."""
    words = [t.split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    total = int(counts.sum())
    if total < window:
        return words, np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros((0, 2), np.uint64)
    known = _WORDS.__getitem__
    hashes = np.frombuffer(b"".join([known(x) for w in words for x in w]), np.uint64).reshape(-1, 2)
    ends = np.repeat(np.cumsum(counts), counts)
    starts = np.flatnonzero(np.arange(total) + window <= ends)
    digests = np.stack([window_hashes(np.ascontiguousarray(hashes[:, k]), window, b)[starts] for k, b in enumerate(BASES)], 1)
    return words, starts, digests[:, 0] >> np.uint64(64 - bits - CELL_BITS), digests


def _runs(cells: np.ndarray, digests: np.ndarray):
    """Order of windows by digest, whose first bits are the cell, and which begin a new digest there."""
    order = np.lexsort((digests[:, 1], digests[:, 0]))
    c, d = cells[order], digests[order]
    return order, c, d, np.r_[True, (d[1:] != d[:-1]).any(1)] if len(c) else np.zeros(0, bool)


def _first_pass(window: int, bits: int):
    def run(batches):
        for batch in batches:
            for m, sizes, blob in zip(*(batch.column(k).to_pylist() for k in range(3))):
                _, _, cells, _ = pack_windows(texts_of(sizes, blob), window, bits)
                own, n = np.unique(cells, return_counts=True)
                rows = [(m, b, e - s, squeeze(own[s:e]), pack_bits(n[s:e] > 1), None) for b, s, e in by_block(own, bits)]
                if rows:
                    yield message_batch(rows)

    return run


def _suspects(cells: np.ndarray, replies, bits: int) -> np.ndarray:
    """Which windows lie in cells whose merged count reached two."""
    own, at = np.unique(cells, return_inverse=True)
    return replied(replies or [], [e - s for _, s, e in by_block(own, bits)])[at] if len(own) else np.zeros(0, bool)


def _second_pass(window: int, bits: int):
    def run(batches):
        for batch in batches:
            for m, sizes, blob, replies in zip(*(batch.column(k).to_pylist() for k in range(4))):
                _, _, cells, second = pack_windows(texts_of(sizes, blob), window, bits)
                keep = _suspects(cells, replies, bits)
                _, c, s, new = _runs(cells[keep], second[keep])
                at = np.flatnonzero(new)
                n = np.diff(np.r_[at, len(c)])
                c, s = c[at], s[at]
                rows = [(m, b, e - f, None, pack_bits(n[f:e] > 1), s[f:e].tobytes()) for b, f, e in by_block(c, bits)]
                if rows:
                    yield message_batch(rows)

    return run


def _exact(rows: list[dict]) -> list[bytes]:
    """Replies which windows, by digest, occur in two messages or twice in one."""
    digests = np.concatenate([np.frombuffer(r["more"], np.uint64).reshape(-1, 2) for r in rows])
    twice = np.concatenate([unpack_bits(r["twice"], r["n"]) for r in rows])
    order, _, _, new = _runs(digests[:, 0], digests)
    group = np.cumsum(new) - 1
    n = np.bincount(group, weights=1 + twice[order])
    flags = np.zeros(len(digests), bool)
    flags[order] = n[group] > 1
    ends = np.cumsum([r["n"] for r in rows])
    return [pack_bits(flags[e - r["n"] : e]) for r, e in zip(rows, ends)]


def covered(starts: np.ndarray, window: int, total: int) -> np.ndarray:
    """Which of `total` places lie in a window that begins at one of starts."""
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge)[:total] > 0


def _last_pass(window: int, bits: int, kind: pa.DataType, spans: bool):
    def run(batches):
        for batch in batches:
            for ids, sizes, blob, replies, exact in zip(*(batch.column(k).to_pylist() for k in range(5))):
                words, starts, cells, second = pack_windows(texts_of(sizes, blob), window, bits)
                keep = np.flatnonzero(_suspects(cells, replies, bits))
                order, c, _, new = _runs(cells[keep], second[keep])
                repeated = np.zeros(0, bool)
                if len(c):
                    flags = replied(exact or [], [e - f for _, f, e in by_block(c[new], bits)])
                    repeated = np.zeros(len(c), bool)
                    repeated[order] = flags[np.cumsum(new) - 1]
                gone = covered(starts[keep[repeated]] if len(c) else np.zeros(0, np.int64), window, sum(map(len, words)))
                out, at = ([], [], [], []), 0
                for w in words:
                    mine = gone[at : at + len(w)]
                    at += len(w)
                    n = int(mine.sum())
                    left = w if not n else [x for x, g in zip(w, mine.tolist()) if not g]
                    for to, v in zip(out, (len(w), n, hashlib.sha256(b" ".join(left)).hexdigest(), _spans(mine) if spans else None)):
                        to.append(v)
                cols = [pa.array(ids, kind), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if spans:
                    cols.append(pa.array(out[3], pa.list_(pa.list_(pa.int64()))))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _spans(gone: np.ndarray) -> list[list[int]]:
    edge = np.diff(np.r_[0, gone.astype(np.int8), 0])
    return [list(x) for x in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())]


def repeated_spans(docs: DataFrame, window: int = WINDOW, spans: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if wanted, spans (from and to word of each removed run) of every row."""
    from pyspark.sql.pandas.types import to_arrow_type

    packed = packs(docs)
    units = packed.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    bits = block_bits(units // 6)  # a word is some six bytes
    rows = packed.select("m", "sizes", "blob")
    sketched = asked(rows.mapInArrow(_first_pass(window, bits), MESSAGE), merge_sketches)
    exact = asked(rows.join(sketched, "m", "left").select("m", "sizes", "blob", "replies").mapInArrow(_second_pass(window, bits), MESSAGE), _exact)
    both = packed.join(sketched, "m", "left").join(exact.withColumnRenamed("replies", "exact"), "m", "left").select("ids", "sizes", "blob", "replies", "exact")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string" + (", spans array<array<bigint>>" if spans else "")
    return both.mapInArrow(_last_pass(window, bits, to_arrow_type(docs.schema["doc_id"].dataType), spans), schema)


def op7_countmin_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"), spans=False)


SQL = None  # too slow in SQL over whole tables; tests hold it against all windows of a small table
