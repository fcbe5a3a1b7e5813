"""Packs of documents and the messages they exchange with blocks of keys.

Several operators must know of every short unit of text (a window, a segment) whether it occurs elsewhere. A row for each
unit would be many times the input, so documents are packed, some megabytes of text to a row, and a pack sends each block
of the key space one message with all its keys there, sorted, each key once. What a block finds out goes back as one reply
for each message. Equal keys of a pack are merged before they are sent, so a key that a third of all documents hold
reaches its block once for each pack.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Bytes of text in a pack; a longer document is a pack of its own.
PACK = 4 << 20
#: Units a block is made for, and how many times as many cells its row of the sketch has.
BLOCK, ROOM = 1 << 21, 16


def packs(docs: DataFrame, size: int = PACK) -> DataFrame:
    """m, ids, sizes, blob of packs of docs (doc_id, text), cut. m is unique; within a pack documents are in order of doc_id, null last."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("data"))
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        ids, texts, held = [], [], 0
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and held + len(x) > size:
                    yield flush(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(i)
                texts.append(x)
                held += len(x) + 64
        if ids:
            yield flush(ids, texts)

    def flush(ids, texts):
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] if ids[k] is not None else 0))
        ids, texts = [ids[k] for k in order], [texts[k] for k in order]
        blob = zstandard.compress(b"".join(texts), 3)
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(arrow)), pa.array([[len(x) for x in texts]], pa.list_(pa.int64())), pa.array([blob], pa.binary())], names=["ids", "sizes", "blob"])

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)
    made = rows.mapInArrow(run, f"ids array<{kind.simpleString()}>, sizes array<bigint>, blob binary")
    return cut(made.select(F.monotonically_increasing_id().alias("m"), "*"))


def texts_of(sizes: list[int], blob: bytes) -> list[bytes]:
    data = zstandard.decompress(blob, max_output_size=max(1, sum(sizes)))
    ends = np.cumsum(np.array(sizes, np.int64)).tolist() if sizes else []
    return [data[e - n : e] for n, e in zip(sizes, ends)]


def block_bits(units: int) -> int:
    """Bits of the key that number its block: blocks grow in number with the units, not in size."""
    return max(0, math.ceil(math.log2(max(1, units) / BLOCK)))


CELL_BITS = (BLOCK * ROOM).bit_length() - 1


def by_block(cells: np.ndarray, bits: int):
    """(block, from, to) of the runs of sorted global cells."""
    block = (cells >> np.uint64(CELL_BITS)).astype(np.int64)
    edges = np.searchsorted(block, np.arange((1 << bits) + 1)) if bits < 8 else None
    if edges is None:
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, np.int64)
        for s, e in zip(starts, np.r_[starts[1:], len(block)]):
            yield int(block[s]), int(s), int(e)
        return
    for b in range(1 << bits):
        if edges[b + 1] > edges[b]:
            yield b, int(edges[b]), int(edges[b + 1])


def squeeze(values: np.ndarray) -> bytes:
    """Sorted cells of one block, as the byte planes of their differences."""
    low = (values & np.uint64((1 << CELL_BITS) - 1)).astype(np.uint32)
    step = np.diff(low, prepend=np.uint32(0)).astype("<u4")
    return zstandard.compress(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unsqueeze(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data, max_output_size=max(1, 4 * n)), np.uint8).reshape(4, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def pack_bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unpack_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


MESSAGE = "m long, b int, n int, cells binary, twice binary, more binary"
_MESSAGE = pa.schema([("m", pa.int64()), ("b", pa.int32()), ("n", pa.int32()), ("cells", pa.binary()), ("twice", pa.binary()), ("more", pa.binary())])


def message_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_MESSAGE)], schema=_MESSAGE)


def asked(messages: DataFrame, answer) -> DataFrame:
    """m, replies array<struct<b, bits>>: answer(list of messages of one block) gives the bytes of the reply to each."""

    def run(batches):
        held, block = [], None
        for batch in batches:
            for r in batch.to_pylist():
                if block is not None and r["b"] != block:
                    yield reply(held)
                    held = []
                block = r["b"]
                held.append(r)
        if held:
            yield reply(held)

    def reply(rows):
        found = answer(rows)
        return pa.RecordBatch.from_arrays([pa.array([r["m"] for r in rows], pa.int64()), pa.array([r["b"] for r in rows], pa.int32()), pa.array(found, pa.binary())], names=["m", "b", "bits"])

    answered = messages.repartition("b").sortWithinPartitions("b", "m").mapInArrow(run, "m long, b int, bits binary")
    return cut(answered.groupBy("m").agg(F.sort_array(F.collect_list(F.struct("b", "bits"))).alias("replies")))


def merge_sketches(rows: list[dict]) -> list[bytes]:
    """One block of the count-min sketch, merged from what the packs counted there: replies which cells reach two."""
    sketch = np.zeros(BLOCK * ROOM, np.uint8)
    cells = [unsqueeze(r["cells"], r["n"]) for r in rows]
    for r, c in zip(rows, cells):
        sketch[c] = np.minimum(sketch[c] + 1 + unpack_bits(r["twice"], r["n"]), 2)
    return [pack_bits(sketch[c] > 1) for c in cells]


def replied(replies: list[dict], sizes: list[int]) -> np.ndarray:
    """The flags of all blocks of a pack, in order of block."""
    return np.concatenate([unpack_bits(r["bits"], n) for r, n in zip(replies, sizes, strict=True)]) if sizes else np.zeros(0, bool)
