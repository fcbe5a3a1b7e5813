"""Vector search by an inverted index of cells with residual codes, re-ranked by exact cosine.

Unit vectors are dealt to the nearest of up to CELLS centroids. A vector is kept as one byte a component: what is left of
it after its cell's centroid, in steps of its pack's greatest residual. Packs are rows of one cell that one task read, so
building the index shuffles nothing and a large cell is many packs. A query reads the packs of its `probes` nearest
cells, scores them by codes, and only its best `rerank` candidates over all packs are compared exactly.

Bounds: centroids are fitted to a sample of at most SAMPLE_BYTES of vectors, chosen by a hash of the id; every vector is
indexed. How many cells a query probes is fitted too: TRIALS vectors of the sample are held against all of the sample, and
the least number of cells that finds `recall` of their nearest (with a margin) is taken. Vectors without any structure
therefore probe many cells, and what the index then saves is the exact comparisons: a query makes `rerank` of them.
`exact=True` in search() takes the exact way, which compares a query with every vector.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .. import policy as P
from ..functions import vectors as V
from ..sources.shared import cut
from . import search as S

#: Most cells, bytes of vectors that centroids are fitted to, rounds of fitting, queries that the probes are fitted to.
CELLS, SAMPLE_BYTES, ROUNDS, TRIALS = 4096, 64 << 20, 8, 64
#: Vectors that a task holds before it writes packs; candidates that are compared exactly, as a multiple of the limit.
FLUSH, RERANK = 1 << 17, 6


@dataclass
class Index:
    """packs: cell, ids, step, codes. probes: cells that a query reads. read: share of the corpus that this was, on the trials."""

    corpus: DataFrame
    packs: DataFrame
    centroids: np.ndarray
    probes: int
    read: float


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=-1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), -1)


def fit_centroids(sample: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k unit centroids of unit vectors, begun at evenly spread rows; an empty cell keeps its centroid."""
    c = sample[np.linspace(0, len(sample) - 1, k).astype(np.int64)].copy()
    for _ in range(rounds):
        owner = np.concatenate([(sample[lo : lo + 8192] @ c.T).argmax(1) for lo in range(0, len(sample), 8192)])
        sums, n = np.zeros_like(c), np.bincount(owner, minlength=k)
        np.add.at(sums, owner, sample)
        c[n > 0] = _unit(sums[n > 0])
    return c


def fit_probes(sample: np.ndarray, c: np.ndarray, limit: int, recall: float) -> tuple[int, float]:
    """(cells to probe, share of the sample in them) so that trials find this share of their nearest `limit` in the sample."""
    owner = np.concatenate([(sample[lo : lo + 8192] @ c.T).argmax(1) for lo in range(0, len(sample), 8192)])
    trials = sample[np.linspace(0, len(sample) - 1, min(TRIALS, len(sample))).astype(np.int64)]
    size = min(limit, len(sample))
    near = np.argpartition(-(trials @ sample.T), size - 1, axis=1)[:, :size]
    order = np.argsort(-(trials @ c.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(c))[None, :], 1)  # when a trial's walk reaches each cell
    at = np.sort(np.take_along_axis(place, owner[near], 1).ravel())
    probes = int(at[min(len(at) - 1, int(np.ceil(recall * len(at))) - 1)]) + 1
    held = np.bincount(owner, minlength=len(c))[order][:, :probes].sum(1).mean()
    return probes, float(held / len(sample))


def build(corpus: DataFrame, cells: int | None = None, recall: float = 0.95, limit: int = P.SEARCH_LIMIT) -> Index:
    """Index of corpus (item_id, vector). Null vectors are left out; all others must have the same length."""
    kind = corpus.schema["item_id"].dataType
    arrow = to_arrow_type(kind)
    rows = corpus.where("vector IS NOT NULL").select("item_id", F.col("vector").cast("array<float>").alias("vector"))
    n, dims = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not n:
        return Index(rows, rows.select(F.lit(0).alias("cell"), F.array("item_id").alias("ids"), F.lit(0.0).cast("float").alias("step"), F.lit(b"").alias("codes")), np.zeros((0, 0), np.float32), 1, 0.0)
    k = cells or max(1, min(CELLS, round(n**0.5)))
    most = max(k, min(64 * k + 4096, SAMPLE_BYTES // (4 * dims)))
    at = F.pmod(F.xxhash64(F.col("item_id").cast("string"), F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.where(at <= min(1.0, most / n)).select("vector").limit(most).toArrow()["vector"].combine_chunks()
    sample = _unit(_matrix(drawn)) if len(drawn) else np.zeros((1, dims), np.float32)
    k = min(k, len(sample))
    c = fit_centroids(sample, k)
    probes, read = fit_probes(sample, c, limit, recall)

    def pack(ids, u):
        owner = np.concatenate([(u[lo : lo + 8192] @ c.T).argmax(1) for lo in range(0, len(u), 8192)])
        order = np.argsort(owner, kind="stable")
        edges = np.flatnonzero(np.r_[True, np.diff(owner[order]) != 0, True])
        out = ([], [], [], [])
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            own = order[lo:hi]
            left = u[own] - c[owner[own[0]]]
            step = float(np.abs(left).max()) / 127 or 1.0
            for to, x in zip(out, (int(owner[own[0]]), ids.take(pa.array(own)).to_pylist(), step, np.rint(left / step).astype(np.int8).tobytes()), strict=True):
                to.append(x)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.list_(arrow)), pa.array(out[2], pa.float32()), pa.array(out[3], pa.binary())], names=["cell", "ids", "step", "codes"])

    def run(batches):
        ids, held, n = [], [], 0
        for batch in batches:
            if batch.num_rows:
                ids.append(batch.column(0))
                held.append(_unit(_matrix(batch.column(1))))
                n += batch.num_rows
            if n >= FLUSH:
                yield pack(pa.concat_arrays(ids), np.concatenate(held))
                ids, held, n = [], [], 0
        if n:
            yield pack(pa.concat_arrays(ids), np.concatenate(held))

    packs = cut(rows.mapInArrow(run, f"cell int, ids array<{kind.simpleString()}>, step float, codes binary"))
    return Index(rows, packs, c, probes, read)


def candidates(queries: DataFrame, index: Index, most: int, probes: int) -> DataFrame:
    """query_id, item_id: the best `most` by codes among the probed cells, for one block of queries (query_id, vector)."""
    asked = queries.where("vector IS NOT NULL").select("query_id", F.col("vector").cast("array<float>").alias("vector")).toArrow()  # bounded by the block
    kind, item = queries.schema["query_id"].dataType, index.corpus.schema["item_id"].dataType
    names = asked["query_id"].to_pylist()
    q = _unit(_matrix(asked["vector"].combine_chunks())) if len(names) else np.zeros((0, index.centroids.shape[1]), np.float32)
    c = index.centroids
    near = q @ c.T if len(c) else np.zeros((len(q), 0), np.float32)
    probed = np.argsort(-near, axis=1)[:, :probes]
    of_cell = {}
    for k, row in enumerate(probed.tolist()):
        for cell in row:
            of_cell.setdefault(cell, []).append(k)
    asking = {cell: np.array(ks) for cell, ks in of_cell.items()}

    def run(batches):
        scores, items = [np.zeros(0, np.float32) for _ in names], [[] for _ in names]
        for batch in batches:
            for cell, ids, step, codes in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                ks = asking.get(cell)
                if ks is None:
                    continue
                left = np.frombuffer(codes, np.int8).reshape(len(ids), -1).astype(np.float32)
                found = (q[ks] @ left.T) * np.float32(step) + near[ks, cell][:, None]
                for row, k in zip(found, ks.tolist(), strict=True):
                    if len(row) > most:
                        own = np.argpartition(-row, most)[:most]
                        row, own_ids = row[own], [ids[i] for i in own.tolist()]
                    else:
                        own_ids = ids
                    row, own_ids = np.concatenate([scores[k], row]), items[k] + own_ids
                    if len(row) > 4 * most:
                        own = np.argpartition(-row, most)[:most]
                        row, own_ids = row[own], [own_ids[i] for i in own.tolist()]
                    scores[k], items[k] = row, own_ids
        for k in range(len(names)):
            own = np.argsort(-scores[k], kind="stable")[:most]
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array([names[k]] * len(own), to_arrow_type(kind)), pa.array([items[k][i] for i in own.tolist()], to_arrow_type(item)), pa.array(scores[k][own], pa.float32())], names=["query_id", "item_id", "near"])

    asked_cells = index.packs.where(F.col("cell").isin(sorted(asking))) if len(asking) < 200 else index.packs
    found = asked_cells.select("cell", "ids", "step", "codes").mapInArrow(run, f"query_id {kind.simpleString()}, item_id {item.simpleString()}, near float")
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.col("near").desc(), "item_id")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select("query_id", "item_id")


def scores(queries: DataFrame, index: Index, limit: int, probes: int | None = None, rerank: int = RERANK) -> DataFrame:
    """query_id, item_id, raw: exact cosine, 0 at least, of the candidates of one block of queries."""
    found = cut(candidates(queries, index, limit * rerank, probes or index.probes))
    own = index.corpus.join(F.broadcast(found), "item_id").join(F.broadcast(queries.select("query_id", F.col("vector").alias("_q"))), "query_id")  # both bounded by the block
    return own.select("query_id", "item_id", F.round(F.greatest(F.lit(0.0), V.cosine(F.col("_q"), F.col("vector"))), 6).alias("raw"))


def search(queries: DataFrame, corpus: DataFrame | Index, limit: int = P.SEARCH_LIMIT, exact: bool = False, **parameters) -> DataFrame:
    """The nearest `limit` items of each query, as S.vector gives them; exact=True compares every query with every item."""
    if exact:
        return S.vector(queries, corpus.corpus if isinstance(corpus, Index) else corpus, limit)
    index = corpus if isinstance(corpus, Index) else build(corpus, limit=limit)
    return S.in_blocks(queries, lambda q: S.ranked(scores(q, index, limit, **parameters), "vector", limit))


def best_chunk(queries: DataFrame, chunks: DataFrame, limit: int = P.SEARCH_LIMIT, chunks_each: int = 4) -> DataFrame:
    """Items by their best chunk (chunk_id, item_id, vector), of the nearest limit * chunks_each chunks of each query."""
    of = chunks.select(F.col("chunk_id"), F.col("item_id").alias("of"))
    index = build(chunks.select(F.col("chunk_id").alias("item_id"), "vector"), limit=limit * chunks_each)
    near = search(queries, index, limit * chunks_each)
    best = near.join(of, F.col("item_id") == F.col("chunk_id")).groupBy("query_id", F.col("of").alias("item_id")).agg(F.max("raw").alias("raw"))
    return S.ranked(best, "vector", limit)
