"""The nearest vectors of each query: cosines of all pairs by products of blocks, exact ones for those that can rank.

Each task multiplies its vectors with a chunk of queries at a time. Only pairs that come within MARGIN of the last of a
query's best go on, since cosines are rounded to six places before they are ranked; their products are added up in order,
component by component, so that a cosine is the same however vectors are dealt out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: More than two cosines may differ and be equal at six places; queries and vectors multiplied at a time.
MARGIN, CHUNK, ROWS = 1.1e-6, 256, 4096


def _by_length(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and vectors of each length, without null ones and those with a null."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    begins = column.offsets.to_numpy()
    sizes, none = np.diff(begins), column.is_null().to_numpy(zero_copy_only=False)
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    holes = np.concatenate([[0], np.cumsum(column.values.is_null().to_numpy(zero_copy_only=False))])
    none = none | (holes[begins[1:]] > holes[begins[:-1]])
    found = {}
    for n in np.unique(sizes[~none]).tolist():
        at = np.flatnonzero((sizes == n) & ~none)
        found[n] = at, values[begins[at][:, None] + np.arange(n)]
    return found


def _sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total = total + a[:, k] * b[:, k]
    return total


def best(queries: DataFrame, corpus: DataFrame, limit: int) -> DataFrame:
    """query_id, item_id, raw: cosine (0 for null, empty or zero vectors and other lengths), 0 at least, for one block of queries; of each task at least the best `limit` after rounding to six places.

    queries: query_id, vector and, as they may be, wanted (the group it is limited to) and rejected (ids); corpus: item_id,
    vector and, with wanted, g. The queries' number is bounded by the caller, so they go to every task.
    """
    columns = [c for c in ("wanted", "rejected") if c in queries.columns]
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"), *columns).collect()
    kind, item = queries.schema["query_id"].dataType, corpus.schema["item_id"].dataType
    names, vectors = [q["query_id"] for q in asked], _by_length(pa.array([q["vector"] for q in asked], pa.list_(pa.float64())))
    wanted = np.array([q["wanted"] for q in asked], object) if "wanted" in columns else None
    out = {}
    for k, q in enumerate(asked if "rejected" in columns else ()):
        for i in q["rejected"] or ():
            out.setdefault(i, []).append(k)

    def run(batches):
        norms = {n: np.sqrt(_sums(v, v)) for n, (_, v) in vectors.items()}
        place = {n: np.full(len(names), -1) for n in vectors}
        for n, (at, _) in vectors.items():
            place[n][at] = np.arange(len(at))
        top = np.full((len(names), limit), -np.inf)
        found = []  # query, item, cosine by product, cosine
        for whole in batches:
            for begin in range(0, whole.num_rows, ROWS):
                batch = whole.slice(begin, ROWS)
                items = batch.column(0)
                # A slice keeps its parent's values, so it is copied before offsets are read.
                mine = _by_length(pa.concat_arrays([batch.column(1)]).take(pa.array(np.arange(batch.num_rows))))
                groups = np.array(batch.column(2).to_pylist(), object) if wanted is not None else None
                gone = [(k, p) for p, i in enumerate(items.to_pylist()) for k in out.get(i, ())] if out else []
                gone.sort()
                gone = np.array(gone, np.int64).reshape(-1, 2)
                own = {n: np.sqrt(_sums(v, v)) for n, (_, v) in mine.items()}
                for lo in range(0, len(names), CHUNK):
                    hi = min(lo + CHUNK, len(names))
                    near = np.zeros((hi - lo, batch.num_rows))
                    with np.errstate(all="ignore"):
                        for n, (at, v) in mine.items():
                            if n in vectors:
                                k = np.arange(lo, hi)[place[n][lo:hi] >= 0]
                                by = norms[n][place[n][k]][:, None] * own[n]
                                dots = vectors[n][1][place[n][k]] @ v.T / by
                                near[np.ix_(k - lo, at)] = np.where(by == 0, 0.0, np.where(np.isnan(dots), np.inf, np.maximum(dots, 0)))
                    if wanted is not None:
                        limited = wanted[lo:hi, None]
                        near[np.not_equal(limited, None) & (limited != groups)] = -np.inf
                    a, b = np.searchsorted(gone[:, 0], [lo, hi])
                    near[gone[a:b, 0] - lo, gone[a:b, 1]] = -np.inf
                    rows = np.flatnonzero((near > top[lo:hi].min(axis=1)[:, None]).any(axis=1))
                    top[lo + rows] = np.partition(np.concatenate([top[lo + rows], near[rows]], axis=1), -limit, axis=1)[:, -limit:]
                    q, p = np.nonzero((near >= top[lo:hi].min(axis=1)[:, None] - MARGIN) & (near >= 0))
                    if not len(q):
                        continue
                    raw = np.zeros(len(q))
                    with np.errstate(all="ignore"):
                        for n, (at, v) in mine.items():
                            if n in vectors:
                                where = np.full(batch.num_rows, -1)
                                where[at] = np.arange(len(at))
                                some = np.flatnonzero((place[n][lo + q] >= 0) & (where[p] >= 0))
                                x, y = place[n][lo + q[some]], where[p[some]]
                                by = norms[n][x] * own[n][y]
                                raw[some] = np.where(by == 0, 0.0, np.maximum(_sums(vectors[n][1][x], v[y]) / by, 0))
                    found.append((q + lo, items.take(pa.array(p)), near[q, p], raw))
        kept = [np.flatnonzero(near >= top[q].min(axis=1) - MARGIN) for q, _, near, _ in found]
        ids = pa.array(names, to_arrow_type(kind))
        for (q, i, _, raw), some in zip(found, kept, strict=True):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(q[some])), i.take(pa.array(some)), pa.array(raw[some])], names=["query_id", "item_id", "raw"])

    dealt = corpus.select("item_id", F.col("vector").cast("array<double>").alias("vector"), *([F.col("g").cast("string").alias("g")] if wanted is not None else [])).repartition("item_id")
    return dealt.mapInArrow(run, f"query_id {kind.simpleString()}, item_id {item.simpleString()}, raw double")
