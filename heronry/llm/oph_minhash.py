"""MinHash near-duplicates by one-permutation hashing with optimal densification, banded buckets and star-shaped candidates.

Each distinct word shingle of a text has one 64-bit hash. Its leading bits name one of BINS bins, and a bin keeps the
least hash that falls into it, so one pass gives all minima. An empty bin takes the value of the first bin that is not
empty in a sequence of bins drawn by a hash of its own number (optimal densification), so two sets agree in a bin with
probability equal to their similarity. ROWS bins in a row make a band; documents with equal bands meet in a bucket.

Equal sets are one class first. A bucket proposes a star: one edge from its least class to every other, so candidates
grow with bucket memberships, not with pairs. Of its stars a class tries the one it shares most bands with, then, while
it has no link, the next ones. Candidates are confirmed on full sets, and confirmed ones merge classes. A star alone may
miss: two members may link with each other but not with the centre. So every bucket that still holds several components
is compared member by member, in blocks, over sketches of one byte a bin. Who may reach the similarity with a class of
another component (six standard deviations are allowed for) asks the block that this class is kept in; a block holds some
GROUP classes of one group, and what asks it is compared with all of them, on full sets, until it has a link with each
of their components. So full sets travel once for each block they ask, not once for each pair. A pair of the least
similarity meets in a bucket with probability 1 - (1 - 0.8**4)**32, that is all but 5 in 10**8.

Shingles are compared by 64-bit hashes and equal sets found by a 128-bit digest of their hashes. Sets are not stored:
those of candidates are made again from their texts.

Defined results: a null text or one without a word has an empty set, links with nothing and keeps its own doc_id as
component_id; a text of fewer words than a shingle is one shingle; a component's id is its least doc_id that is not null
(null if there is none); repeated rows and ties share a component; a very long text is hashed in stretches of 32,768
words; an empty table gives an empty result; extra columns are ignored (keep_one carries them).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, mix, small, spare, table
from .components import components

SHINGLE, PERCENT = 2, 80
BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
#: Members of a bucket that are compared at a time.
BLOCK = 1024
#: Ids of candidates are broadcast to their texts and sets up to so many of them, and meet them by a shuffled join beyond.
FEW = 1 << 19
#: Classes of a block that is asked, how many may ask one part of it, and the stars that a class without a link tries after its best.
GROUP, ASKING, TRIES = 256, 512, 3

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_EDGES = (np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)).astype(np.uint64)
#: Row t: the bin that each bin asks at its t-th attempt.
DONORS = (mix(np.arange(1024 * BINS, dtype=np.uint64) * _A + _B) % np.uint64(BINS)).astype(np.int64).reshape(1024, BINS)


class _Words(dict):
    """64-bit hashes of words, the last 100,000 or so remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def shingle_set(text: str | None, words: _Words, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    width, parts = min(shingle, len(found)), []
    for at in range(0, len(found) - width + 1, 1 << 15):
        h = np.array([words[w] for w in found[at : at + (1 << 15) + width - 1]], np.uint64)
        n = len(h) - width + 1
        own = np.full(n, width, np.uint64)
        for k in range(width):
            own = mix(own * _A + h[k : k + n])
        parts.append(np.unique(own))
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The BINS minima of a set of sorted hashes (not empty), empty bins densified."""
    first = np.searchsorted(hashes, _EDGES)
    full = np.r_[first[1:], len(hashes)] > first
    out = hashes[np.minimum(first, len(hashes) - 1)]
    empty, t = np.flatnonzero(~full), 0
    while len(empty):
        asked = DONORS[t : t + 32][:, empty]
        known = full[asked]
        hit = known.any(0)
        out[empty[hit]] = out[asked[known.argmax(0), np.arange(len(empty))][hit]]
        empty, t = empty[~hit], t + 32
        if t >= len(DONORS) and len(empty):  # as good as never: the next full bin
            own = np.flatnonzero(full)
            out[empty] = out[own[np.searchsorted(own, empty) % len(own)]]
            break
    return out


def bands(values: np.ndarray) -> np.ndarray:
    """One key for each band of minima."""
    rows = values.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64) * _C + _B
    for k in range(ROWS):
        key = mix(key * _A + rows[:, k])
    return key.view(np.int64)


def least_size(percent: int) -> int:
    """Smaller sets reach the similarity with equal ones only."""
    return math.ceil(percent / (100 - percent)) if percent < 100 else 1 << 62


def least_agreement(percent: int) -> int:
    """Agreeing sketch bytes that a linked pair has but for six standard deviations."""
    p = percent / 100
    return max(0, math.floor(BINS * p - 6 * math.sqrt(BINS * p * (1 - p))))


def _prints(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, th, n, digest, bands (null for a set too small to link with another), sketch of every row."""
    least = least_size(percent)

    def run(batches):
        words = _Words()
        for batch in small(batches):
            rows = ([], [], [], [])
            for text in batch.column(2).to_pylist():
                own = shingle_set(text, words, shingle)
                values = minima(own) if len(own) >= least else None
                for out, x in zip(rows, (len(own), xxhash.xxh3_128_digest(own.tobytes()), None if values is None else bands(values), None if values is None else values.astype(np.uint8).tobytes()), strict=True):
                    out.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.list_(pa.int64())), pa.array(rows[3], pa.binary())], names=["doc_id", "th", "n", "digest", "bands", "sketch"])

    return _keyed_texts(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, n long, digest binary, bands array<long>, sketch binary")


def _keyed_texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("th"), text.alias("text"))


def _few(df: DataFrame) -> DataFrame:
    """df, cut, to be broadcast if it has FEW rows at most."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= FEW else df


def _ids(df: DataFrame) -> DataFrame:
    """Ids to join by left_semi or left_anti: broadcast if they are FEW rows at most, else distinct."""
    return F.broadcast(df) if df.count() <= FEW else df.distinct()


def _sets(docs: DataFrame, known: DataFrame, shingle: int) -> DataFrame:
    """cid, root, sketch, hashes (bytes of the sorted set) of the classes in known (cid, root, sketch, digest, first), made from the text of each class's first row; a task gives a class once."""
    asked = _few(known.select("cid", "root", "sketch", "digest", F.col("first.doc_id").alias("first_id"), F.col("first.th").alias("first_th")))
    rows = _keyed_texts(docs).join(asked, (F.col("th") == F.col("first_th")) & F.col("doc_id").eqNullSafe(F.col("first_id"))).select("cid", "root", "sketch", "digest", "text")

    def run(batches):
        words, seen = _Words(), set()
        for batch in small(batches):
            own, sets = [], []
            for k, (cid, digest, text) in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 3, 4)), strict=True)):
                found = b"" if cid in seen else shingle_set(text, words, shingle).tobytes()
                if found and xxhash.xxh3_128_digest(found) == digest:
                    seen.add(cid)
                    own.append(k)
                    sets.append(found)
            at = pa.array(own, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(3)), pa.array(sets, pa.binary())], names=["cid", "root", "sketch", "hashes"])

    return rows.mapInArrow(run, "cid long, root long, sketch binary, hashes binary")


def _reaches(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = np.concatenate([a, b])
    both.sort(kind="stable")  # two sorted runs
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= percent * (len(both) - same)


def _answers(percent: int):
    """Reads rows (block, part, asks, cid, root, sketch, hashes) sorted by block, part and asks: a block's classes, then who asks it. Gives a link, as the two roots, for each root that the asking class reaches."""
    least = least_agreement(percent)

    def run(batches):
        at, held, matrix, roots, sizes = None, [], None, None, None
        for batch in small(batches):
            links = {}  # in order, each once
            for block, part, asks, cid, root, sketch, hashes in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if (block, part) != at:
                    at, held, matrix = (block, part), [], None
                own = np.frombuffer(hashes, np.uint64)
                if not asks:
                    held.append((cid, root, np.frombuffer(sketch, np.uint8), own))
                    continue
                if not held:
                    continue
                if matrix is None:
                    matrix, roots, sizes = np.stack([h[2] for h in held]), np.array([h[1] for h in held]), np.array([len(h[3]) for h in held])
                n = len(own)
                agree = (matrix == np.frombuffer(sketch, np.uint8)).sum(1)
                near = np.flatnonzero((roots != root) & (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n)) & (agree >= least))
                met = set()
                for k in near[np.argsort(-agree[near], kind="stable")].tolist():
                    if roots[k] not in met and _reaches(held[k][3], own, percent):
                        met.add(roots[k])
                        links[int(roots[k]), root] = None
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return run


def _confirmed(docs: DataFrame, known: DataFrame, rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """u, v: links, on full sets, between the roots of classes that ask and of classes of the blocks they ask; cut.

    known: cid, root, sketch, digest, first. rows: block, part, asks, cid, with the classes of a block in each of its parts.
    """
    rows = cut(rows)
    count = rows.count()
    if not count:
        return rows.select(F.col("cid").alias("u"), F.col("cid").alias("v"))
    sets = _sets(docs, known.join(_ids(rows.select("cid")), "cid", "left_semi"), shingle)
    sent = sets.join(F.broadcast(rows) if count <= FEW else rows, "cid").select("block", "part", "asks", "cid", "root", "sketch", "hashes")
    return cut(sent.repartition("block", "part").sortWithinPartitions("block", "part", "asks").mapInArrow(_answers(percent), "u long, v long"))


def _asking_stars(rays: DataFrame) -> DataFrame:
    """block, part, asks, cid of the classes of rays (cid, centre, m) and of the centres they ask. m, the members of the largest bucket they share, gives the parts."""
    asking = rays.select(F.col("centre").alias("block"), F.pmod(F.xxhash64("cid"), F.ceil(F.col("m") / ASKING)).cast("int").alias("part"), F.lit(True).alias("asks"), "cid")
    return asking.union(asking.select("block", "part").distinct().select("block", "part", F.lit(False), "block"))


def _asking_blocks(asks: DataFrame, rooted: DataFrame) -> DataFrame:
    """block, part, asks, cid of asks (cid, block) and of the classes of the blocks (rooted: cid, block). A block that more than ASKING classes ask is copied, so each of its parts answers some of them."""
    parts = _few(asks.groupBy("block").agg(F.ceil(F.count("*") / ASKING).cast("int").alias("parts")))
    asking = asks.join(parts, "block").select("block", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("asks"), "cid")
    return asking.union(rooted.join(parts, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), F.lit(False), "cid"))


def agreeing(a: tuple, b: tuple | None, percent: int) -> list[tuple[int, int]]:
    """(id, block) across a and b (within a if b is None): a class and the block of another, of a different root, whose size and sketch may reach the similarity.

    a and b: (ids, roots, sizes, blocks, sketches). Members of a root are compared with those of other roots only, the fewer with the more.
    """
    least, out = least_agreement(percent), []
    x, y = a, a if b is None else b
    for root in np.unique(x[1]):
        own, others = np.flatnonzero(x[1] == root), np.flatnonzero(y[1] > root if b is None else y[1] != root)
        if not len(others):
            continue
        (few, one), (more, many) = ((own, x), (others, y)) if len(own) <= len(others) else ((others, y), (own, x))
        sizes, blocks, sketches = many[2][more], many[3][more], many[4][more]
        for i in few:
            n = one[2][i]
            near = np.flatnonzero(100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n))
            near = near[(sketches[near] == one[4][i]).sum(1) >= least]
            out += [(int(one[0][i]), int(j)) for j in np.unique(blocks[near])]
    return out


_PACK = "cid long, asked long, key long, block string, minor boolean, root long, data binary"


def _pack(ids, roots, sizes, blocks, sketches) -> bytes:
    return b"".join([np.int64(len(ids)).tobytes(), ids.tobytes(), roots.tobytes(), sizes.tobytes(), blocks.tobytes(), sketches.tobytes()])


def _unpack(data: bytes) -> tuple:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    longs = np.frombuffer(data, np.int64, 4 * n, 8).reshape(4, n)
    return *longs, np.frombuffer(data, np.uint8, BINS * n, 8 + 32 * n).reshape(n, BINS)


def _within_buckets(percent: int):
    """Reads rows (key, whole, minor, part, cid, root, n, block, sketch) sorted by key, minor and part. Gives who asks which block in a whole bucket, or packed blocks of one that is dealt."""

    def batch_of(pairs, blocks):
        k, m = len(pairs), len(blocks)
        return pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in pairs] + [None] * m, pa.int64()), pa.array([p[1] for p in pairs] + [None] * m, pa.int64()), *(pa.array([None] * k + [b[i] for b in blocks], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.binary())))],
            names=["cid", "asked", "key", "block", "minor", "root", "data"],
        )

    def run(batches):
        at, held, sent = None, [], 0

        def finish():
            if not held:
                return
            key, whole, minor, part = at
            own = tuple(np.concatenate([h[i] for h in held]) for i in range(5))
            if whole:
                pairs = agreeing(own, None, percent)
                if pairs:
                    yield batch_of(pairs, [])
            else:
                one = int(own[1][0]) if (own[1] == own[1][0]).all() else None
                yield batch_of([], [(key, f"{'b' if minor else 'a'}{part}.{sent}", minor, one, _pack(*own))])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, whole, minor, part, cid, root, n, place = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(8))
            sketch = np.frombuffer(b"".join(batch.column(8).to_pylist()), np.uint8).reshape(-1, BINS)
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (minor[1:] != minor[:-1]) | (part[1:] != part[:-1])])
            for s, e in zip(starts, np.r_[starts[1:], len(key)], strict=True):
                own = (int(key[s]), bool(whole[s]), bool(minor[s]), int(part[s]))
                if whole[s]:
                    own = (*own[:2], False, 0)  # minor and part do not cut a bucket that is whole
                if own != at:
                    yield from finish()
                    at, held, sent = own, [], 0
                for lo in range(s, e, BLOCK):
                    hi = min(e, lo + BLOCK)
                    if not own[1] and sum(len(h[0]) for h in held) + hi - lo > BLOCK:
                        yield from finish()
                        held, sent = [], sent + 1
                    held.append(tuple(x[lo:hi].copy() for x in (cid, root, n, place, sketch)))
        yield from finish()

    return run


def _between_blocks(percent: int):
    def run(batches):
        for batch in batches:
            for a, b, same in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                found = agreeing(_unpack(a), None if same else _unpack(b), percent)
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], names=["cid", "asked"])

    return run


def unconnected(members: DataFrame, rooted: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """cid, block, distinct: who shares a bucket (members: key, cid) but no root (rooted: cid, root, n, sketch, block) with a class of the block and may reach the similarity with it.

    A bucket of up to `block` members is compared where it is read. A larger one is dealt into packs, its most frequent root
    apart from the rest, and only packs that hold different roots are compared with each other.
    """
    own = cut(members.join(rooted.select("cid", "root"), "cid"))
    counts = own.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("size"), F.max(F.struct("n", "root")).alias("most"), F.count("*").alias("roots")).where("roots > 1")
    mixed = own.join(counts.select("key", "size", F.col("most.root").alias("major"), F.col("most.n").alias("n_major")), "key")
    minor = F.col("root") != F.col("major")
    parts = F.ceil(F.when(minor, F.col("size") - F.col("n_major")).otherwise(F.col("n_major")) / block)
    dealt = mixed.select("key", "cid", (F.col("size") <= block).alias("whole"), minor.alias("minor"), F.when(F.col("size") <= block, 0).otherwise(F.pmod(F.xxhash64("cid"), parts)).alias("part"))
    rows = dealt.join(rooted, "cid").select("key", "whole", "minor", "part", "cid", "root", "n", "block", "sketch", F.when(F.col("whole"), False).otherwise(F.col("minor")).alias("half"))
    found = cut(rows.repartition("key", "half", "part").sortWithinPartitions("key", "half", "part").drop("half").mapInArrow(_within_buckets(percent), _PACK))
    asks, packs = found.where("cid IS NOT NULL").select("cid", "asked"), found.where("cid IS NULL").drop("cid", "asked")
    if not packs.isEmpty():
        names = packs.select("key", "block", "minor", "root")
        left, right = names.select("key", F.col("block").alias("x"), F.col("root").alias("rx")), names.select("key", F.col("block").alias("y"), F.col("root").alias("ry"), "minor")
        # A pack of the frequent root meets packs of the rest; packs of the rest meet each other and themselves.
        met = right.where("minor").join(left, "key").where((F.col("x") <= F.col("y")) & ~F.coalesce(F.col("rx") == F.col("ry"), F.lit(False)))
        side = lambda name, to: packs.select("key", F.col("block").alias(name), F.col("data").alias(to))
        both = met.select("key", "x", "y").join(side("x", "a"), ["key", "x"]).join(side("y", "b"), ["key", "y"]).select("a", "b", (F.col("x") == F.col("y")).alias("same"))
        asks = asks.union(both.mapInArrow(_between_blocks(percent), "cid long, asked long"))
    return asks.select("cid", F.col("asked").alias("block")).distinct()


def _linked(docs: DataFrame, shingle: int, percent: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(prints of every row; cid, digest, least, root of every class with a word)."""
    prints = cut(_prints(docs, shingle, percent).withColumn("row", F.monotonically_increasing_id()))
    classes = cut(
        prints.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("least"), F.min(F.struct("row", "doc_id", "th")).alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")).withColumn("cid", F.col("first.row"))
    )
    keyed = classes.where("bands IS NOT NULL").select("cid", "n", F.explode("bands").alias("key"))
    centres = keyed.groupBy("key").agg(F.min(F.struct("cid", "n")).alias("centre"), F.count("*").alias("m")).where("m > 1")
    members = cut(keyed.join(centres, "key").select("key", "cid", "n", "m", F.col("centre.cid").alias("centre"), F.col("centre.n").alias("n_centre")))
    similar = (F.col("cid") != F.col("centre")) & (100 * F.least("n", "n_centre") >= percent * F.greatest("n", "n_centre"))
    own = Window.partitionBy("cid")
    met = members.repartition("cid").groupBy("cid", "centre").agg(F.count_if(similar).alias("shared"), F.max("m").alias("m"))
    met = met.select("*", F.row_number().over(own.orderBy(F.desc("shared"), "centre")).alias("place"), F.max(F.struct("m", (-F.col("centre")).alias("back"))).over(own).alias("g"))
    met = cut(met.where(F.col("place") <= 1 + TRIES))  # what is left out here meets again in the buckets
    star = met.where("shared > 0").select("cid", "centre", "m", "place")
    alone = classes.where("bands IS NOT NULL").withColumn("root", F.col("cid"))
    first = _confirmed(docs, alone, _asking_stars(star.where("place = 1")), shingle, percent)
    further = star.where("place > 1").join(_ids(first.select(F.explode(F.array("u", "v")).alias("cid"))), "cid", "left_anti")
    at_first = components(first.union(_confirmed(docs, alone, _asking_stars(further), shingle, percent)))
    # A group's share of its largest bucket is dealt into blocks of about GROUP classes.
    kept_in = met.where("place = 1").select("cid", F.xxhash64("g", F.pmod(F.xxhash64("cid"), F.ceil(F.col("g.m") / GROUP))).alias("block"))
    rooted = cut(classes.where("bands IS NOT NULL").drop("bands").join(kept_in, "cid").join(at_first, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid")).drop("node"))
    asks = cut(unconnected(members.select("key", "cid"), rooted, percent, block))
    more = _confirmed(docs, rooted, _asking_blocks(asks, rooted), shingle, percent)
    found = rooted.select(F.col("cid").alias("node"), "root")
    if not more.isEmpty():  # these links are between roots
        found = found.join(components(more).select(F.col("node").alias("root"), F.col("root").alias("least_root")), "root", "left").select("node", F.coalesce("least_root", "root").alias("root"))
    return prints, classes.join(found, F.col("cid") == F.col("node"), "left").select("cid", "digest", "least", F.coalesce("root", "cid").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text)."""
    prints, rooted = _linked(docs, shingle, percent, block)
    rooted = cut(rooted)
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = rooted.join(of_root, "root").select("digest", "component_id")
    linked = prints.where("n > 0").join(of_class, "digest").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = prints.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """The rows of docs with the least doc_id of their component, with all columns; rows that repeat that id stay, and so do rows without a word or an id."""
    stays = cut(near_duplicates(docs, shingle, percent, block).where("kept").select(F.col("doc_id").alias("kept_id")).distinct())
    key = spare(docs, "kept_id")
    return docs.join(stays.withColumnRenamed("kept_id", key), F.col("doc_id").eqNullSafe(F.col(key)), "left_semi")


def op13_oph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = """
WITH words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
),
sets AS MATERIALIZED (
    SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS s FROM words
),
classes AS MATERIALIZED (SELECT min(doc_id) AS c, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
members AS MATERIALIZED (SELECT c, n, unnest(s) AS g FROM classes),
often AS (SELECT g, count(*) AS f FROM members GROUP BY g),
ranked AS MATERIALIZED (SELECT c, n, g, row_number() OVER (PARTITION BY c ORDER BY f, g) AS p FROM members JOIN often USING (g)),
prefix AS MATERIALIZED (SELECT c, n, g FROM ranked WHERE p <= n - (80 * n + 99) // 100 + 1),
maybe AS (SELECT DISTINCT a.c AS x, b.c AS y, a.n AS nx, b.n AS ny FROM prefix a JOIN prefix b ON a.g = b.g AND a.c < b.c AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
links AS MATERIALIZED (
    SELECT x, y FROM (SELECT x, y, nx, ny, len(list_intersect(p.s, q.s)) AS k FROM maybe JOIN classes p ON p.c = x JOIN classes q ON q.c = y) WHERE 100 * k >= 80 * (nx + ny - k)
),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS MATERIALIZED (
    WITH RECURSIVE walk AS (SELECT c AS x, c AS y FROM classes UNION SELECT walk.x, b.y FROM walk JOIN both_ways b ON walk.y = b.x) SELECT x AS c, min(y) AS component_id FROM walk GROUP BY x
)
SELECT doc_id, len(s) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM sets LEFT JOIN classes USING (s) LEFT JOIN reach USING (c)
"""
