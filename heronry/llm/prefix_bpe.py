"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece exactly one token can be the last one of its encoding: the token that ends there, is
itself what the merges make of its bytes, and forms a compatible pair with the last token of what precedes it.
Storing that one token per prefix makes the encoding of every prefix readable by walking back, appending exact
(earlier entries never change) and re-encoding near an edit local.

Two tokens are compatible if the merges, applied to both byte strings side by side, never join across the border
before both are complete. That is decided by replaying the merges along the right edge of the first token and the
left edge of the second in order of rank.

Defined results: a null or empty text has no tokens (ids_sha256 and decoded_sha256 are of the empty string);
repeated rows are encoded alike; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import small, table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pieces, pairs of tokens and byte prefixes whose outcome a worker remembers, and the longest such prefix.
PIECES, PAIRS, PREFIXES, SHARED = 200_000, 400_000, 200_000, 48
#: Pieces remembered where only digests leave the worker: no ids are held for Spark, so there is room for more.
DIGEST_PIECES = 300_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class PrefixBPE:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.left: dict[int, list[int]] = {}
        self.right: dict[int, list[int]] = {}
        self.parts = {}
        for t, i in sorted(ranks.items(), key=lambda x: x[1]):
            self.parts[i] = self._parts(t) if len(t) > 1 else ()
        self.made = {t: i for t, i in ranks.items() if self.parts[i] is not None}
        self.width = [len(self.token[i]) for i in range(max(ranks.values()) + 1)] if set(self.token) == set(range(len(ranks))) else {i: len(t) for i, t in self.token.items()}
        self.longest = max(map(len, ranks))
        self.known: dict[bytes, int] = {}  # byte prefix -> its last token, shared by all pieces that begin alike

    def _parts(self, t: bytes) -> tuple[int, int] | None:
        """The two tokens whose merge makes t, or None if the merges never make t of its bytes."""
        ids = [self.ranks[t[k : k + 1]] for k in range(len(t))]
        while len(ids) > 2:
            pairs = [self.ranks.get(self.token[a] + self.token[b], 1 << 60) for a, b in zip(ids, ids[1:])]
            least = min(pairs)
            if least >= self.ranks[t]:
                return None
            k = pairs.index(least)
            ids[k : k + 2] = [least]
        return tuple(ids)

    def _edge(self, i: int, side: int, known: dict[int, list[int]]) -> list[int]:
        """Tokens along one edge of token i, from the single byte up to i."""
        if i not in known:
            known[i] = [*(self._edge(self.parts[i][side], side, known) if self.parts[i] else []), i]
        return known[i]

    def fits(self, a: int, b: int) -> bool:
        """Whether the merges leave a and b apart when b follows a."""
        found = self.compatible.get((a, b))
        if found is None:
            if len(self.compatible) >= PAIRS:
                self.compatible.clear()
            found = self.compatible[a, b] = self._fits(a, b)
        return found

    def _fits(self, a: int, b: int) -> bool:
        left, right = self._edge(a, 1, self.right), self._edge(b, 0, self.left)
        i = j = 0
        never = 1 << 60
        while True:
            across = self.ranks.get(self.token[left[i]] + self.token[right[j]], never)
            of_a = left[i + 1] if i + 1 < len(left) else never
            of_b = right[j + 1] if j + 1 < len(right) else never
            if of_a <= across and of_a <= of_b and of_a < never:  # of equal ranks the leftmost pair merges first
                i += 1
            elif across < never and across <= of_b:
                return False
            elif of_b < never:
                j += 1
            else:
                return True

    def last_token(self, data: bytes, last: list[int]) -> int:
        """The last token of the encoding of data; last holds that of every shorter prefix."""
        n, made, compatible = len(data), self.made.get, self.compatible.get
        for j in range(max(0, n - self.longest), n):
            t = made(data[j:])
            if t is not None:
                if not j:
                    return t
                fit = compatible((last[j - 1], t))
                if fit or fit is None and self.fits(last[j - 1], t):
                    return t
        raise ValueError("the vocabulary lacks single bytes")

    def extend(self, data: bytes, last: list[int]) -> None:
        """Append the last token of every prefix of data longer than last; entries of last are final."""
        far = 2 * self.longest
        for n in range(len(last) + 1, len(data) + 1):
            last.append(self.last_token(data[:n], last) if n <= far else self.last_token(data[n - far : n], last[n - far :]))

    def ending(self, data: bytes) -> int:
        """The last token of a short piece, by way of the prefixes that its candidates leave."""
        t = self.known.get(data)
        if t is None:
            made, compatible = self.made.get, self.compatible.get
            for j in range(len(data)):
                t = made(data[j:])
                if t is not None:
                    if not j:
                        break
                    before = self.ending(data[:j])
                    fit = compatible((before, t))
                    if fit or fit is None and self.fits(before, t):
                        break
            if len(self.known) >= PREFIXES:
                self.known.clear()
            self.known[data] = t
        return t

    def walk(self, last: list[int], n: int) -> list[int]:
        out = []
        while n:
            out.append(last[n - 1])
            n -= self.width[last[n - 1]]
        return out[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(data) <= SHARED:
            out = []
            while data:
                out.append(t := self.ending(data))
                data = data[: -self.width[t]]
            return out[::-1]
        last: list[int] = []
        self.extend(data, last)
        return self.walk(last, len(data))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class Piece:
    """One piece with its prefix table: exact appends and cheap edits."""

    def __init__(self, bpe: PrefixBPE, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.bpe.extend(self.data, self.last)

    def edit(self, at: int, stop: int, new: bytes) -> None:
        """Replace data[at:stop] by new; entries before `at` stay as they are."""
        self.data = self.data[:at] + new + self.data[stop:]
        del self.last[at:]
        self.bpe.extend(self.data, self.last)

    def ids(self, n: int | None = None) -> list[int]:
        """Encoding of the first n bytes, by default of all."""
        n = len(self.data) if n is None else n
        whole = self.bpe.ranks.get(self.data[:n])
        return [whole] if whole is not None else self.bpe.walk(self.last, n)


class TextEncoder:
    """Splits a text by the pattern and encodes every match separately.

    A space between two characters that are not white space always begins a match, and no match reaches over it.
    So the words of a plainly spaced text are split by the pattern apart from each other, and remembered.
    """

    def __init__(self, path: str, pattern: str, pieces: int = PIECES, printed: bool = False):
        """printed: words() gives the decimal ids as a string too, for digests."""
        self.pieces, self.printed = pieces, printed
        self.bpe, self.split = PrefixBPE(load_ranks(path)), regex.compile(pattern).findall
        self.uneven = regex.compile(r"\s | \s|^ | $").search if pattern == public_tokenizers.PATTERN else (lambda _: True)
        self.seen: dict[str, tuple] = {}
        self.seen_piece: dict[str, tuple[int, ...]] = {}

    def piece(self, x: str) -> tuple[int, ...]:
        found = self.seen_piece.get(x)
        if found is None:
            found = tuple(self.bpe.encode_piece(x.encode()))
            if len(x) < 200:
                if len(self.seen_piece) >= self.pieces:
                    self.seen_piece.clear()
                self.seen_piece[x] = found
        return found

    def word(self, x: str) -> tuple:
        """Ids of a word after a space, or of the pieces of any text if it has no space before it; printed: (ids as a string, ids)."""
        parts = self.split(x)
        if len(parts) == 1 and len(x) < 200:  # remembered below as a word, so not as a piece too
            ids = self.seen_piece.get(parts[0]) or tuple(self.bpe.encode_piece(parts[0].encode()))
        else:
            ids = tuple([i for p in parts for i in self.piece(p)])
        found = (" ".join(map(str, ids)), ids) if self.printed else ids
        if len(x) < 200:
            if len(self.seen) >= self.pieces:
                self.seen.clear()
            self.seen[x] = found
        return found

    def words(self, text: str) -> list[tuple]:
        if not text:
            return []
        if self.uneven(text):
            return [self.word(text)]
        seen, word = self.seen.get, self.word
        first, *rest = text.split(" ")
        return [seen(first) or word(first), *[seen(x) or word(x) for x in [" " + x for x in rest]]]

    def encode(self, text: str) -> list[int]:
        return [i for x in self.words(text) for i in (x[1] if self.printed else x)]


_ENCODERS: dict[tuple[str, str, int, bool], TextEncoder] = {}


def encoder(path: str, pattern: str, pieces: int = PIECES, printed: bool = False) -> TextEncoder:
    """One for each worker process."""
    key = (path, pattern, pieces, printed)
    if key not in _ENCODERS:
        _ENCODERS[key] = TextEncoder(*key)
    return _ENCODERS[key]


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids array<int>. path: the rank file, at the same place on every node."""

    def run(batches):
        own = encoder(path or public_tokenizers.path(VOCABULARY), pattern)
        for part in small(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([own.encode(x or "") for x in part.column(1).to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.selectExpr("doc_id", "cast(text as string) text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, data binary, of doc_id and ids array<int>."""

    def run(batches):
        own = encoder(path or public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.bpe.decode(x or ()) for x in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, data binary")


def tokens(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids array<int> and decoded_sha256, the digest of the decoded ids."""

    def run(batches):
        own = encoder(path or public_tokenizers.path(VOCABULARY), pattern)
        for part in small(batches):
            ids = [own.encode(x or "") for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([hashlib.sha256(own.bpe.decode(x)).hexdigest() for x in ids], pa.string())], names=["doc_id", "ids", "decoded_sha256"])

    return docs.selectExpr("doc_id", "cast(text as string) text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded_sha256 string")


def digests(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, pieces: int = DIGEST_PIECES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes, then decodes the ids, without shipping the ids."""

    def run(batches):
        own = encoder(path or public_tokenizers.path(VOCABULARY), pattern, pieces, True)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in small(batches):
            counts, ids, texts = [], [], []
            for x in batch.column(1).to_pylist():
                found = own.words(x or "")
                tokens = [i for f in found for i in f[1]]
                counts.append(len(tokens))
                ids.append(sha(" ".join([f[0] for f in found]).encode()))
                texts.append(sha(own.bpe.decode(tokens)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("doc_id", "cast(text as string) text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


SQL = None  # no SQL form; tests hold it against the tiktoken library
