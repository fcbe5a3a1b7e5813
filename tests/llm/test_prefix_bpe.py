import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from heronry.llm import prefix_bpe as M

PATH = public_tokenizers.path(M.VOCABULARY)


@pytest.fixture(scope="module")
def own():
    return M.TextEncoder(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=M.load_ranks(PATH), special_tokens={})


def test_encodes_as_the_library(own, library, documents):
    rng = random.Random(4)
    strange = ["".join(rng.choice(" aabe'st\n\té東1" + chr(rng.randrange(32, 0x3000))) for _ in range(rng.randrange(80))) for _ in range(400)]
    for text in [t for _, t in documents] + strange + ["", " ", "aaaa" * 500, "<|endoftext|>"]:
        assert own.encode(text) == library.encode_ordinary(text)
        assert own.bpe.decode(own.encode(text)) == text.encode()


def test_append_and_edit_keep_the_table_exact(own, library):
    rng = random.Random(5)
    piece = M.Piece(own.bpe, b"un")
    for _ in range(40):
        at = rng.randrange(len(piece.data) + 1)
        stop = min(len(piece.data), at + rng.randrange(4))
        piece.edit(at, stop, bytes(rng.choice(b"abcdeinrst") for _ in range(rng.randrange(6))))
        piece.append(rng.choice([b"ing", b"ed", b"x"]))
        assert piece.ids() == library._encode_single_piece(piece.data)
        n = rng.randrange(1, len(piece.data) + 1)
        assert piece.ids(n) == library._encode_single_piece(piece.data[:n])


def test_query(spark, sf_dir, library, documents):
    got = {r.doc_id: r for r in M.op2_prefix_bpe(spark, sf_dir).collect()}
    for i, t in documents:
        ids = library.encode_ordinary(t)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_odd_rows(odd, none, library):
    for r in M.digests(odd).where("doc_id IN (2, 3)").collect():
        assert (r.n_tokens, r.ids_sha256) == (0, hashlib.sha256(b"").hexdigest())
    assert M.decode(M.encode(odd)).count() == odd.count() and M.digests(none).count() == 0 and M.tokens(none).count() == 0
