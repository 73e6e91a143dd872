from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from arbelo.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def oracle():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def test_random_texts_encode_as_the_library_does(oracle):
    e, rng = bpe.Encoder(bpe.load_ranks(PATH), public_tokenizers.PATTERN), random.Random(3)
    parts = ["the", "ing", "a", "É", "²", "1", " ", "  ", "\n", "\t", "'s", "'", "!", "_", "\x00", "\x85", "\xa0", "中", "🙂", "　", "́"]
    for k in range(1500):
        s = "".join(rng.choice(parts[: 17 if k % 2 else len(parts)]) for _ in range(rng.randint(0, 60)))
        packed = e.pack(s)
        assert np.frombuffer(packed, "<u4").tolist() == oracle.encode_ordinary(s)
        assert e.unpack(packed) == s.encode()


def test_long_pieces_use_several_levels_of_the_tree(oracle):
    e = bpe.Encoder(bpe.load_ranks(PATH), public_tokenizers.PATTERN)
    rng = random.Random(4)
    for n in (15, 16, 17, 255, 256, 257, 5000):
        s = "".join(rng.choice("abcdefgh") for _ in range(n))
        assert np.frombuffer(e.pack(s), "<u4").tolist() == oracle.encode_ordinary(s)


def test_byte_outside_the_vocabulary():
    with pytest.raises(ValueError):
        bpe.merge_piece(b"ab", {b"a": 0})


def test_odd_rows(spark, odd, none, oracle):
    rows = bpe.digest(odd, PATH, public_tokenizers.PATTERN).collect()
    texts = [r.text or "" for r in odd.select("text").collect()]
    want = sorted((len(i := oracle.encode_ordinary(t)), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for t in texts)
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    assert bpe.digest(none, PATH, public_tokenizers.PATTERN).count() == 0


def test_round_trip_keeps_columns(odd):
    encoded = bpe.encode(odd, PATH, public_tokenizers.PATTERN)
    assert encoded.columns == [*odd.columns, "token_ids"]
    back = bpe.decode(encoded, PATH)
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in back.collect())
