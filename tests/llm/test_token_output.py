"""Round trips of the coder and of whole tables."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from jobtide.llm import codec, token_output

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 3000), st.sampled_from([1, 3, 60, 5000, 65536]), st.booleans())
def test_blocks_round_trip(seed, n, kinds, runs):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, kinds, n).astype(np.int32) % 65536
    if runs:
        ids = np.tile(ids[: max(1, n // 9)], 12)
    starts = np.unique(np.concatenate([[0], rng.integers(0, len(ids), 5)]))
    totals = np.diff(np.append(starts, len(ids)))
    names = [None if rng.random() < 0.2 else int(rng.integers(-(2**62), 2**62)) for _ in starts]
    blocks = codec.write_blocks(ids, starts, names, totals)
    back = codec.read_blocks(blocks)
    assert np.array_equal(np.concatenate([b[0] for b in back]), ids)
    assert [d for b in back for d in b[1]] == names and [t for b in back for t in b[3]] == totals.tolist()
    at = 0
    for b, data in zip(back, blocks):  # each block can be read alone
        alone = codec.read_blocks([data])[0]
        assert np.array_equal(alone[0], ids[at : at + len(b[0])])
        at += len(b[0])


def test_compression_and_damage():
    rng = np.random.default_rng(1)
    ids = (rng.zipf(1.3, 30_000) % 49_000).astype(np.int32)
    blocks = codec.write_blocks(ids, np.array([0]), [1], np.array([len(ids)]))
    assert sum(map(len, blocks)) < 0.85 * 2 * len(ids)
    phrase = np.tile(rng.integers(0, 49_000, 50), 600).astype(np.int32)
    assert sum(map(len, codec.write_blocks(phrase, np.array([0]), [1], np.array([30_000])))) < 0.35 * 2 * len(phrase)
    for place in (3, len(blocks[0]) // 2, len(blocks[0]) - 9, 30):
        bad = bytearray(blocks[0])
        bad[place] ^= 16
        with pytest.raises((ValueError, MemoryError)):
            codec.read_blocks([bytes(bad)])
    with pytest.raises(ValueError):
        codec.read_blocks([blocks[0][:-4]])
    with pytest.raises(ValueError):
        codec.write_blocks(np.array([65536]), np.array([0]), [1], np.array([1]))


def test_crc_join():
    rng = random.Random(3)
    for _ in range(50):
        a, b = rng.randbytes(rng.randrange(300)), rng.randbytes(rng.randrange(70_000))
        assert token_output.join_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


ODD = [
    "Hello, World's  end here x\u0085y", "a\x1cb \x01 c", "É é Σ ΣΑΣ ὈΔΥΣΣΕΎΣ", "", None, "<|endoftext|> x<|startoftext|>", "don't WE'LL 123 4.5\n\n\ttabs", "😀👍🏽 中文 字",
    "́start ́x", "x" * 5000, " ", "​zero​width ﻿", "İstanbul ŞİŞ ß ẞ ǅ",
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_words_encode_like_whole_texts(tokenizer):
    own = token_output.Encoder(PATH)
    rng = random.Random(4)
    pieces = [w for t in ODD if t for w in t.split(" ")] + ["\n", "\t", "\r\n", "\x0b", "\x1f", " ", "　", "\x85", "Σ", "ͅ", "'s", "'S"]
    texts = [t or "" for t in ODD] + ["".join(rng.choice(pieces) + rng.choice(["", " ", "  "]) for _ in range(rng.randrange(12))) for _ in range(400)]
    for _ in range(2):
        ids, numbers = own.encode(texts)
        at = 0
        for t, n in zip(texts, numbers):
            assert ids[at : at + n].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)
            at += n
        assert at == len(ids)


def test_table(docs_of, tokenizer, monkeypatch):
    rows = [(i * 7 % 101 - 20, t) for i, t in enumerate(ODD * 3)] + [(500, "many words in a long text " * 3000), (500, "twin"), (None, "no id"), (None, None)]
    docs = docs_of(rows)
    for shards in (1, 5):
        blocks = token_output.write_tokens(docs, PATH, 1, shards=shards)
        got = sorted(map(tuple, token_output.read_tokens(blocks).collect()), key=lambda r: r[1])
        want = []
        for i, t in rows:
            ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
            want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        assert sorted([(r[0], r[2], r[3]) for r in got], key=str) == sorted(want, key=str)
        start = 0
        for r in got:
            assert r[1] == start
            start += r[2]
        assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
        assert max(r[4] for r in got) > 2
    none = token_output.write_tokens(docs.limit(0), PATH, 1)
    assert none.count() == 0 and token_output.read_tokens(none).count() == 0
