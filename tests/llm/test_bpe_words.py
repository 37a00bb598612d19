"""Encoding by distinct words against the tokenizers library on whole texts."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from jobtide.llm import bpe_words

PATH = public_tokenizers.path("word_bpe_49k.json")


def library(texts):
    own = Tokenizer.from_file(PATH)
    own.no_truncation()
    own.no_padding()
    ids = [own.encode(t or "", add_special_tokens=False).ids for t in texts]
    return [(i, own.decode(i, skip_special_tokens=False)) for i in ids]


def found(df):
    rows = bpe_words.encode_and_decode(df, PATH).collect()
    assert all(len(r["ids"]) == r["n_tokens"] for r in rows)
    return sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in rows), key=repr)


def expected(rows):
    return sorted(((r[0], *x) for r, x in zip(rows, library([r[1] for r in rows]))), key=repr)


ODD = [
    "", " ", "\n\t ", "The the THE don't we'll 's 'S x's", "a<|endoftext|>b <|startoftext|> c", "word\x01mark \x01 and \x1cfile\x1dgroup\x85next\xa0space em　wide",
    "é ́ àb İstanbul ΣΣ ẞ Å", "你好世界 123 4567 \U0001f600\U0001f468‍\U0001f469", "x" * 5000 + " " + "ab'sc" * 500, " a  ﻿ \x00 z\x7f",
    "$$$ --- ?!... {a:b}[c]", "\r\nline\r\nline\x0bv\x0cf",
]


def test_equals_the_library(docs_of):
    rows = list(enumerate(ODD)) + [(50, None), (51, "the " * 3000), (None, "no id at all"), (None, None), (7, "repeated id"), (7, "repeated id")]
    assert found(docs_of(rows)) == expected(rows)


def test_many_small_chunks(docs_of, monkeypatch):
    rows = [(i, f"shared words here {i % 7} and own{i} été{i * 31} {'very ' * (i % 5)}") for i in range(300)]
    for name, value in (("CHUNK_BYTES", 200), ("PART_WORDS", 9), ("PACK_ROWS", 20)):
        monkeypatch.setattr(bpe_words, name, value)
    # Functions go to the workers with the module's own values, so the small sizes are tried here, without Spark's workers.
    import pyarrow as pa

    out = list(bpe_words._chunk_rows(pa.chunked_array([pa.array([t for _, t in rows])]), [i for i, _ in rows], b"0:0:", 4))
    assert sum(r["n"] for r in out if r["key"] >= 0) == sum(len(t.split()) for _, t in rows)
    assert [d for r in out if r["key"] >= 0 for d in r["doc_ids"]] == [i for i, _ in rows]
    words = {}
    for batch in bpe_words._entries(iter([pa.RecordBatch.from_pylist(out, bpe_words._CHUNK_SCHEMA)])):
        words |= dict(zip(batch.column("code").to_pylist(), batch.column("word").to_pylist()))
    back = [words[c] for r in out if r["key"] >= 0 for c in bpe_words._from_planes(r["codes"], r["n"])]
    assert back == [w for _, t in rows for w in t.split()]
    assert len(words) == len(set(words.values()))
    assert found(docs_of(rows)) == expected(rows)


def test_empty_table_and_foreign_tokenizers(docs_of):
    assert found(docs_of([])) == []
    assert found(docs_of([(1, None)])) == [(1, [], "")]
    with pytest.raises(ValueError):
        bpe_words.check_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))


def test_an_input_that_changes_between_reads_is_an_error():
    import pyarrow as pa

    left = pa.Table.from_pylist([dict(key=5, chunk=5, part=0, doc_ids=[1], counts=[1], n=1, codes=bpe_words._planes(__import__("numpy").array([0])), size=1, words=None)], bpe_words._CHUNK_SCHEMA)
    pack = pa.struct([("n", pa.int32()), ("codes", pa.binary()), ("sizes", pa.binary()), ("n_ids", pa.int32()), ("ids", pa.binary())])
    right = pa.table({c: pa.array([], t) for c, t in {"key": pa.int64(), "id": pa.int32(), "packs": pa.list_(pack), "piece": pa.string()}.items()})
    with pytest.raises(RuntimeError):
        bpe_words._assemble(left, right)
