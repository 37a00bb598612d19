"""BPE encoding and decoding of whole texts by a table of distinct words.

Texts are split at white space into words, and each chunk of documents keeps its words as numbers into a dictionary of its own
distinct words. The dictionaries of all chunks meet by word, each distinct word is encoded once, and the ids go back
to (chunk, number), from where they take the places of the words. Ids become text again through a join with the
table of (id, piece).

One shuffle deals out both halves of a chunk: its numbers under the chunk's key, its words under the key of their bucket. What is
sent is one dictionary entry per chunk and word, so a frequent word weighs as little as any other.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shuffle_width
from .common import texts

CHUNK_BYTES = 16_000_000  # texts whose words share a dictionary; one longer text is a chunk of its own
SPLIT_BYTES = 2_000_000  # texts split at a time
PART_WORDS = 250_000  # words written and read back at a time
PACK_ROWS = 1_000_000  # dictionary entries that a task holds while it encodes (about 100 bytes each)
_MARK = "\x01"
_TOKENIZERS: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a file, without truncation and padding, once per process."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.no_truncation()
        own.no_padding()
        _TOKENIZERS[path] = own
    return _TOKENIZERS[path]


def plain_ids(own, text: str) -> list[int]:
    return own.encode(text, add_special_tokens=False).ids


def check_tokenizer(path: str) -> None:
    """Raise ValueError where the ids of a text are not those of its words, or where decoding does more than put a space between pieces."""
    own = tokenizer(path)
    for probe in ("  One two's\tthree,\n\n4 x ", "a \x0b b\r\n\x0cc", "É é ́ ß . . 's 's"):
        words = [i for w in probe.encode().split() for i in plain_ids(own, w.decode())]
        if words != plain_ids(own, probe):
            raise ValueError(f"{path}: white space matters to this tokenizer, so words cannot be encoded apart")
    if own.decoder is not None:
        raise ValueError(f"{path}: a decoder changes the pieces, so text is not its pieces with spaces between")


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece): the vocabulary with its added tokens, whose size the tokenizer file fixes."""
    rows = sorted((i, p) for p, i in tokenizer(path).get_vocab(with_added_tokens=True).items())
    return spark.createDataFrame(pa.table([pa.array([i for i, _ in rows], pa.int32()), pa.array([p for _, p in rows])], names=["id", "piece"]))


def encode_words(own, words: list[str], mark: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(ids end to end, number of ids of each word). Words are encoded many at a time, a mark after each."""
    flat, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for row in range(0, len(words), 16_384):
        some = words[row : row + 16_384]
        joined = [f" {_MARK} ".join(some[i : i + 64]) + f" {_MARK}" for i in range(0, len(some), 64)]
        ids = np.array([i for e in own.encode_batch_fast(joined, add_special_tokens=False) for i in e.ids], np.int32)
        stops = np.flatnonzero(ids == mark[0]) if len(mark) == 1 else ()
        if len(stops) == len(some):
            flat.append(np.delete(ids, stops))
            sizes.append(np.diff(stops, prepend=-1) - 1)
        else:  # some word has the mark's own id: one by one
            each = [plain_ids(own, w) for w in some]
            flat.append(np.array([i for x in each for i in x], np.int32))
            sizes.append(np.array([len(x) for x in each], np.int64))
    return np.concatenate(flat), np.concatenate(sizes)


def _spread(flat: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(runs end to end, their sizes): the runs number ``at`` of ``flat``, which has runs of ``sizes``."""
    own = sizes[at]
    ends = np.cumsum(own)
    starts = (np.cumsum(sizes) - sizes)[at]
    return flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - own), own)], own


def _planes(codes: np.ndarray) -> bytes:
    """Numbers by planes of bytes, compressed: the small numbers of frequent words leave the high planes empty."""
    raw = codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return pa.compress(raw, "zstd", asbytes=True) if raw else b""


def _from_planes(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    raw = pa.decompress(data, 4 * n, "zstd", asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


# key: of a chunk (0 or more) or, below 0, of a bucket of words. part: place within the chunk. doc_ids, counts: documents and their numbers of
# words. n, codes: how many numbers, and these. size: words of the chunk's dictionary. words: joined by line feeds, for bucket rows.
CHUNKS = "key long, chunk long, part int, doc_ids array<long>, counts array<int>, n int, codes binary, size int, words binary"


def _slices(column: pa.ChunkedArray) -> Iterator[pa.Array]:
    """The texts, about SPLIT_BYTES at a time."""
    for array in column.chunks:
        ends = np.cumsum(pc.binary_length(array).to_numpy(zero_copy_only=False).astype(np.int64))
        row = 0
        while row < len(array):
            to = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + SPLIT_BYTES, "right")))
            yield array.slice(row, to - row)
            row = to


def _chunk_rows(column: pa.ChunkedArray, docs: list[int | None], name: bytes, buckets: int) -> Iterator[dict]:
    flats, counts = [], []
    for some in _slices(column):
        split = pc.ascii_split_whitespace(some)
        flat = split.flatten()
        edges = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))])
        real = pc.greater(pc.binary_length(flat), 0)
        counts.append(np.diff(np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False).astype(bool))])[edges]))
        flats.append(flat.filter(real))
    counts = np.concatenate(counts)
    coded = [c for c in pa.chunked_array(flats, pa.string()).dictionary_encode().unify_dictionaries().chunks if len(c)]
    index = np.concatenate([np.zeros(0, np.int32), *(c.indices.to_numpy() for c in coded)])
    words = coded[0].dictionary if coded else pa.array([], pa.string())
    del flats, flat, split, coded
    # The more frequent, the smaller the number.
    order = np.argsort(-np.bincount(index, minlength=len(words)), kind="stable")
    number = np.empty(len(words), np.int32)
    number[order] = np.arange(len(words), dtype=np.int32)
    codes = number[index]
    listed = words.cast(pa.binary()).to_pylist()
    digest = hashlib.blake2b(name, digest_size=8)
    for w in listed:
        digest.update(w + b"\n")
    # The key holds the content, so words never meet the numbers of another run of this task.
    chunk = int.from_bytes(digest.digest(), "little") >> 2
    row, ends = 0, np.cumsum(counts)
    part = 0
    while row < len(docs):
        base = int(ends[row - 1]) if row else 0
        to = max(row + 1, int(np.searchsorted(ends, base + PART_WORDS, "right")))
        own = codes[base : int(ends[to - 1])]
        yield dict(key=chunk, chunk=chunk, part=part, doc_ids=docs[row:to], counts=counts[row:to].tolist(), n=len(own), codes=_planes(own), size=len(words), words=None)
        row, part = to, part + 1
    bucket = np.fromiter((zlib.crc32(w) % buckets for w in listed), np.int64, len(listed))
    inside = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[inside], prepend=-1))
    for a, z in zip(cuts, [*cuts[1:], len(inside)]):
        own = sorted((listed[i], number[i]) for i in inside[a:z])
        joined = b"\n".join(w for w, _ in own)
        yield dict(key=-1 - int(bucket[inside[a]]), chunk=chunk, part=None, doc_ids=None, counts=None, n=len(own), codes=_planes(np.array([c for _, c in own])), size=len(joined),
                   words=pa.compress(joined, "zstd", asbytes=True))


_CHUNK_SCHEMA = pa.schema([("key", pa.int64()), ("chunk", pa.int64()), ("part", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())),
                           ("n", pa.int32()), ("codes", pa.binary()), ("size", pa.int32()), ("words", pa.binary())])


def chunks(docs: DataFrame, buckets: int) -> DataFrame:
    """The documents as chunks: rows of word numbers, and rows of dictionary words by bucket (see CHUNKS)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, made = [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, made
            given = pa.Table.from_batches(held)
            name = b"%d:%d:" % (TaskContext.get().partitionId(), made)
            held, size, made = [], 0, made + 1
            out = []
            for row in _chunk_rows(given.column("text"), given.column("doc_id").to_pylist(), name, buckets):
                out.append(row)
                if len(out) >= 64:
                    yield pa.RecordBatch.from_pylist(out, _CHUNK_SCHEMA)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, _CHUNK_SCHEMA)
            del given, out
            pa.default_memory_pool().release_unused()  # the worker lives on

        for batch in batches:
            sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
            start = 0
            while start < batch.num_rows:
                ends = np.cumsum(sizes[start:])
                take = max(1, int(np.searchsorted(ends, CHUNK_BYTES - size, "right")))
                held.append(batch.slice(start, take))
                size += int(ends[take - 1])
                start += take
                if size >= CHUNK_BYTES or start < batch.num_rows:
                    yield from flush()
        if held:
            yield from flush()

    return docs.mapInArrow(split, CHUNKS)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, code, word) of the rows that hold words."""
    for batch in batches:
        for row in batch.filter(pc.less(batch.column("key"), 0)).to_pylist():
            words = pa.decompress(row["words"], row["size"], "zstd", asbytes=True).split(b"\n") if row["size"] else [b""]
            codes = _from_planes(row["codes"], row["n"])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), row["chunk"])), pa.array(codes, pa.int32()), pa.array(words, pa.binary()).cast(pa.string())], ["chunk", "code", "word"])


# n entries of one chunk's dictionary: their numbers, how many ids each has, and the n_ids ids; used: these ids, each once.
PACKS = "key long, n int, codes binary, sizes binary, n_ids int, ids binary, used array<int>"
_PACK_SCHEMA = pa.schema([("key", pa.int64()), ("n", pa.int32()), ("codes", pa.binary()), ("sizes", pa.binary()), ("n_ids", pa.int32()), ("ids", pa.binary()), ("used", pa.list_(pa.int32()))])


def _encode(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        mark = plain_ids(own, _MARK)
        last: tuple[str, np.ndarray] | None = None

        def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal last
            given = pa.Table.from_batches(held)
            coded = given.column("word").combine_chunks().dictionary_encode()
            coded = pa.concat_arrays(coded.chunks) if isinstance(coded, pa.ChunkedArray) else coded
            words = coded.dictionary.to_pylist()
            # Rows come sorted by word: only the first one may have been encoded before.
            known = last is not None and words[0] == last[0]
            flat, sizes = encode_words(own, words[1:] if known else words, mark)
            if known:
                flat, sizes = np.concatenate([last[1], flat]), np.concatenate([[len(last[1])], sizes])
            last = words[-1], flat[len(flat) - int(sizes[-1]) :]
            chunk = given.column("chunk").to_numpy()
            order = np.argsort(chunk, kind="stable")
            ids, counts = _spread(flat, sizes, coded.indices.to_numpy()[order])
            edges = np.append(np.flatnonzero(np.diff(chunk[order], prepend=-1)), len(order))
            ends, codes = np.concatenate([[0], np.cumsum(counts)]), given.column("code").to_numpy()[order]
            out = []
            for a, z in zip(edges, edges[1:]):
                some = ids[ends[a] : ends[z]]
                out.append(dict(key=int(chunk[order[a]]), n=int(z - a), codes=_planes(codes[a:z]), sizes=_planes(counts[a:z]), n_ids=len(some), ids=_planes(some), used=np.unique(some).tolist()))
            return pa.RecordBatch.from_pylist(out, _PACK_SCHEMA)

        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= PACK_ROWS:
                yield packed(held)
                held, rows = [], 0
        if held:
            yield packed(held)
        pa.default_memory_pool().release_unused()

    return encode


def _assemble(left: pa.Table, right: pa.Table) -> pa.Table:
    """Documents of one chunk: their numbers (``left``) replaced by the ids of the packs, and the ids by the pieces joined to them (``right``)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
    if not left.num_rows or left.column("key")[0].as_py() < 0:
        return schema.empty_table()
    size = left.column("size")[0].as_py()
    packs = [p for r in right.filter(pc.is_valid(right.column("packs"))).column("packs").to_pylist() for p in r]
    codes = np.concatenate([np.zeros(0, np.int64), *(_from_planes(r["codes"], r["n"]) for r in packs)])
    own = np.concatenate([np.zeros(0, np.int64), *(_from_planes(r["sizes"], r["n"]) for r in packs)])
    ids = np.concatenate([np.zeros(0, np.int64), *(_from_planes(r["ids"], r["n_ids"]) for r in packs)])
    if len(codes) != size:
        raise RuntimeError("words of a chunk are missing: the input gave other rows when it was read again")
    by_code = np.argsort(codes)
    flat, sizes = _spread(ids, own, by_code)
    # One piece per id, as the join gave it.
    joined = right.select(["id", "piece"]).filter(pc.is_valid(right.column("piece"))).combine_chunks()
    used, first = np.unique(joined.column("id").to_numpy(), return_index=True)
    piece = joined.column("piece").take(pa.array(first)).cast(pa.large_string()).combine_chunks()
    piece = piece.chunk(0) if isinstance(piece, pa.ChunkedArray) else piece
    index = np.searchsorted(used, flat).astype(np.int32)
    del right, joined, ids, flat, packs
    out = []
    for row in sorted(left.drop_columns(["words"]).to_pylist(), key=lambda r: r["part"]):
        at, own = _spread(index, sizes, _from_planes(row["codes"], row["n"]))
        counts = np.array(row["counts"], np.int64)
        ends = np.concatenate([[0], np.cumsum(own)])[np.concatenate([[0], np.cumsum(counts)])]
        words = pa.LargeListArray.from_arrays(pa.array(ends), piece.take(pa.array(at)))
        listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(used[at], pa.int32()))
        decoded = pc.binary_join(words, pa.scalar(" ", pa.large_string())).cast(pa.string())
        out.append(pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(np.diff(ends)), listed, decoded], schema=schema))
    pa.default_memory_pool().release_unused()
    return pa.Table.from_batches(out, schema)


def encode_and_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row: the ids of the whole text, as the tokenizers library gives them without
    special tokens of its own, truncation and padding, and the text that its decode gives for them, special tokens included.

    ``path`` is a tokenizer file in whose texts white space only parts words, and which decodes by putting a space between pieces
    (check_tokenizer raises ValueError otherwise). Null texts count as empty: no ids, and an empty text. Rows
    with a null id or a repeated id are rows of their own. An empty table gives no rows. A text may be of any length below 2 GB; it is in one chunk, and a
    task holds one chunk. Frequent words and equal texts, however many, are one dictionary entry per chunk.
    """
    check_tokenizer(path)
    spark = docs.sparkSession
    width = shuffle_width(spark)
    parts = chunks(texts(docs, id_col, text_col), 4 * width).repartition(width, "key")
    entries = parts.mapInArrow(_entries, "chunk long, code int, word string")
    packs = entries.sortWithinPartitions("word").mapInArrow(_encode(path), PACKS).repartition(width, "key")
    # The packs of a chunk, and each id that they use, in rows of their own; both are bounded by the chunk's dictionary.
    pack = F.struct("n", "codes", "sizes", "n_ids", "ids")
    dictionary = packs.groupBy("key").agg(F.collect_list(pack).alias("packs"), F.array_distinct(F.flatten(F.collect_list("used"))).alias("used"))
    whole = F.array(F.struct(F.lit(None).cast("int").alias("id"), F.col("packs").alias("packs")))
    each = F.transform("used", lambda x: F.struct(x.alias("id"), F.lit(None).cast(dictionary.schema["packs"].dataType).alias("packs")))
    rows = dictionary.select("key", F.inline(F.concat(whole, each)))
    table = pieces(spark, path).toDF("piece_id", "piece")
    known = rows.join(F.broadcast(table), F.col("id") == F.col("piece_id"), "left").drop("piece_id")
    schema = "doc_id long, n_tokens long, ids array<int>, decoded string"
    return parts.groupBy("key").cogroup(known.groupBy("key")).applyInArrow(_assemble, schema)
