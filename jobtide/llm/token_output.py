"""Token ids as range-coded binary blocks, in order of doc_id, and the reader of that format."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..session import shuffle_width
from . import codec
from .common import stored, texts

MOST_WORDS = 150_000  # words whose ids a worker remembers
GROUP_IDS = 2_000_000  # ids coded at a time: memory of a task
_MARK = "\x01"
# Characters on which str.split and the white space of the tokenizer's patterns may differ, and the mark itself.
_ODD = re.compile("[\x01\x1c-\x1f]")
_ENCODERS: dict[str, "Encoder"] = {}


class Encoder:
    """Ids of texts by a tokenizer of the tokenizers library that drops white space and never joins across it, so the ids of a
    text are those of its words one after the other. The ids of words met before are remembered; a text with characters that
    this does not hold for is encoded whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self._plain(_MARK)
        self.clear()

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.flat = [np.zeros(0, np.int32)]
        self.starts = [np.zeros(0, np.int64)]
        self.sizes = [np.zeros(0, np.int64)]
        self.total = 0

    def _remember(self, fresh: list[str]) -> None:
        chunks = [f" {_MARK} ".join(fresh[i : i + 50]) + f" {_MARK}" for i in range(0, len(fresh), 50)]
        ids = np.array([i for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False) for i in e.ids], np.int32)
        stops = np.flatnonzero(ids == self.mark[0])
        if len(self.mark) != 1 or len(stops) != len(fresh):  # a word that holds the mark's own id: one by one
            parts = [np.array(self._plain(w), np.int32) for w in fresh]
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            own = np.concatenate(parts)
        else:
            sizes = np.diff(stops, prepend=-1) - 1
            own = np.delete(ids, stops)
        self.places.update(zip(fresh, range(len(self.places), len(self.places) + len(fresh))))
        self.starts.append(self.total + np.cumsum(sizes) - sizes)
        self.sizes.append(sizes)
        self.flat.append(own)
        self.total += len(own)
        self.starts, self.sizes, self.flat = ([np.concatenate(x)] for x in (self.starts, self.sizes, self.flat))

    def encode(self, given: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of ids of each text)."""
        if len(self.places) > MOST_WORDS:
            self.clear()
        odd = {i: np.array(self._plain(t), np.int32) for i, t in enumerate(given) if _ODD.search(t)}
        lists = [[] if i in odd else t.split() for i, t in enumerate(given)]
        fresh = set().union(*lists).difference(self.places) if lists else set()
        if fresh:
            self._remember(sorted(fresh))
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        get = self.places.__getitem__
        place = np.fromiter(map(get, chain.from_iterable(lists)), np.int64, int(counts.sum()))
        sizes = self.sizes[0][place]
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[0][place] - (ends - sizes), sizes)
        ids = self.flat[0][at]
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        numbers = np.diff(edges)
        for i, own in sorted(odd.items(), reverse=True):
            ids = np.concatenate([ids[: edges[i]], own, ids[edges[i] :]])
            numbers[i] = len(own)
        return ids, numbers


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _write(tokenizer: str, end_id: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, made, base = TaskContext.get().partitionId(), 0, 0
        own = encoder(tokenizer)
        ids: list[np.ndarray] = []
        docs: list[int | None] = []
        totals: list[int] = []
        starts: list[int] = []
        held = 0

        def flush(whole: bool) -> Iterator[pa.RecordBatch]:
            """Code what is held; unless ``whole``, the ids of an unfinished block stay."""
            nonlocal ids, docs, totals, starts, held, made, base
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            first = np.array(starts, np.int64)
            n = len(flat) if whole else len(flat) - len(flat) % codec.block_length(len(flat))
            cut = int(np.searchsorted(first, n))
            out = codec.write_blocks(flat[:n], first[:cut], docs[:cut], np.array(totals[:cut], np.int64))
            if out:
                length = codec.block_length(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(out), pa.int32()), pa.array(range(made, made + len(out)), pa.int64()), pa.array(base + length * np.arange(len(out))), pa.array(out, pa.binary())],
                    ["shard", "block", "ids_before", "data"],
                )
            made, base, held = made + len(out), base + n, len(flat) - n
            ids, docs, totals, starts = [flat[n:]], docs[cut:], totals[cut:], [int(x) - n for x in first[cut:]]

        for batch in batches:
            names, given = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            row = 0
            while row < len(given):
                # About a million characters at a time.
                to, size = row, 0
                while to < len(given) and size < 1_000_000:
                    size += len(given[to] or "")
                    to += 1
                flat, numbers = own.encode([t or "" for t in given[row:to]])
                stops = np.cumsum(numbers)
                flat = np.insert(flat, stops, end_id).astype(np.int32)
                numbers = numbers + 1
                ids.append(flat)
                docs += names[row:to]
                totals += numbers.tolist()
                starts += (held + np.cumsum(numbers) - numbers).tolist()
                held += len(flat)
                if held >= GROUP_IDS:
                    yield from flush(False)
                row = to
        yield from flush(True)
        own.clear()  # the worker lives on; its memory is for the next task

    return blocks


BLOCKS = "shard int, block long, ids_before long, data binary"


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """The stored blocks (shard, block, ids_before, data) of the ids of all texts, ``end_id`` after each text.

    Rows are dealt to shards by ranges of doc_id and sorted inside, so shards and blocks in order hold the ids in ascending
    doc_id (null first; rows that share an id next to each other, by text). A block starts from an empty model, has a checksum and
    an index of the documents that start in it, and can be read alone. Null texts count as empty: the end alone. A task
    holds about GROUP_IDS ids, or one text. An empty table gives no blocks.
    """
    given = texts(docs, id_col, text_col)
    width = shards or shuffle_width(docs.sparkSession)
    placed = given.repartitionByRange(width, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return stored(placed.mapInArrow(_write(tokenizer, end_id), BLOCKS))


def read_pieces(blocks: DataFrame) -> DataFrame:
    """(shard, doc_at, doc_id, n_tokens, block, n, crc): the part of a document that a block holds. ``doc_at`` is the place of the
    document's first id in the shard; doc_id and n_tokens are null but in the block where it starts; the first piece of a block that
    starts inside a document has a null doc_at."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, batch.num_rows, codec.LANES):
                part = batch.slice(row, codec.LANES)
                shards, numbers, before = (part.column(c).to_pylist() for c in ("shard", "block", "ids_before"))
                out: list[tuple] = []
                for shard, block, base, (ids, docs, starts, totals) in zip(shards, numbers, before, codec.read_blocks(part.column("data").to_pylist())):
                    raw = memoryview(ids.astype("<u4").tobytes())
                    edges = [*starts.tolist(), len(ids)]
                    if edges[0]:
                        out.append((shard, None, None, None, block, edges[0], zlib.crc32(raw[: 4 * edges[0]])))
                    for doc, a, z, total in zip(docs, edges, edges[1:], totals.tolist()):
                        out.append((shard, base + a, doc, total, block, z - a, zlib.crc32(raw[4 * a : 4 * z])))
                if out:
                    columns = [pa.array(c, pa.int64()) for c in zip(*out)]
                    columns[0] = columns[0].cast(pa.int32())
                    yield pa.RecordBatch.from_arrays(columns, ["shard", "doc_at", "doc_id", "n_tokens", "block", "n", "crc"])

    return blocks.mapInArrow(decode, "shard int, doc_at long, doc_id long, n_tokens long, block long, n long, crc long")


def _shift_matrix() -> list[list[int]]:
    """Operators on CRC-32 that append 2**k zero bytes."""
    one = [0xEDB88320] + [1 << i for i in range(31)]  # a zero bit
    out, m = [], one
    for k in range(64):
        if k >= 3:
            out.append(m)
        m = [_apply(m, v) for v in m]
    return out


def _apply(matrix: list[int], vector: int) -> int:
    total, i = 0, 0
    while vector:
        if vector & 1:
            total ^= matrix[i]
        vector >>= 1
        i += 1
    return total


_SHIFTS = _shift_matrix()


def join_crc(first: int, second: int, n_bytes: int) -> int:
    """CRC-32 of two strings end to end from theirs; ``n_bytes`` is the length of the second."""
    k = 0
    while n_bytes:
        if n_bytes & 1:
            first = _apply(_SHIFTS[k], first)
        n_bytes >>= 1
        k += 1
    return first ^ second


def read_tokens(blocks: DataFrame) -> DataFrame:
    """One row per document, read back from the blocks: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and
    n_pieces (the blocks it lies in).

    A document in one block is ready there. The pieces of one that goes on in further blocks are matched to it by place: within a
    shard, a piece without a document belongs to the last one that started before it.
    """
    pieces = stored(read_pieces(blocks))
    per_shard = pieces.groupBy("shard").agg(F.sum("n").alias("ids"))
    # One row per shard: bounded by the number of partitions that wrote the blocks.
    before = F.coalesce(F.sum("ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shards = per_shard.withColumn("shard_start", before).select("shard", "shard_start")
    whole = pieces.where("doc_at IS NOT NULL AND n = n_tokens")
    # A document that goes on is the last of its block; its later pieces open blocks that end at doc_at + n_tokens at most.
    heads = pieces.where("doc_at IS NOT NULL AND n < n_tokens").select("shard", "doc_at", "doc_id", "n_tokens", "block", "n", "crc")
    # Pieces without a document belong to the head with the largest block below theirs: carried down the shard's blocks.
    tails = pieces.where("doc_at IS NULL").select("shard", "doc_at", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_tokens"), "block", "n", "crc")
    # In a block the head comes after the piece that opens it, so it is carried on from the next block.
    parts = heads.unionByName(tails).withColumn("head", F.last("doc_at", True).over(
        W.partitionBy("shard").orderBy("block", F.col("doc_at").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    ))
    joined = parts.groupBy("shard", "head").agg(
        F.first("doc_id", True).alias("doc_id"), F.first("n_tokens", True).alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("block", "n", "crc"))).alias("parts"),
    )

    @F.pandas_udf(T.LongType())
    def crc_of(numbers: pd.Series, crcs: pd.Series) -> pd.Series:
        out = []
        for ns, cs in zip(numbers, crcs):
            crc = int(cs[0])
            for n, c in zip(ns[1:], cs[1:]):
                crc = join_crc(crc, int(c), 4 * int(n))
            out.append(crc)
        return pd.Series(out, dtype="int64")

    long = joined.select("shard", F.col("head").alias("doc_at"), "doc_id", "n_tokens", crc_of(F.col("parts.n"), F.col("parts.crc")).alias("crc"), F.size("parts").alias("n_pieces"))
    every = whole.select("shard", "doc_at", "doc_id", "n_tokens", "crc", F.lit(1).alias("n_pieces")).unionByName(long)
    return every.join(F.broadcast(shards), "shard").select(
        "doc_id", (F.col("shard_start") + F.col("doc_at")).alias("start"), "n_tokens", F.col("crc").alias("ids_crc32"), "n_pieces"
    )
