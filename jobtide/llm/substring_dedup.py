"""Substring deduplication: paragraph MinHash banding with exact verification and removal by components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import passing, stored, texts
from .jaccard_join import shingle_sets
from .kernels import Banding, shingles, slices, words
from .similarity import link_components

K = 5


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of each run of ``width`` neighbours, by doubling."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = pick(out[:-step], out[step:]) if len(out) > step else out[:0]
        done += step
    return out


def anchors(grams: np.ndarray, first: np.ndarray, window: int, length: int) -> np.ndarray:
    """First words of the content-defined paragraphs of some texts: where a run of five words has the smallest hash of
    ``window`` neighbouring runs and ``length`` words follow. Any run of window + length - 1 words that two texts share
    has such a paragraph, the same in both, wherever it stands. Text i has the words first[i] to first[i + 1];
    ``grams`` has the hash of the run at each word, over all texts."""
    if len(grams) < window:
        return np.zeros(0, np.int64)
    low = _sliding(grams, window, np.minimum).copy()
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    stop = first[1:][text]
    at = np.arange(len(low))
    low[at + window + K - 1 > stop[: len(low)]] = 0  # windows that leave the text choose nothing
    # The smallest of some window: equal to the largest minimum of the windows around it.
    padded = np.concatenate([np.zeros(window - 1, np.uint64), low, np.zeros(window - 1, np.uint64)])
    best = _sliding(padded, window, np.maximum)
    chosen = np.flatnonzero((grams == best) & (best > 0))
    return chosen[chosen + length <= stop[chosen]]


def paragraphs(docs: DataFrame, length: int, window: int, banding: Banding) -> DataFrame:
    """(doc_id, start, stop, p1, p2, line, bands, left, right, reach): the paragraphs of each text, in code points.

    A paragraph is a line of ``length`` words or more, with band keys, or a content-defined piece of ``length`` words
    (no bands), which also finds passages inside longer lines. Equal ones of a text are given each. ``right`` is a hash of the words from
    a piece to the end of the next one of the text, which is at ``reach``, and ``left`` of those from the one before; 0 where there is none.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for row, _, data, begin in slices(batch.column("text")):
                found = words(data, begin)
                if len(found.starts) < length:
                    continue
                hashes, first = found.hashes(), found.first
                text = np.repeat(np.arange(len(first) - 1), np.diff(first))
                # A run that crosses into the next text or line is never used.
                size = len(hashes) - K + 1
                grams = shingles(hashes, K) if size > 0 else np.zeros(0, np.uint64)
                line_of = np.searchsorted(np.flatnonzero(data == 10), found.starts)
                heads = np.flatnonzero((np.diff(line_of, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
                ends = np.append(heads[1:], len(hashes))
                long = ends - heads >= length
                heads, ends = heads[long], ends[long]
                pieces = anchors(grams, first, window, length)
                starts, stops = np.concatenate([heads, pieces]), np.concatenate([ends, pieces + length])
                if not len(starts):
                    continue
                line = np.arange(len(starts)) < len(heads)
                p1, p2 = found.content(hashes, starts, stops)
                left, right, reach = np.zeros((3, len(starts)), np.int64)
                if len(pieces) > 1:
                    # Neighbours among the pieces: the run of words from one to the end of the next, in one text.
                    own = np.flatnonzero(text[pieces[:-1]] == text[pieces[1:]])
                    link = found.content(hashes, pieces[own], pieces[own + 1] + length)[0]
                    right[len(heads) + own], left[len(heads) + own + 1] = link, link
                bands = np.zeros((len(starts), banding.bands), np.int64)
                if len(heads):
                    bands[: len(heads)] = banding.keys_of_runs(grams, heads, ends - K + 1)
                owner = text[starts]
                point = np.zeros(len(data) + 1, np.int64)
                np.cumsum((data & 0xC0) != 0x80, out=point[1:])
                base = point[begin[owner]]
                numbers = np.where(line, banding.bands, 0)
                keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(numbers)]), pa.int32()), pa.array(bands[line].ravel()))
                ends_at = point[found.ends[stops - 1]] - base
                reach[:-1] = np.where(right[:-1] != 0, ends_at[1:], 0)
                columns = [ids[row + owner], point[found.starts[starts]] - base, ends_at, p1, p2, line]
                names = ["doc_id", "start", "stop", "p1", "p2", "line", "bands", "left", "right", "reach"]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), keys, *map(pa.array, (left, right, reach))], names)

    return docs.select("doc_id", "text").mapInArrow(
        cut, "doc_id long, start long, stop long, p1 long, p2 long, line boolean, bands array<long>, left long, right long, reach long")


def windows_near(places: DataFrame, given: DataFrame, length: int, reach: int) -> DataFrame:
    """(doc_id, start, stop, p1, p2): every run of ``length`` words that starts at most ``reach`` words from a place (doc_id, start, before,
    behind), on the sides that these flags ask for, with a 128-bit hash of its words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            asked = batch.column("places")
            begins, flat = asked.offsets.to_numpy(), asked.values.field("start").to_numpy(zero_copy_only=False)
            before, behind = (reach * asked.values.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("before", "behind"))
            for row, to, data, begin in slices(batch.column("text")):
                found = words(data, begin)
                hashes, first = found.hashes(), found.first
                point = np.zeros(len(data) + 1, np.int64)
                np.cumsum((data & 0xC0) != 0x80, out=point[1:])
                base, heads = point[begin[:-1]], point[found.starts]
                own = begins[row : to + 1]
                text = np.repeat(np.arange(to - row), np.diff(own))
                here = np.s_[own[0] : own[-1]]
                at = np.searchsorted(heads, flat[here] + base[text])
                # Starts from ``reach`` before to ``reach`` behind a place, inside its text.
                lo, hi = np.maximum(at - before[here], first[text]), np.minimum(at + behind[here], first[text + 1] - length) + 1
                some = lo < hi
                near = np.zeros(len(hashes) + 1, np.int64)
                np.add.at(near, lo[some], 1)
                np.add.at(near, hi[some], -1)
                starts = np.flatnonzero(np.cumsum(near) > 0)
                if not len(starts):
                    continue
                stops = starts + length
                p1, p2 = found.content(hashes, starts, stops)
                owner = np.searchsorted(first, starts, "right") - 1
                columns = [ids[row + owner], heads[starts] - base[owner], point[found.ends[stops - 1]] - base[owner], p1, p2]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["doc_id", "start", "stop", "p1", "p2"])

    asked = stored(places.groupBy("doc_id").agg(F.collect_set(F.struct("start", "before", "behind")).alias("places")))
    return given.join(asked, "doc_id").mapInArrow(cut, "doc_id long, start long, stop long, p1 long, p2 long")


def _against_first(places: DataFrame, by: list[str]) -> DataFrame:
    """Places (doc_id, start, stop) with the first one of their class, for classes of two documents or more, and ``removed``: all but the
    first, and but those in its document that overlap it."""
    first = places.groupBy(*by).agg(F.min(F.struct("doc_id", "start", "stop")).alias("first"), F.max("doc_id").alias("hi"))
    # Stored, so that the join is one of plain tables, which adaptive execution splits where a class is hot.
    several = stored(first.where("first.doc_id < hi").select(*by, "first"))
    gone = (F.col("doc_id") != F.col("first.doc_id")) | (F.col("start") >= F.col("first.stop"))
    return places.join(several, by).select(
        *[c for c in by if c == "line"], "doc_id", "start", "stop", F.col("first.doc_id").alias("keep_id"), F.col("first.start").alias("keep_start"), gone.alias("removed")
    )


def _joined(spans: Column) -> Column:
    """Sorted (start, stop) spans, joined where they touch or overlap."""
    last = lambda a: F.try_element_at(a, F.lit(-1))
    join = lambda a, x: F.when(
        (F.size(a) > 0) & (last(a)["stop"] >= x["start"]),
        F.concat(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["stop"], x["stop"]).alias("stop")))),
    ).otherwise(F.concat(a, F.array(x)))
    return F.aggregate(spans, F.array().cast("array<struct<start:bigint,stop:bigint>>"), join)


def _runs(rows: DataFrame) -> DataFrame:
    """Windows of one alignment that touch or overlap, as one row."""
    by = ["doc_id", "keep_id", "shift", "removed"]
    order = W.partitionBy(*by).orderBy("start", "stop")
    aligned = rows.select("doc_id", "keep_id", (F.col("start") - F.col("keep_start")).alias("shift"), "removed", "start", "stop")
    apart = F.coalesce(F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1)) < F.col("start"), F.lit(True))
    numbered = aligned.withColumn("apart", apart.cast("long")).withColumn("run", F.sum("apart").over(order.rowsBetween(W.unboundedPreceding, 0)))
    run = numbered.groupBy(*by, "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return run.select("doc_id", "start", "stop", "keep_id", (F.col("start") - F.col("shift")).alias("keep_start"), "removed")


def repeated_paragraphs(
    docs: DataFrame, length: int = 24, window: int = 27, num: int = 4, den: int = 5, banding: Banding = Banding(10, 3),
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per paragraph that occurs in two documents or more: doc_id, start, stop (code points), keep_id,
    keep_start and removed.

    Paragraphs that are equal form a class by a 128-bit hash. Classes of lines are joined by MinHash bands, tuned for
    recall (ten bands of three rows find a pair of similarity 0.8 with probability 0.999), and linked where the exact Jaccard
    similarity of their five-word shingles is num / den or more; the components of the links are the clusters. An equal piece
    that all its places continue alike goes on to the end of the next one. Where they differ, every run of ``length`` words on
    that side is compared by hash in turn, with all documents that have it there, so equal text is found to its end whichever
    document shares how much of it. The first place of a cluster or run, by doc_id and
    start, is kept; all others are removed, also those in one document, but for places that overlap the kept one. Runs
    that follow one another beside the same kept text are one row. A repeat inside one document only is not reported.

    With the defaults every run of 50 words that two documents share holds a paragraph that both have, and all of it is removed
    from the later one. Null and
    short texts have no paragraphs. Rows with a null id are left out; rows that share an id are one document. An empty
    table gives no rows.
    """
    given = texts(docs, id_col, text_col).where("doc_id IS NOT NULL")
    with passing() as keep:
        occurrences = _occurrences(given, length, window, num, den, banding)
        rows = keep(stored(_against_first(occurrences.select("doc_id", "start", "stop", "line", "cluster"), ["cluster", "line"])))
        # A word of a shared run of ``window + length - 1`` words lies between two of its pieces, or in a run of ``length`` words that
        # starts less than ``window`` from one of them.
        edges = occurrences.where(~F.col("line") & (F.col("before") | F.col("behind"))).select("doc_id", "start", "before", "behind")
        near = keep(stored(windows_near(edges, given, length, window - 1)))
    around = _against_first(near, ["p1", "p2"])
    return rows.where("line").drop("line").distinct().unionByName(_runs(rows.where("NOT line").drop("line").unionByName(around)))


def _occurrences(given: DataFrame, length: int, window: int, num: int, den: int, banding: Banding) -> DataFrame:
    """(doc_id, start, stop, line, cluster, before, behind), stored: the paragraphs of clusters and repeated classes, pieces that go on alike up
    to the end of the next one, and the sides on which others differ."""
    with passing() as keep:
        found = stored(paragraphs(given, length, window, banding))
        # One line of each class stands for it in the bands, under a 64-bit id.
        lines = found.where("line")
        classes = stored(lines.groupBy("p1", "p2").agg(F.first("bands").alias("bands"), F.min(F.struct("doc_id", "start", "stop")).alias("at")))
        members = stored(classes.select(F.explode("bands").alias("key"), F.col("p1").alias("id")))

        def sets_of(ids: DataFrame) -> DataFrame:
            at = classes.join(ids, classes["p1"] == ids["id"], "left_semi").select("p1", "at.*")
            own = F.expr("substring(text, int(start) + 1, int(stop - start))").alias("text")
            return shingle_sets(given.join(at, "doc_id").select(F.col("p1").alias("doc_id"), own), K)

        near = link_components(members, sets_of, num, den)
        # Only repeated classes go on: pieces and lines of one document have no partner.
        alike = lambda c: (F.min(c) == F.max(c)) & (F.min(c) != 0)
        kept = found.groupBy("p1", "p2", "line").agg(
            F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), (~alike("left")).alias("before"), (~alike("right")).alias("behind")
        )
        several = kept.where("lo < hi OR line")  # only lines have near copies
        named = several.join(near, several["line"] & (several["p1"] == near["node"]), "left").where("lo < hi OR component IS NOT NULL")
        cluster = F.struct(F.coalesce("component", "p1").alias("a"), F.when(F.col("component").isNull(), F.col("p2")).alias("b"), "line")
        named = stored(named.select("p1", "p2", "line", cluster.alias("cluster"), "before", "behind"))
        places = found.select("doc_id", "start", "stop", "p1", "p2", "line", "reach").join(named, ["p1", "p2", "line"])
        goes_on = F.when(F.col("line") | F.col("behind"), F.col("stop")).otherwise(F.col("reach")).alias("stop")
        return keep(stored(places.select("doc_id", "start", goes_on, "line", "cluster", "before", "behind")))


def removals(repeated: DataFrame) -> DataFrame:
    """One row per document that loses text: doc_id, spans ("start:end,...", joined where they touch or overlap),
    n_paragraphs, removed_chars and keep_ids, the documents that keep the text."""
    gone = repeated.where("removed").groupBy("doc_id").agg(
        F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("s"), F.sort_array(F.collect_set("keep_id")).alias("keep_ids"), F.count("*").alias("n_paragraphs")
    )
    merged = gone.withColumn("m", _joined(F.col("s")))
    return merged.select(
        "doc_id", F.array_join(F.transform("m", lambda x: F.concat_ws(":", x["start"], x["stop"])), ",").alias("spans"), "n_paragraphs",
        F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"]).alias("removed_chars"), "keep_ids",
    )
