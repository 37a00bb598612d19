"""N-gram Jaccard join of whole documents with a token-group matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import components, stored, texts
from .kernels import Banding, mix, shingles, slices, words
from .similarity import link_components


def sets_of_batch(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text of a column, in order."""
    for _, _, data, begin in slices(column):
        found = words(data, begin)
        hashes = found.hashes()
        for i in range(len(begin) - 1):
            yield np.unique(shingles(hashes[found.first[i] : found.first[i + 1]], k))


def shingle_features(docs: DataFrame, k: int, banding: Banding) -> DataFrame:
    """(doc_id, n, k1, k2, bands): size, 128-bit hash and band keys of each document's shingle set."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k1, k2, bands = [], [], [], []
            for own in sets_of_batch(batch.column("text"), k):
                n.append(len(own))
                k1.append(int(mix(own).sum(dtype=np.uint64).view(np.int64)))
                k2.append(int(mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
                bands.append(banding.keys(own) if len(own) else np.zeros(0, np.int64))
            lengths = np.cumsum([0, *map(len, bands)])
            flat = pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64))
            arrays = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), flat)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "k1", "k2", "bands"])

    return docs.select("doc_id", "text").mapInArrow(features, "doc_id long, n long, k1 long, k2 long, bands array<long>")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(id, tokens): the distinct shingle hashes of each document."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = list(sets_of_batch(batch.column("text"), k))
            lengths = np.cumsum([0, *map(len, own)])
            flat = pa.array((np.concatenate(own) if own else np.zeros(0, np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), flat)], ["id", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(sets, "id long, tokens array<long>")


def jaccard_components(
    docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, banding: Banding = Banding(40, 4), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    The set of a document is its distinct shingles of ``k`` words (A-Z lower-cased; a shorter text has its whole
    sequence as the only shingle), as 64-bit hashes. Documents of Jaccard similarity >= num / den are linked;
    component_id is the smallest doc_id reachable by links. Equal sets collapse into a class first. Classes
    are partitioned into groups by MinHash bands and joined through a token-group matrix (module ``similarity``). Two
    classes of the least similarity miss all bands with probability (1 - s**rows)**bands, below 1e-9 for the default
    and for Banding(20, 4) at 0.9; links are verified exactly.

    Null and empty texts have no shingles and link with nothing. Rows that share an id are one document that has
    the links of all its texts; n_shingles is the row's own. A row with a null id is a component with a null id and
    links nothing. An empty table gives no rows.
    """
    given = texts(docs, id_col, text_col)
    features = stored(shingle_features(given, k, banding))
    some = features.where("n > 0 AND doc_id IS NOT NULL")
    classes = stored(some.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("other"), F.first("bands").alias("bands")))
    members = stored(classes.select(F.explode("bands").alias("key"), F.col("rep").alias("id")))

    def sets_of(ids: DataFrame) -> DataFrame:
        return shingle_sets(given.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi"), k)

    near = link_components(members, sets_of, num, den)
    # A copy belongs to its class's representative, whose component was found.
    equal = some.join(classes.where("rep < other").select("k1", "k2", "n", "rep"), ["k1", "k2", "n"])
    tied = stored(equal.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct())
    # With ids that are not repeated, each is in one class; one in several ties them together.
    several = classes.select(F.col("rep").alias("x")).union(tied.select("a")).groupBy("x").agg(F.count("*").alias("c")).where("c > 1")
    if several.isEmpty():
        copies = tied.join(near, tied["b"] == near["node"], "left").select(F.col("a").alias("node"), F.coalesce("component", "b").alias("component"))
        of = near.union(copies)
    else:
        of = components(near.toDF("a", "b").union(tied))
    return features.join(stored(of), features["doc_id"] == F.col("node"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )
