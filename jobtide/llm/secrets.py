"""Secret scan: pattern spans plus corpus-wide ownership frequency of the values found."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from .common import stored, texts


@dataclass(frozen=True)
class Kind:
    """A pattern; ``value`` is the group that holds the secret, ``least`` its smallest length. ``needs`` are
    patterns that the value must match too. ``base`` kinds are reported whatever their frequency."""

    name: str
    pattern: str
    value: int = 0
    least: int = 1
    needs: tuple[str, ...] = ()
    base: bool = True


# For access keys and hex runs the smallest length is part of the pattern: a run is matched whole or not at all,
# so this finds what matching first and dropping short runs afterwards would leave.
KINDS = (
    Kind("assign", r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Kind("access", r"AKIA[A-Z0-9]{16,}"),
    Kind("hex", r"[0-9a-f]{24,}"),
    Kind("mixed", r"[A-Za-z0-9_+/-]{20,}", 0, 20, ("[0-9]", "[a-z]", "[A-Z]"), base=False),
)


def secret_spans(
    docs: DataFrame, owner_col: str = "source", repository_cols: tuple[str, ...] = ("source", "lang"),
    id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS, copied_from: int = 3,
) -> DataFrame:
    """One row per document: ``doc_id`` and ``spans``, an array of structs ordered by start and kind.

    A span has start, kind_no, end (code points, end exclusive), kind, base, value_sha256, n_repositories, n_owners
    and verdict. The frequencies count the distinct repositories and owners of the value's hash over the whole
    corpus: a value of ``copied_from`` owners or more is a copied example, one of a single owner is live-looking,
    anything between is shared. Spans of base kinds are always reported; those of the other kinds only where the
    value is live-looking.

    Positions come from the lengths of the pieces between matches, summed per document over the match rows only.
    Owners and repositories are made distinct in two combined aggregations, so a value found everywhere costs one
    row per owner and task. Null texts count as empty; null owners or repositories are one owner or repository;
    documents without a span have an empty array. Rows that share an id are scanned apart and give a row each.
    """
    named = {f"_r{i}": c for i, c in enumerate(repository_cols)}
    given = texts(docs, id_col, text_col, _owner=owner_col, **named)
    text = F.col("text")
    found = []
    for no, kind in enumerate(kinds):
        matches = F.arrays_zip(
            F.transform(F.split(text, kind.pattern, -1), F.char_length).alias("gap"),
            F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("match"),
            F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.value)).alias("value"),
        )
        found.append(F.when(text.rlike(kind.pattern), matches).alias(f"k{no}"))
    scanned = stored(
        given.select(
            "doc_id", F.coalesce(F.col("_owner").cast("string"), F.lit("")).alias("owner"),
            F.to_json(F.array(*[F.col(c).cast("string") for c in named])).alias("repository"), *found,
        ).withColumn("row", F.monotonically_increasing_id())
    )
    parts = []
    for no, kind in enumerate(kinds):
        before = W.partitionBy("row").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
        one = (
            scanned.where(F.col(f"k{no}").isNotNull())
            .select("row", "owner", "repository", F.posexplode(f"k{no}").alias("i", "m"))
            .select("row", "owner", "repository", "i", "m.*", F.char_length("m.match").alias("length"))
            .withColumn("start", (F.coalesce(F.sum(F.col("gap") + F.col("length")).over(before), F.lit(0)) + F.col("gap")).cast("long"))
            .where(F.col("match").isNotNull() & (F.char_length("value") >= kind.least))
        )
        for pattern in kind.needs:
            one = one.where(F.col("value").rlike(pattern))
        parts.append(
            one.select(
                "row", "owner", "repository", "start", F.lit(no).alias("kind_no"), (F.col("start") + F.col("length")).alias("end"),
                F.lit(kind.name).alias("kind"), F.lit(kind.base).alias("base"), F.sha2("value", 256).alias("value_sha256"),
            )
        )
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    every = stored(every)
    by_repository = every.groupBy("value_sha256", "owner", "repository").agg(F.lit(1).alias("one"))
    by_owner = by_repository.groupBy("value_sha256", "owner").agg(F.sum("one").alias("n"))
    # A repository may have several owners: count it once per value.
    repositories = by_repository.groupBy("value_sha256", "repository").agg(F.lit(1).alias("one"))
    use = stored(
        by_owner.groupBy("value_sha256").agg(F.count("*").alias("n_owners"))
        .join(repositories.groupBy("value_sha256").agg(F.count("*").alias("n_repositories")), "value_sha256")
    )
    verdict = F.when(F.col("n_owners") >= copied_from, "copied").when(F.col("n_owners") == 1, "live").otherwise("shared")
    judged = every.join(use, "value_sha256").withColumn("verdict", verdict).where(F.col("base") | (F.col("verdict") == "live"))
    fields = ("start", "kind_no", "end", "kind", "base", "value_sha256", "n_repositories", "n_owners", "verdict")
    per_row = judged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("spans"))
    none = F.array().cast(per_row.schema["spans"].dataType)
    return scanned.select("row", "doc_id").join(per_row, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))
