"""Raw posting snapshots: scan, typing, quarantine, projection to table rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import salary, text
from ..schemas import INDEED_ITEM, LINKEDIN_ITEM

ITEM_SCHEMAS = {"linkedin": LINKEDIN_ITEM, "indeed": INDEED_ITEM}
# Required fields in the order in which their absence is reported.
REQUIRED = {
    "linkedin": ("job_posting_id", "job_title", "company_name", "job_location", "url"),
    "indeed": ("jobid", "url"),
}
# What a missing field of the second source reads as.
INDEED_DEFAULTS = {
    "job_title": "Untitled Position",
    "company_name": "Unknown Company",
    "location": "Unknown Location",
    "description_text": "",
}


def read_snapshot(spark: SparkSession, path: str, source: str, lines: bool = False) -> DataFrame:
    """Items of landed JSON files, in order of file time, file name and place in the file (``arrival``).

    A file holds one JSON array, read by one task, or with ``lines`` one item per line, which large
    files need to be split over tasks.
    """
    items = spark.read.schema(ITEM_SCHEMAS[source]).option("multiLine", not lines).json(path)
    return in_arrival_order(with_file_place(items))


_PLACE = ("_file_time", "_file_path", "_file_block")
_ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in the low 33 bits


def with_file_place(items: DataFrame) -> DataFrame:
    """The rows of a file scan (or stream) with the time, name and block of their file."""
    m = "_metadata"
    return items.select(
        "*", F.col(f"{m}.file_modification_time").alias(_PLACE[0]), F.col(f"{m}.file_path").alias(_PLACE[1]), F.col(f"{m}.file_block_start").alias(_PLACE[2])
    )


def in_arrival_order(items: DataFrame) -> DataFrame:
    """Replace the columns of :func:`with_file_place` by ``arrival``, a number in order of time, name, block and row.

    Spark deals files to partitions by size, so the partition says nothing about the order. A block is read by one task in order; the
    blocks are ranked (one row per block of a file) and the rank is put before the row's number inside its partition.
    """
    numbered = items.withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
    ranked = items.select(*_PLACE).distinct().withColumn("_rank", F.row_number().over(W.orderBy(*_PLACE)).cast("long"))
    joined = numbered.join(ranked, list(_PLACE))
    return joined.withColumn("arrival", F.shiftleft("_rank", _ROW_BITS) + F.col("_row")).drop(*_PLACE, "_row", "_rank")


def parse_items(df: DataFrame, column: str, source: str) -> DataFrame:
    """The same items when each row holds one as JSON text; other columns stay."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.from_json(F.col(column), ITEM_SCHEMAS[source]).alias("_i")).select(*rest, "_i.*")


def is_error_item() -> Column:
    return F.col("error").isNotNull() | F.col("error_code").isNotNull()


def drop_error_items(items: DataFrame) -> DataFrame:
    return items.where(~is_error_item())


def item_counts(items: DataFrame) -> DataFrame:
    return items.agg(
        F.count_if(~is_error_item()).alias("jobs"), F.count_if(is_error_item()).alias("errors_filtered")
    )


def type_records(items: DataFrame, source: str) -> DataFrame:
    """Aliases, defaults and lenient dates of the source's record model."""
    if source == "linkedin":
        return items.withColumns(
            {
                "url": F.coalesce("url", "job_url"),
                "job_posted_date": F.col("job_posted_date").try_cast("timestamp"),
            }
        )
    if source == "indeed":
        fixed = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in INDEED_DEFAULTS.items()}
        return items.withColumns({**fixed, "date_posted_parsed": F.col("date_posted_parsed").try_cast("timestamp")})
    raise ValueError(f"Unknown source: {source}")


def with_error(records: DataFrame, source: str) -> DataFrame:
    """Adds ``record_error``: the first missing required field, or null for a valid record."""
    checks = [
        F.when(F.col(f).isNull(), F.lit(f"Field '{f}': Field required")) for f in REQUIRED[source]
    ]
    return records.withColumn("record_error", F.coalesce(*checks))


def split_valid(records: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """(valid records, quarantined records with ``record_error``)."""
    marked = with_error(records, source)
    return marked.where(F.col("record_error").isNull()).drop("record_error"), marked.where(
        F.col("record_error").isNotNull()
    )


def _linkedin_salary() -> dict[str, Column]:
    given, parsed = F.col("base_salary"), salary.pay_range_columns(F.col("job_base_pay_range"))
    fields = {
        "salary_currency": "currency", "base_salary_min": "min_amount", "base_salary_max": "max_amount",
        "salary_period": "payment_period",
    }
    has_any = reduce(lambda a, b: a | b, [given[f].isNotNull() for f in fields.values()])
    use_struct = given.isNotNull() & has_any
    return {c: F.when(use_struct, given[f]).otherwise(parsed[c]) for c, f in fields.items()}


def posting_columns(source: str) -> dict[str, Column]:
    """Posting row fields of a typed record, keyed by table column."""
    none = F.lit(None)
    empty = F.array().cast("array<string>")
    if source == "linkedin":
        return {
            "linkedin_job_id": F.col("job_posting_id"),
            "indeed_job_id": none.cast("string"),
            "source": F.lit("linkedin"),
            "title": F.col("job_title"),
            "seniority_level": F.col("job_seniority_level"),
            "employment_type": F.col("job_employment_type"),
            "industries": text.split_list(F.col("job_industries"), keep_blanks=True),
            "function_areas": F.when(
                F.coalesce(F.col("job_function"), F.lit("")) != "", F.array("job_function")
            ).otherwise(empty),
            "posted_date": F.col("job_posted_date"),
            "posted_time_ago": F.col("job_posted_time"),
            "num_applicants": F.col("job_num_applicants"),
            **_linkedin_salary(),
            "job_url": F.col("url"),
            "apply_url": F.col("apply_link"),
            "application_available": F.col("application_availability"),
        }
    return {
        "linkedin_job_id": none.cast("string"),
        "indeed_job_id": F.col("jobid"),
        "source": F.lit("indeed"),
        "title": F.col("job_title"),
        "seniority_level": none.cast("string"),
        "employment_type": F.col("job_type"),
        "industries": empty,
        "function_areas": empty,
        "posted_date": F.col("date_posted_parsed"),
        "posted_time_ago": F.col("date_posted"),
        "num_applicants": none.cast("int"),
        **salary.formatted_salary_columns(F.col("salary_formatted")),
        "job_url": F.col("url"),
        "apply_url": F.col("apply_link"),
        "application_available": F.coalesce(F.col("apply_link") != "", F.lit(False)),
    }


def description_columns(source: str) -> dict[str, Column]:
    if source == "linkedin":
        return {
            "summary": F.col("job_summary"),
            "full_description_html": F.col("job_description_formatted"),
            "full_description_text": text.html_to_text(F.col("job_description_formatted")),
        }
    benefits = F.when(F.size("benefits") > 0, F.concat(F.lit("Benefits: "), F.array_join("benefits", ", ")))
    wanted = F.when(F.col("qualifications") != "", F.concat(F.lit("Qualifications: "), F.col("qualifications")))
    return {
        "summary": text.blank_to_null(F.concat_ws(" | ", benefits, wanted)),
        "full_description_html": F.coalesce(
            text.blank_to_null(F.col("job_description_formatted")), F.col("description")
        ),
        "full_description_text": F.col("description_text"),
    }


def poster_column(source: str) -> Column:
    """Poster struct, null unless it has a name; only one source has posters."""
    shape = "struct<name:string,title:string,profile_url:string>"
    if source != "linkedin":
        return F.lit(None).cast(shape)
    p = F.col("job_poster")
    return F.when(
        p["name"] != "", F.struct(p["name"].alias("name"), p["title"].alias("title"), p["url"].alias("profile_url"))
    ).cast(shape)


def company_source_columns(source: str) -> dict[str, Column]:
    none = F.lit(None).cast("string")
    if source == "linkedin":
        return text.company_columns(F.col("company_name"), F.col("company_id"), F.col("company_url"), F.col("company_logo"), none)
    return text.company_columns(F.col("company_name"), none, F.col("company_website"), F.col("logo_url"), none)


def location_string(source: str) -> Column:
    if source == "linkedin":
        return F.col("job_location")
    return F.coalesce(text.blank_to_null(F.col("job_location")), F.col("location"))


def to_ingest_rows(valid: DataFrame, source: str) -> DataFrame:
    """Valid typed records in the one shape the ingest plan reads, whatever their source."""
    return valid.select(
        "arrival",
        F.col("job_posting_id" if source == "linkedin" else "jobid").alias("source_job_id"),
        location_string(source).alias("location_string"),
        F.struct(*[v.alias(k) for k, v in company_source_columns(source).items()]).alias("company"),
        F.struct(*[v.alias(k) for k, v in posting_columns(source).items()]).alias("posting"),
        F.struct(*[v.alias(k) for k, v in description_columns(source).items()]).alias("description"),
        poster_column(source).alias("poster"),
    )
