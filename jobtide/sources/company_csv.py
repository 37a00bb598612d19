"""Company master data as CSV: import with per-outcome counts, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import text
from ..operators.tables import insert_ignore, patch
from ..session import cut_lineage

IMPORT_FIELDS = ("industry", "website", "jobs_page_url", "contact_email", "founded_year")

# Words a header must contain to name a field, first rule wins.
HEADER_RULES = (
    (("linkedin", "company", "id"), "linkedin_company_id"),
    (("company", "name"), "company_name"),
    (("industry",), "industry"),
    (("founded", "year"), "founded_year"),
    (("website",), "website"),
    (("jobs", "page"), "jobs_page_url"),
    (("contact", "email"), "contact_email"),
)

# Export headers and the columns below them.
EXPORT_COLUMNS = (
    ("LinkedIn Company ID", "linkedin_company_id"),
    ("Company Name", "name"),
    ("Industry", "industry"),
    ("Founded Year", "founded_year"),
    ("Website", "website"),
    ("Jobs Page URL", "jobs_page_url"),
    ("Contact Email", "contact_email"),
    ("Bedrijfswebsite (AI)", "bedrijfswebsite"),
    ("Jobspagina (AI)", "jobspagina"),
    ("Email HR (AI)", "email_hr"),
    ("Email HR Bron (AI)", "email_hr_bron"),
    ("Email Algemeen (AI)", "email_algemeen"),
    ("Bedrijfsomschrijving (AI)", "bedrijfsomschrijving"),
    ("AI Enriched", "ai_enriched"),
)


PLACE = "place"
_ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in the low 33 bits


def field_of_header(header: str) -> str | None:
    low = header.strip().lower()
    return next((field for words, field in HEADER_RULES if all(w in low for w in words)), None)


def read_company_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """The rows of one or more files with ``place``, their order: files by name, rows as in their file."""
    raw = spark.read.csv(path, header=True, sep=sep, encoding=encoding, multiLine=True, quote='"', escape='"')
    # A file may hold line breaks in cells, so one task reads it from the start: its row numbers ascend.
    path = F.col("_metadata.file_path").alias("_path")
    files = raw.select(path).distinct().withColumn("_file", F.row_number().over(W.orderBy("_path")).cast("long"))
    rows = raw.select(*[F.col(f"`{c}`") for c in raw.columns], path, F.monotonically_increasing_id().alias("_row"))
    # The number of the file before the row's number in its partition: a long, where the path would be most of a row.
    place = F.shiftleft("_file", _ROW_BITS) + F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    placed = rows.join(F.broadcast(files), "_path")
    return name_import_columns(placed.select(*[F.col(f"`{c}`") for c in raw.columns], place.alias(PLACE)))


def name_import_columns(raw: DataFrame) -> DataFrame:
    """Columns renamed by the header rules; the first column is the company id, the last of several
    headers with one meaning wins, a missing one reads as null. ``place``, the order of the rows, stays."""
    headers = [c for c in raw.columns if c != PLACE]
    chosen = {field_of_header(h): h for h in headers}
    columns = {"linkedin_company_id": F.col(f"`{headers[0]}`")}
    for field in ("company_name", *IMPORT_FIELDS):
        columns[field] = F.col(f"`{chosen[field]}`") if field in chosen else F.lit(None).cast("string")
    return raw.select(*[v.cast("string").alias(k) for k, v in columns.items()], *([PLACE] if PLACE in raw.columns else []))


def classify_import(rows: DataFrame, companies: DataFrame, master: DataFrame) -> DataFrame:
    """Cleaned import rows with the company they hit and an ``outcome``."""
    cleaned = rows.select(
        text.spreadsheet_id(F.col("linkedin_company_id")).alias("linkedin_company_id"),
        "company_name",
        *[text.blank_to_null(text.strip(F.col(f))).alias(f) for f in IMPORT_FIELDS if f != "founded_year"],
        text.digits_as_int(F.col("founded_year")).alias("founded_year"),
        *([PLACE] if PLACE in rows.columns else []),
    )
    known = companies.where(F.col("linkedin_company_id").isNotNull()).groupBy("linkedin_company_id").agg(
        F.min("id").alias("company_id")
    )
    has_master = master.select("company_id").distinct().withColumn("_has_master", F.lit(True))
    # What is known of a company is put together first, so the rows take part in one join, by the id that the file gives.
    known = known.join(has_master, "company_id", "left")
    has_data = F.coalesce(*[F.col(f).cast("string") for f in IMPORT_FIELDS]).isNotNull()
    outcome = (
        F.when(F.col("linkedin_company_id").isNull(), "skipped")
        .when(F.col("company_id").isNull(), "company_not_found")
        .when(~has_data, "skipped")
        .when(F.col("_has_master"), "master_data_updated")
        .otherwise("master_data_created")
    )
    return (
        cleaned.join(known, "linkedin_company_id", "left")
        .withColumn("outcome", outcome)
        .drop("_has_master")
    )


def import_stats(classified: DataFrame) -> DataFrame:
    def n(*names: str) -> Column:
        return F.count_if(F.col("outcome").isin(*names))

    return classified.agg(
        F.count("*").alias("total_rows"),
        n("skipped").alias("skipped_rows"),
        F.count("company_id").alias("companies_found"),
        n("company_not_found").alias("companies_not_found"),
        n("master_data_created").alias("master_data_created"),
        n("master_data_updated").alias("master_data_updated"),
    )


def apply_import(classified: DataFrame, master: DataFrame) -> DataFrame:
    """Master data after the import: filled cells overwrite, blanks do not, unknown companies are added.

    Rows of one company are applied in the order of ``place``, so of each field the last filled cell stays. Rows without a ``place`` have no order; there
    the largest value of a field stays.
    """
    hits = classified.where(F.col("outcome").startswith("master_data"))
    last = {f: F.max_by(f, F.when(F.col(f).isNotNull(), F.col(PLACE))) if PLACE in hits.columns else F.max(f) for f in IMPORT_FIELDS}
    merged = cut_lineage(hits.groupBy("company_id").agg(*[v.alias(f) for f, v in last.items()]))
    updated = patch(_with_import_columns(master), merged, "company_id")
    return insert_ignore(updated, merged, ["company_id"])


def _with_import_columns(master: DataFrame) -> DataFrame:
    missing = {f: F.lit(None).cast("int" if f == "founded_year" else "string") for f in IMPORT_FIELDS if f not in master.columns}
    return master.withColumns(missing) if missing else master


def export_rows(companies: DataFrame, master: DataFrame, search: str | None = None) -> DataFrame:
    """One line per company in name order with the export headers; missing cells are ''."""
    kept = companies.where(F.col("name").ilike(f"%{search}%")) if search else companies
    left = kept.select("id", "linkedin_company_id", "name")
    right = master.withColumnRenamed("id", "_master_id").drop("linkedin_company_id", "name")
    joined = left.join(right, left["id"] == right["company_id"], "left")
    cells = []
    for header, column in EXPORT_COLUMNS:
        if column == "ai_enriched":
            cell = F.when(F.col("ai_enriched"), "Yes").otherwise("No")
        elif column in joined.columns:
            cell = F.coalesce(F.col(column).cast("string"), F.lit(""))
        else:
            cell = F.lit("")
        cells.append(cell.alias(header))
    return joined.orderBy("name", "id").select(*cells)


def write_export(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)
