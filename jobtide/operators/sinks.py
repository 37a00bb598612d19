"""Results of outside classifiers and enrichers, turned into typed table changes.

Every function takes one row per result (key + JSON or text) and returns either the next table version
or the columns to be merged; a result that fails its check becomes an error text, not a lost row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import jsonx, text
from ..functions.dates import AsOf, instant, is_quota_error
from ..schemas import JOB_RESULT, LOCATION_RESULT_FIELDS, SIZE_CATEGORIES
from .tables import patch, update_from, upsert

# Stored column <- result field, for plain text fields and for lists.
JOB_TEXT = {
    "samenvatting_kort_en": "summary_short", "samenvatting_lang_en": "summary_long",
    "samenvatting_kort_nl": "summary_short_nl", "samenvatting_lang_nl": "summary_long_nl",
    "samenvatting_kort_fr": "summary_short_fr", "samenvatting_lang_fr": "summary_long_fr",
    "type_datarol": "data_role_type", "sourcing_type": "sourcing_type",
    "samenvatting_kort": "summary_short", "samenvatting_lang": "summary_long",
    "remote_work_policy": "remote_work_policy", "perk_remote_policy": "perk_remote_policy",
    "perk_salary_range": "perk_salary_range", "perk_company_car": "perk_company_car",
    "perk_hospitalization_insurance": "perk_hospitalization_insurance",
    "perk_training_budget": "perk_training_budget", "perk_team_events": "perk_team_events",
}
JOB_LISTS = {
    "rolniveau": "role_level", "seniority": "seniority", "contract": "contract",
    "must_have_programmeertalen": "must_have_languages", "nice_to_have_programmeertalen": "nice_to_have_languages",
    "must_have_ecosystemen": "must_have_ecosystems", "nice_to_have_ecosystemen": "nice_to_have_ecosystems",
    "must_have_talen": "must_have_spoken_languages", "nice_to_have_talen": "nice_to_have_spoken_languages",
}

# Stored column <- result paths, first filled one wins.
COMPANY_PATHS = {
    "bedrijfswebsite": ("website", "bedrijfswebsite"),
    "jobspagina": ("careers_page", "jobspagina"),
    "email_hr": ("email_hr",),
    "email_hr_bron": ("email_hr_bron",),
    "email_algemeen": ("email_algemeen",),
    "locatie_belgie": ("locatie_belgie",),
    "bedrijfsomschrijving_nl": ("description_nl", "bedrijfsomschrijving_nl"),
    "bedrijfsomschrijving_fr": ("description_fr", "bedrijfsomschrijving_fr"),
    "bedrijfsomschrijving_en": ("description_en", "bedrijfsomschrijving_en"),
    "sector_en": ("sector_en",),
    "sector_nl": ("sector_nl",),
    "sector_fr": ("sector_fr",),
    "hiring_model": ("hiring_model",),
    "hiring_model_en": ("hiring_model_en",),
    "hiring_model_nl": ("hiring_model_nl",),
    "hiring_model_fr": ("hiring_model_fr",),
    "aantal_werknemers": ("employee_count_range", "aantal_werknemers"),
    "weetjes": ("factlets", "weetjes"),
    "size_category": ("maturity_en", "maturity.category_en", "category.en", "category_en"),
    "category_en": ("maturity_en", "maturity.category_en", "category.en", "category_en"),
    "category_nl": ("maturity_nl", "maturity.category_nl", "category.nl", "category_nl"),
    "category_fr": ("maturity_fr", "maturity.category_fr", "category.fr", "category_fr"),
    "size_confidence": ("maturity.confidence", "confidence"),
    "size_key_arguments": ("key_arguments_en", "arguments_en", "maturity.key_arguments", "key_arguments"),
    "size_sources": ("maturity.sources", "sources"),
}

# Size category -> label in Dutch, English, French.
SIZE_LABELS = {
    "startup": ("Startup", "Startup", "Startup"),
    "scaleup": ("Scale-up", "Scale-up", "Scale-up"),
    "sme": ("KMO", "SME", "PME"),
    "established_enterprise": ("Gevestigde Onderneming", "Established Enterprise", "Entreprise Établie"),
    "corporate": ("Corporate", "Corporate", "Corporate"),
    "public_company": ("Beursgenoteerd Bedrijf", "Public Company", "Société Cotée"),
    "government": ("Overheid", "Government", "Gouvernement"),
    "unknown": ("Onbekend", "Unknown", "Inconnu"),
}

# Outdated size categories and their replacement.
OLD_SIZE_CATEGORIES = {
    "Midmarket": "established_enterprise", "Subsidiary": "established_enterprise",
    "midmarket": "established_enterprise", "subsidiary": "established_enterprise", "Scaleup": "scaleup",
}


def job_result_columns(results: DataFrame, payload: str, model_version: str, as_of: AsOf) -> DataFrame:
    """Enrichment columns of each (job_posting_id, payload JSON); unreadable JSON gives an error row."""
    parsed = results.withColumn("_r", F.from_json(F.col(payload), JOB_RESULT)).withColumn(
        "_ok", F.try_parse_json(F.col(payload)).isNotNull()
    )
    empty = F.array().cast("array<string>")
    labels = F.get_json_object(payload, "$.labels")

    def good(value: Column) -> Column:
        return F.when(F.col("_ok"), value)

    return parsed.select(
        "job_posting_id",
        *[good(F.col(f"_r.{f}")).alias(c) for c, f in JOB_TEXT.items()],
        *[good(F.coalesce(F.col(f"_r.{f}"), empty)).alias(c) for c, f in JOB_LISTS.items()],
        good(F.when(labels != "{}", labels)).alias("labels"),
        instant(as_of).alias("enrichment_completed_at"),
        F.when(~F.col("_ok"), F.lit("Invalid JSON in result")).alias("enrichment_error"),
        good(F.lit(model_version)).alias("enrichment_model_version"),
    )


def save_job_results(enrichment: DataFrame, postings: DataFrame, results: DataFrame, payload: str,
                     model_version: str, as_of: AsOf) -> tuple[DataFrame, DataFrame]:
    """(enrichment, postings): a good result replaces the enrichment columns, clears the error and asks
    for a new ranking; a bad one stores its error and time. Postings without an enrichment row are left."""
    new = job_result_columns(results, payload, model_version, as_of)
    good = F.col("src_enrichment_error").isNull()
    set_columns = {}
    for c in new.columns:
        if c == "job_posting_id":
            continue
        value = F.col(f"src_{c}")
        if c in enrichment.columns and c not in ("enrichment_completed_at", "enrichment_error"):
            value = F.when(good, value).otherwise(F.col(c))
        set_columns[c] = value
    saved = update_from(enrichment, new, ["job_posting_id"], set_columns)
    done = new.where("enrichment_error IS NULL").join(enrichment.select("job_posting_id"), "job_posting_id", "left_semi")
    marked = update_from(
        postings, done.select(F.col("job_posting_id").alias("id")).withColumn("again", F.lit(True)), ["id"],
        {"needs_ranking": F.col("src_again")},
    )
    return saved, marked


def company_result_columns(results: DataFrame, payload: str, as_of: AsOf) -> DataFrame:
    """Master-data columns of each (company_id, payload JSON) of any result version."""
    doc = F.col(payload)
    fields = {c: jsonx.first_filled(doc, *paths) for c, paths in COMPANY_PATHS.items()}
    fields["size_confidence"] = fields["size_confidence"].try_cast("double")
    return results.select(
        "company_id",
        *[v.alias(c) for c, v in fields.items()],
        F.lit(True).alias("ai_enriched"),
        instant(as_of).alias("ai_enriched_at"),
        F.lit(None).cast("string").alias("ai_enrichment_error"),
        F.when(fields["category_en"].isNotNull(), instant(as_of)).alias("size_enriched_at"),
    )


def save_company_results(master: DataFrame, results: DataFrame, payload: str, as_of: AsOf) -> DataFrame:
    """Upsert on company; nulls do not overwrite, except that the error is cleared."""
    new = company_result_columns(results, payload, as_of)
    return upsert(master, new, ["company_id"], keep_nulls=("ai_enrichment_error",))


def save_company_errors(master: DataFrame, errors: DataFrame, as_of: AsOf) -> DataFrame:
    """Failed attempts (company_id, error): not enriched, with text and time."""
    new = errors.select(
        "company_id", F.lit(False).alias("ai_enriched"), F.col("error").alias("ai_enrichment_error"),
        instant(as_of).alias("ai_enriched_at"),
    )
    return upsert(master, new, ["company_id"])


def save_location_results(locations: DataFrame, results: DataFrame, payload: str, as_of: AsOf) -> DataFrame:
    """Non-null result fields win; the row counts as enriched and its error is cleared."""
    doc = F.col(payload)
    new = results.select(
        "id", *[F.get_json_object(doc, f"$.{f}").alias(f) for f in LOCATION_RESULT_FIELDS if f in locations.columns]
    )
    marks = results.select("id", instant(as_of).alias("at"))
    return update_from(
        patch(locations, new, "id"), marks, ["id"],
        {
            "ai_enriched": F.lit(True), "ai_enriched_at": F.col("src_at"),
            "ai_enrichment_error": F.lit(None).cast("string"),
        },
    )


def size_result_columns(results: DataFrame, payload: str, as_of: AsOf) -> DataFrame:
    """Size classification of each (id, payload): checked fields, or the error text."""
    doc = F.col(payload)
    category = F.get_json_object(doc, "$.category")
    complete = category.isNotNull() & F.get_json_object(doc, "$.confidence").isNotNull() & F.get_json_object(
        doc, "$.summary"
    ).isNotNull()
    error = (
        F.when(F.coalesce(doc, F.lit("")) == "", "Empty response from LLM")
        .when(~complete, "Invalid response structure")
        .when(~category.isin(*SIZE_CATEGORIES), F.concat(F.lit("Invalid category: "), category))
    )
    ok = error.isNull()

    def good(value: Column) -> Column:
        return F.when(ok, value)

    return results.select(
        "id",
        good(category).alias("size_category"),
        good(F.get_json_object(doc, "$.confidence").try_cast("double")).alias("size_confidence"),
        *[good(F.get_json_object(doc, f"$.summary.{lang}")).alias(f"size_summary_{lang}") for lang in ("en", "nl", "fr")],
        good(F.coalesce(F.get_json_object(doc, "$.key_arguments"), F.lit("[]"))).alias("size_key_arguments"),
        good(F.coalesce(F.get_json_object(doc, "$.sources"), F.lit("[]"))).alias("size_sources"),
        instant(as_of).alias("size_enriched_at"),
        error.alias("size_enrichment_error"),
    )


def save_size_results(master: DataFrame, results: DataFrame, payload: str, as_of: AsOf) -> DataFrame:
    new = size_result_columns(results, payload, as_of)
    good = F.col("src_size_enrichment_error").isNull()
    set_columns = {
        c: F.col(f"src_{c}") if c in ("size_enriched_at", "size_enrichment_error") else F.when(good, F.col(f"src_{c}")).otherwise(
            F.col(c) if c in master.columns else F.lit(None)
        )
        for c in new.columns
        if c != "id"
    }
    return update_from(master, new, ["id"], set_columns)


def title_class_columns(answer: Column) -> dict[str, Column]:
    """Only 'Data' and 'NIS' are answers; anything else is an error text."""
    value = text.strip(answer)
    ok = value.isin("Data", "NIS")
    return {
        "title_classification": F.when(ok, value),
        "title_classification_error": F.when(~F.coalesce(ok, F.lit(False)), F.concat(F.lit("Unexpected classification: "), F.coalesce(value, F.lit("")))),
    }


def save_title_classes(postings: DataFrame, answers: DataFrame, as_of: AsOf) -> DataFrame:
    """``answers``: id, answer. An error keeps the stored class."""
    columns = title_class_columns(F.col("answer"))
    new = answers.select("id", *[v.alias(c) for c, v in columns.items()])
    return update_from(
        postings, new.withColumn("at", instant(as_of)), ["id"],
        {
            "title_classification": F.coalesce(F.col("src_title_classification"), F.col("title_classification")),
            "title_classification_error": F.col("src_title_classification_error"),
            "title_classification_at": F.col("src_at"),
        },
    )


def consulting_columns(payload: Column) -> dict[str, Column]:
    flag = F.get_json_object(payload, "$.Consulting")
    return {
        "is_consulting": flag.try_cast("boolean"),
        "consulting_reasoning": text.blank_to_null(F.get_json_object(payload, "$.reasoning")),
        "consulting_error": F.when(flag.isNull(), F.lit("Missing 'Consulting' field in response")),
    }


def relevance_columns(answer: Column) -> dict[str, Column]:
    """An integer from 0 to 100, or the reason why not."""
    value = text.strip(answer)
    number = F.when(value.rlike(r"^[+-]?\d+$"), value.try_cast("int"))
    in_range = number.between(0, 100)
    return {
        "relevance_score": F.when(in_range, number),
        "relevance_error": F.when(number.isNull(), F.concat(F.lit("Invalid score format: "), F.coalesce(value, F.lit(""))))
        .when(~in_range, F.concat(F.lit("Score out of range: "), number.cast("string"))),
    }


def save_consulting(master: DataFrame, answers: DataFrame, payload: str, as_of: AsOf, last_by: list[Column] | None = None) -> DataFrame:
    """``answers``: company_id, ``payload``; of several of a company the last by ``last_by`` counts. An answer sets the flag and, if it has one, the
    reasoning; a failed one keeps both and leaves its error, which the next answer clears."""
    order = {f"_by{i}": c for i, c in enumerate(last_by or [])}
    new = answers.select("company_id", *[v.alias(c) for c, v in consulting_columns(F.col(payload)).items()], *[c.alias(n) for n, c in order.items()])
    kept = master.withColumns({c: F.lit(None).cast(t) for c, t in (("is_consulting", "boolean"), ("consulting_reasoning", "string")) if c not in master.columns})
    return update_from(
        kept, new.withColumn("at", instant(as_of)), ["company_id"],
        {
            "is_consulting": F.coalesce("src_is_consulting", "is_consulting"),
            "consulting_reasoning": F.coalesce("src_consulting_reasoning", "consulting_reasoning"),
            "consulting_error": F.col("src_consulting_error"),
            "consulting_at": F.col("src_at"),
        },
        last_by=[F.col(n) for n in order] or None,
    )


def save_relevance(technologies: DataFrame, answers: DataFrame, last_by: list[Column] | None = None) -> DataFrame:
    """``answers``: id, answer; of several of a technology the last by ``last_by`` counts. A valid score is stored, an invalid one
    keeps the stored score and leaves its error."""
    order = {f"_by{i}": c for i, c in enumerate(last_by or [])}
    new = answers.select("id", *[v.alias(c) for c, v in relevance_columns(F.col("answer")).items()], *[c.alias(n) for n, c in order.items()])
    return update_from(
        technologies, new, ["id"],
        {"relevance_score": F.coalesce("src_relevance_score", "relevance_score"), "relevance_error": F.col("src_relevance_error")},
        last_by=[F.col(n) for n in order] or None,
    )


def label_sizes(master: DataFrame) -> DataFrame:
    """Fill missing size labels from the category; unknown categories change nothing."""
    columns = {}
    for i, lang in enumerate(("nl", "en", "fr")):
        label = F.lit(None).cast("string")
        for category, names in SIZE_LABELS.items():
            label = F.when(F.col("size_category") == category, names[i]).otherwise(label)
        columns[f"category_{lang}"] = F.coalesce(F.col(f"category_{lang}"), label)
    return master.withColumns(columns)


def sync_subdivision(locations: DataFrame) -> DataFrame:
    """The write-path rule: the Dutch subdivision name always equals the plain one."""
    return locations.withColumn("subdivision_name_nl", F.col("subdivision_name"))


def consulting_tally(results: DataFrame) -> DataFrame:
    """Outcome counts of a consulting run (columns is_consulting, consulting_error)."""
    return results.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("consulting_error").isNull()).alias("successful"),
        F.count_if(F.col("consulting_error").isNotNull()).alias("failed"),
        F.count_if(F.col("is_consulting")).alias("consulting"),
        F.count_if(~F.col("is_consulting")).alias("not_consulting"),
    )


def result_tally(results: DataFrame) -> DataFrame:
    """Outcome counts of a batch of attempts (columns success, error)."""
    return results.agg(
        F.count("*").alias("total"),
        F.count_if("success").alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
        F.count_if(~F.col("success") & is_quota_error(F.col("error"))).alias("rate_limited"),
    )
