"""Text normalisation: titles, dedup keys, HTML, URLs, lists, slugs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters counted as white space, the same set in Java and RE2 syntax.
SPACE = (
    r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# HTML entities and their text, decoded one after another in this order.
ENTITIES = (
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#x27;", "'"),
    ("&#x2019;", "'"),
    ("&#39;", "'"),
    ("&nbsp;", " "),
)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def collapse(c: Column) -> Column:
    """Every run of white space becomes one space."""
    return F.regexp_replace(c, f"{SPACE}+", " ")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def normalize_title(title: Column) -> Column:
    return strip(collapse(F.lower(title)))


def ingest_title(title: Column) -> Column:
    """``title_normalized`` as ingest stores it: inner white space is kept."""
    return strip(F.lower(title))


def dedup_key(title: Column, company: Column) -> Column:
    return F.concat(normalize_title(title), F.lit("|"), strip(F.lower(F.coalesce(company, F.lit("")))))


def dedup_key_from_normalized(title_normalized: Column, company: Column) -> Column:
    """The backfill form: one lower/trim (spaces only) over the joined text."""
    return F.lower(F.trim(F.concat(title_normalized, F.lit("|"), F.coalesce(company, F.lit("")))))


def html_to_text(html: Column) -> Column:
    text = F.regexp_replace(html, "<[^>]+>", "")
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return blank_to_null(strip(collapse(text)))


def ensure_url(url: Column) -> Column:
    bare = strip(url)
    return F.when(bare == "", F.lit(None)).when(
        bare.startswith("http://") | bare.startswith("https://"), bare
    ).otherwise(F.concat(F.lit("https://"), bare))


def split_list(text: Column, keep_blanks: bool = False) -> Column:
    """Comma list to trimmed array; null and '' give an empty array."""
    parts = F.transform(F.split(text, ","), strip)
    if not keep_blanks:
        parts = F.filter(parts, lambda p: p != "")
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(parts)


def company_columns(
    name: Column, linkedin_id: Column, company_url: Column, logo_url: Column, industry: Column
) -> dict[str, Column]:
    """The cleaned company fields, keyed by table column."""
    return {
        "name": strip(F.coalesce(name, F.lit(""))),
        "linkedin_company_id": F.when(linkedin_id != "", strip(linkedin_id)),
        "company_url": F.when(company_url == "", F.lit(None))
        .when(company_url.startswith("http"), company_url)
        .otherwise(F.concat(F.lit("https://"), company_url)),
        "logo_url": F.when(logo_url.startswith("http"), logo_url),
        "industry": blank_to_null(strip(industry)),
    }


def logo_file_name(name: Column, extension: str = "png") -> Column:
    slug = F.lower(name)
    for found, plain in (("++", "pp"), ("#", "sharp"), (".", "")):
        slug = F.replace(slug, F.lit(found), F.lit(plain))
    slug = F.regexp_replace(slug, "[^a-z0-9-]", "-")
    slug = F.regexp_replace(slug, "-+", "-")
    slug = F.regexp_replace(slug, "^-+|-+$", "")
    return F.concat(slug, F.lit(f"-logo.{extension}"))


def parse_array_literal(literal: Column) -> Column:
    """``{"a","b"}`` or ``{a,b}`` to an array; null and ``{}`` give an empty array."""
    inner = F.regexp_replace(literal, "[{}]", "")
    items = F.filter(F.split(inner, ","), lambda i: strip(i) != "")
    return F.when(F.coalesce(inner, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.transform(items, lambda i: strip(F.replace(i, F.lit('"'), F.lit(""))))
    )


def format_array_literal(items: Column) -> Column:
    quoted = F.transform(
        items, lambda i: F.concat(F.lit('"'), F.replace(i, F.lit('"'), F.lit('\\"')), F.lit('"'))
    )
    return F.concat(F.lit("{"), F.coalesce(F.array_join(quoted, ","), F.lit("")), F.lit("}"))


def spreadsheet_id(cell: Column) -> Column:
    """Trimmed id without the decimal part a spreadsheet adds; blank is null."""
    return F.when(strip(cell) != "", F.split(strip(cell), r"\.")[0])


def digits_as_int(cell: Column) -> Column:
    return F.regexp_replace(cell, "[^0-9]", "").try_cast("int")


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


def is_placeholder(value: Column) -> Column:
    """Null, blank, or one of the words used for 'no place found'."""
    # Placeholder words.
    words = ("niet gevonden", "unknown", "n/a")
    return value.isNull() | (strip(value) == "") | F.lower(value).isin(*words)


def classifier_text(
    name: Column,
    website: Column,
    sector: Column,
    employees: Column,
    description_nl: Column,
    description_en: Column,
    facts: Column,
    size_arguments: Column,
) -> Column:
    """Labelled lines about a company, skipping what is missing.

    ``facts`` is an array of structs (category, text_nl, text_en); ``size_arguments`` an array of text.
    """

    def line(label: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(f"{label}: "), value))

    fact_lines = F.filter(
        F.transform(
            facts,
            lambda f: F.concat(
                F.lit("["),
                F.coalesce(f["category"], F.lit("")),
                F.lit("] "),
                F.coalesce(blank_to_null(f["text_nl"]), blank_to_null(f["text_en"])),
            ),
        ),
        lambda t: t.isNotNull(),
    )
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Company: "), name),
        line("Website", website),
        line("Sector", sector),
        line("Employees", employees),
        line("Description", F.coalesce(blank_to_null(description_nl), blank_to_null(description_en))),
        F.when(F.size(fact_lines) > 0, F.concat(F.lit("Facts: "), F.array_join(fact_lines, " | "))),
        F.when(
            F.size(size_arguments) > 0, F.concat(F.lit("Key facts: "), F.array_join(size_arguments, " | "))
        ),
    )
