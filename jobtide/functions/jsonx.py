"""JSON kept as text: paths with fallback, containment, merge, label lookup."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import blank_to_null

PERKS = "array<struct<key:string,found:boolean,value:string>>"
LANGUAGES = ("nl", "en", "fr")


def path(doc: Column, *steps: str) -> Column:
    return F.get_json_object(doc, "$." + ".".join(steps))


def first_filled(doc: Column, *paths: str) -> Column:
    """First path with a non-blank value: ``a or b or c``."""
    return F.coalesce(*[blank_to_null(path(doc, p)) for p in paths])


def label_value(labels: Column, field: str) -> Column:
    """A label in the first language that has it; lists give their first entry."""

    def in_language(lang: str) -> Column:
        raw = path(labels, lang, field)
        return F.when(raw.startswith("["), path(labels, lang, f"{field}[0]")).otherwise(blank_to_null(raw))

    return F.coalesce(*[in_language(lang) for lang in LANGUAGES])


def has_entry(perks: Column, key: str, found: bool = True) -> Column:
    """The array holds an entry with this key and flag."""
    return F.coalesce(
        F.exists(
            F.from_json(perks, PERKS),
            lambda p: F.coalesce((p["key"] == key) & (p["found"] == F.lit(found)), F.lit(False)),
        ),
        F.lit(False),
    )


def entry_value(perks: Column, key: str) -> Column:
    """Value of the first found entry with this key."""
    hits = F.filter(F.from_json(perks, PERKS), lambda p: (p["key"] == key) & p["found"])
    return F.get(hits, F.lit(0))["value"]


def merge_text_map(doc: Column, patch: Column) -> Column:
    """Top-level merge of two JSON objects of scalars; the patch wins."""
    empty = F.lit("{}")
    old = F.from_json(F.coalesce(doc, empty), "map<string,string>")
    new = F.from_json(F.coalesce(patch, empty), "map<string,string>")
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    return F.to_json(F.map_concat(kept, new))
