"""Location strings: parts, search spelling, vague patterns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import strip

# City names recognised as Belgian.
BELGIAN_CITIES = (
    "gent", "ghent", "antwerpen", "antwerp", "brussel", "brussels", "brugge", "bruges", "leuven",
    "mechelen", "aalst", "hasselt", "genk", "oostende", "kortrijk", "charleroi", "liège", "luik",
    "namur", "namen",
)

# Dutch spellings searched under another name.
SEARCH_SPELLING = {
    "gent": "Ghent, Belgium",
    "antwerpen": "Antwerp, Belgium",
    "brussel": "Brussels, Belgium",
    "brugge": "Bruges, Belgium",
}

# Location patterns too vague to show, used when no configuration is stored.
VAGUE_PATTERNS = ("Flemish Region", "Walloon Region", "Brussels-Capital Region", "Belgium", "België")


def _parts(location: Column) -> Column:
    return F.transform(F.split(location, ","), strip)


def location_columns(location: Column) -> dict[str, Column]:
    """City, region and country code as stored by ingest."""
    parts = _parts(location)
    count = F.size(parts)
    first, second, third = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    return {
        "full_location_string": strip(location),
        "city": F.when((count > 1) | (F.length(first) != 2), first),
        "region": F.when((count == 2) & (F.length(second) <= 3), F.upper(second)).when(count > 2, second),
        "country_code": F.when((count == 1) & (F.length(first) == 2), F.upper(first)).when(
            (count > 2) & (F.length(third) == 2), F.upper(third)
        ),
    }


def record_location_columns(location: Column) -> dict[str, Column]:
    """The record model's reading: a single part is never a city, two letters after the comma are
    both region and country, and the case is kept."""
    parts = _parts(location)
    count = F.size(parts)
    first, second, third = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    return {
        "full_location_string": location,
        "city": F.when(count > 1, first),
        "region": F.when((count > 2) | (F.length(second) <= 3), second),
        "country_code": F.when((count == 1) & (F.length(first) == 2), first)
        .when((count == 2) & (F.length(second) == 2), second)
        .when((count > 2) & (F.length(third) == 2), third),
    }


def search_location_columns(location: Column) -> dict[str, Column]:
    """The spelling sent to a search, with a country code for known Belgian cities."""
    key = strip(F.lower(location))
    known = key.isin(*BELGIAN_CITIES)
    spelled = F.lit(None).cast("string")
    for dutch, english in SEARCH_SPELLING.items():
        spelled = F.when(key == dutch, english).otherwise(spelled)
    return {
        "search_location": F.when(
            known,
            F.coalesce(
                spelled,
                F.when(~location.contains(","), F.concat(location, F.lit(", Belgium"))).otherwise(location),
            ),
        ).otherwise(location),
        "country_code": F.when(known, F.lit("BE")).otherwise(F.lit("")),
    }
