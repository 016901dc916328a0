"""Text, genre, platform and date expressions; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from relish import schemas

# Date layouts tried in order.
DATE_FORMATS = ("yyyy-MM-dd", "M/d/yyyy", "MMM d, yyyy", "MMMM d, yyyy")


def strip(text: Column) -> Column:
    """Drop white space at both ends, not only blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_genres(raw: Column) -> Column:
    """Comma list to a sorted list of distinct lower-case names; NULL gives an empty list."""
    names = F.transform(F.split(raw, ","), lambda g: F.replace(F.replace(
        F.lower(strip(g)), F.lit("’"), F.lit("'")), F.lit("–"), F.lit("-")))
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(names, lambda g: g != ""))),
                      F.array().cast("array<string>"))


def split_genres(raw: Column) -> Column:
    """Lower-case and split at commas with trailing blanks; nothing else is cleaned."""
    return F.coalesce(F.split(F.lower(raw), r",\s*"), F.array().cast("array<string>"))


def _json_words(literal: Column) -> Column:
    """Turn Python's bare constants into JSON ones, leaving quoted text alone."""
    quoted_to_end = r"""(?=(?:[^'"]++|'(?:[^'\\]++|\\.)*+'|"(?:[^"\\]++|\\.)*+")*+$)"""
    for python, json in (("None", "null"), ("True", "true"), ("False", "false")):
        literal = F.regexp_replace(literal, rf"\b{python}\b{quoted_to_end}", json)
    return literal


def parse_platforms(literal: Column) -> Column:
    """List-of-dicts literal to ``array<struct<platform, metascore>>``; bad input gives an empty list."""
    parsed = F.from_json(_json_words(literal), schemas.PLATFORMS,
                         {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"})
    rows = F.transform(F.when(strip(literal).startswith("["), parsed), lambda e: F.struct(
        F.coalesce(e["Platform"], F.lit("")).alias("platform"), e["Platform Metascore"].alias("metascore")))
    return F.coalesce(rows, F.array().cast("array<struct<platform:string,metascore:string>>"))


def platform_scores(platforms: Column) -> Column:
    """``map<platform, score>``: a non-digit score counts 0, the last entry of a name wins.

    Pass a parsed column, not the parsing expression: lambdas would parse per entry.
    """
    last = F.filter(platforms, lambda e, i: ~F.exists(
        F.slice(platforms, i + 2, F.size(platforms)), lambda later: later["platform"] == e["platform"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(
        e["platform"], F.when(e["metascore"].rlike(r"^[0-9]+\z"), e["metascore"].try_cast("int"))
                        .otherwise(0).cast("int"))))


def parse_year(text: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Year of a date in one of the layouts, NULL when none fits."""
    return F.year(F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]))


def title_case(text: Column) -> Column:
    """Upper-case every letter that does not follow a letter, lower-case the others."""
    chars = F.split(text, "")
    before = F.concat(F.array(F.lit("")), F.slice(chars, F.lit(1), F.greatest(F.size(chars) - 1, F.lit(0))))
    return F.array_join(F.zip_with(chars, before, lambda c, b: F.when(b.rlike(r"\p{L}"), F.lower(c)).otherwise(F.upper(c))), "")


def shorten_title(title: Column, limit: int = 25) -> Column:
    """Titles over the limit lose their parentheses and a leading article."""
    bare = F.trim(F.regexp_replace(title, r"\s*\([^)]*\)\s*", " "))
    short = F.regexp_replace(bare, r"^(?i:The)\s+", "")
    return F.when((F.length(title) > limit) & (F.length(short) < F.length(title)), short).otherwise(title)


def slug(title: Column) -> Column:
    return F.regexp_replace(F.lower(title), "[^a-z0-9]", "")
