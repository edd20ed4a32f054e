"""Column expressions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "NaN"  # stored in place of an absent description

# The characters that separate words (Unicode white space and the four ASCII separators).
SPACES = (
    r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def strip_tags(c: Column) -> Column:
    """Drop `<...>`, shortest match; only a newline ends the search ((?d) keeps \\r from doing so)."""
    return F.regexp_replace(c, "(?d)<.*?>", "")


def squeeze(c: Column) -> Column:
    """One blank between words, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACES}+", " "))


def or_missing(c: Column) -> Column:
    return F.coalesce(c, F.lit(MISSING))


def clean_description(c: Column) -> Column:
    return or_missing(squeeze(strip_tags(c)))


def no_summary(c: Column, label: str = "No summary available") -> Column:
    return F.when(c == MISSING, F.lit(label)).otherwise(c)


def doc_text(title: Column, summary: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(summary, F.lit("")))


def tokens(c: Column) -> Column:
    """Lower-case words in order, repeats kept."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(c), SPACES, " "), " "), "")


def xml_description(c: Column) -> Column:
    """Text of dc:description in a catalogue sidecar: NULL when absent, MISSING when the XML is unreadable."""
    parsed = F.from_xml(
        c,
        "metadata struct<`dc:description`:string>, _bad string",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"},
    )
    return F.when(
        c.isNull() | parsed["_bad"].isNotNull(), F.lit(MISSING)
    ).otherwise(parsed["metadata"]["dc:description"])


def media_url(image: Column, prefix: str = "/media/calibre-library-image/") -> Column:
    """Public path of an image, NULL when there is none."""
    return F.when(image != "", F.concat(F.lit(prefix), image))
