"""Text functions over columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"(?U)\s+"


def word_count(text: Column) -> Column:
    """Words between Unicode white space; null for null."""
    return F.size(F.filter(F.split(text, WHITE), lambda w: w != "")).cast("long")


def collapse(text: Column) -> Column:
    """All white space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, WHITE, " "))


def normalize_lines(text: Column) -> Column:
    """Lines with their white space collapsed, empty ones left out."""
    return F.array_join(F.filter(F.transform(F.split(text, "\n", -1), collapse), lambda x: x != ""), "\n")


def trim_title(title: Column) -> Column:
    """What comes before ` | `, ` - ` and ` — `."""
    for mark in (" | ", " - ", " — "):
        title = F.substring_index(title, mark, 1)
    return F.trim(title)


def link_share(html: Column) -> Column:
    """Bytes of link text over bytes of all text of a page; zero for a page without text. Native, for well-formed links."""
    def plain(x: Column) -> Column:
        return collapse(F.regexp_replace(x, "<[^>]*>", " "))

    body = F.regexp_replace(html, r"(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<title[^>]*>.*?</title>|<!--.*?-->", "")
    links = F.transform(F.regexp_extract_all(body, F.lit(r"(?s)<a[ >].*?</a>"), 0), lambda a: F.octet_length(plain(a)))
    total = F.octet_length(plain(body))
    return F.when(total > 0, F.aggregate(links, F.lit(0), lambda x, y: x + y) / total).otherwise(F.lit(0.0))


def clean_captions(vtt: Column) -> Column:
    """Spoken lines of a WebVTT text, each once; null if there are none."""
    def spoken(line: Column) -> Column:
        return (F.trim(line) != "") & ~F.trim(line).rlike("^(WEBVTT|Kind:|Language:)") & ~line.contains("-->")

    def plain(line: Column) -> Column:
        line = F.regexp_replace(line, "<[^>]+>", "")
        for code, mark in (("&amp;", "&"), ("&gt;", ">"), ("&lt;", "<")):
            line = F.replace(line, F.lit(code), F.lit(mark))
        return F.trim(line)

    lines = F.filter(F.transform(F.filter(F.split(vtt, r"\r?\n", -1), spoken), plain), lambda x: x != "")
    return F.nullif(F.array_join(F.array_distinct(lines), "\n"), F.lit(""))


def _accents() -> tuple[str, str]:
    """Letters that are one base letter with marks, and those letters."""
    pairs = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0].isalpha() and all(unicodedata.combining(x) for x in parts[1:]):
            pairs[chr(code)] = parts[0]
    return "".join(pairs), "".join(pairs.values())


ACCENTED, BARE = _accents()


def tokens(text: Column) -> Column:
    """Runs of letters and digits, in lower case and without accents."""
    return F.regexp_extract_all(F.translate(F.lower(text), ACCENTED, BARE), F.lit(r"[\p{L}\p{N}]+"), 0)


def title_terms(title: Column) -> Column:
    """Words of four ASCII letters or more between Unicode word boundaries, in lower case."""
    return F.filter(F.regexp_extract_all(F.lower(title), F.lit(r"[\p{L}\p{N}_]+"), 0), lambda w: w.rlike("^[a-z]{4,}$"))
