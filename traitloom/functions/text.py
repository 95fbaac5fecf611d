"""Text functions over model answers, reports and prompts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..constants import POPULATION_PATTERNS

#: ``### <id>`` header lines of a grouped text.
SECTION_HEADER = r"(?md)^###[ \t]+(.+?)[ \t]*$"
SECTION_SEPARATOR = "\n\n---\n\n"
#: A run of digits is tried from its first digit only, so a long one costs one look.
LEAKAGE_PATTERN = "(?iU)(" + "|".join(r"(?<!\d)" * p.startswith(r"\d") + p for p in POPULATION_PATTERNS) + ")"


#: Every character that counts as white space at the ends of a text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Drop white space of any kind at both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


#: Every character that ends a line.
LINE_ENDS = r"\n\x0B\x0C\r\x1C\x1D\x1E\x85\u2028\u2029"


def strip_code_fence(text: Column) -> Column:
    """Drop the line that opens a code fence, and the last line if it closes one.

    A fence that never closes loses its first line only; an answer on the fence
    line itself is lost with that line.  Any character that ends a line counts,
    a lone carriage return too.  Texts without a fence meet no regex, and one from
    brace to brace is taken as it stands: it has no fence and no white space to drop.
    """
    bare = text.startswith("{") & text.endswith("}")
    fenced = F.ltrim(text, F.lit(WHITE_SPACE)).startswith("```")
    inner = F.regexp_replace(strip(text), rf"^```[^{LINE_ENDS}]*(?:\r\n|[{LINE_ENDS}])?", "")
    inner = F.regexp_replace(inner, rf"(?U)(^|[{LINE_ENDS}])[^\S{LINE_ENDS}]*```$", "")
    return F.when(bare, text).when(fenced, strip(inner)).otherwise(strip(text))


def text_parts(blocks: Column, sep: str = "\n") -> Column:
    """Join the text of the ``text`` blocks, dropping reasoning blocks."""
    kept = F.filter(blocks, lambda b: b["type"] == "text")
    return F.array_join(F.transform(kept, lambda b: b["text"]), sep)


def parse_tag_content(text: Column, tag: str) -> Column:
    """Inner text of the first ``<tag>..</tag>``, stripped; empty when absent.

    Plain searches: what follows the first opening tag holds a closing one, or
    no later opening tag is followed by one either.
    """
    opening, closing = f"<{tag}>", f"</{tag}>"
    at = F.instr(text, opening)
    rest = F.substring(text, at + len(opening), F.length(text))
    inner = F.when((at > 0) & F.contains(rest, F.lit(closing)), F.substring_index(rest, closing, 1)).otherwise("")
    return F.when(text.isNotNull(), strip(inner))


def ensure_all_tags_closed(text: Column) -> Column:
    """Append one closing tag per plain tag that never closes, in first-seen order."""
    named = lambda opening: F.regexp_extract_all(text, F.lit(rf"(?U){opening}(\w+)>"), F.lit(1))
    closers = F.transform(F.array_except(named("<"), named("</")), lambda t: F.concat(F.lit("</"), t, F.lit(">")))
    return F.concat(text, F.array_join(closers, ""))


def clean_text(text: Column, trim: bool = True) -> Column:
    """Drop byte-order marks, use ``\\n`` line ends, collapse blank lines."""
    s = F.regexp_replace(F.replace(text, F.lit("﻿"), F.lit("")), "\r\n?", "\n")
    s = F.regexp_replace(s, r"(?U)\n\s*\n", "\n")
    return strip(s) if trim else s


def extract_report(text: Column) -> Column:
    """The cleaned ``<report>`` body of one answer, empty when there is none."""
    return clean_text(parse_tag_content(ensure_all_tags_closed(text), "report"))


def find_leakage(text: Column) -> Column:
    """Sorted distinct population or frequency phrases, in lower case."""
    hits = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LEAKAGE_PATTERN), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(hits, F.lower)))
