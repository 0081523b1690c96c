"""Scalar text functions as Spark columns. Patterns are Unicode-aware throughout."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from mapwright.functions import constants as K

TOKEN = r"(?U)\w+"
SENTENCE_END = r"(?U)(?<=[.!?])\s+"
HEADER = r"(?iu)^(?:(?:Section|Chapter|Part)\s+\d+|APPENDIX\s+[A-Z]|\d+(?:\.\d+)*)(?:\s*[:\-—]\s*|\s{2,})\S"
NUMBERED_LINE = r"(?m)(?=^\d+(?:\.\d+)*\s{2,}\S)"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def tokens(c: Column) -> Column:
    """Lower-cased words."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, SENTENCE_END), strip), lambda s: s != "")


def is_header(c: Column) -> Column:
    return c.rlike(HEADER)


def matches_boilerplate(c: Column) -> Column:
    """Running page furniture by its wording alone."""
    return c.rlike(K.BOILERPLATE)


def is_fragment(c: Column) -> Column:
    """Chunks that are an approval stamp, or a short piece of a legal notice."""
    low = F.lower(c)
    stamp = low.contains("approved by the") & (low.contains("security officer") | low.contains("ciso") | low.contains("executive management"))
    notice = low.contains("prohibited") & (low.contains("reproduction") | low.contains("disclosure"))
    short = (F.length(c) < 120) & (c.rlike(r"^\p{Ll}") | c.startswith("(") | notice | low.contains("effective as of the date"))
    return stamp | short


def comparable(c: Column) -> Column:
    """For comparing page furniture: lower case, numbers as #."""
    return F.regexp_replace(F.lower(strip(c)), r"(?U)\d+", "#")


def ends_with_trailing_word(c: Column) -> Column:
    bare = F.regexp_replace(strip(c), r"[.!?]+$", "")
    return F.coalesce(F.lower(F.regexp_extract(bare, r"(?U)(\S+)\s*$", 1)).isin(*K.TRAILING_WORDS), F.lit(False)) & (bare != "")


def expand_query(c: Column) -> Column:
    """The query with the terms of every concept that it mentions, in the map's order."""
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in K.EXPANSIONS])
    found = F.transform(F.filter(pairs, lambda p: F.contains(F.lower(c), p["k"])), lambda p: p["v"])
    return F.when(F.size(found) > 0, F.concat(c, F.lit(" ["), F.array_join(found, "; "), F.lit("]"))).otherwise(c)


def prompt_text(control_id: Column, title: Column, description: Column) -> Column:
    return F.concat(control_id, F.lit(": "), title, F.lit(". "), description)


def with_family(family: Column, query: Column) -> Column:
    return F.when(F.coalesce(family, F.lit("")) != "", F.concat(F.lit("["), family, F.lit("] "), query)).otherwise(query)


def embedding_query(query: Column) -> Column:
    return F.concat(F.lit(K.QUERY_PREFIX), query)


def truncate(c: Column, most: int = 150) -> Column:
    """One line of at most ``most`` characters, with an ellipsis where cut."""
    line = strip(F.regexp_replace(c, "\n", " "))
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most - 3), F.lit("..."))).otherwise(line)


def truncate_at_sentence(c: Column, most: int = 1200) -> Column:
    """Cut after the last sentence if that keeps half of ``most``, else at ``most`` with a mark."""
    cut = F.substring(c, 1, most)
    spaced = F.locate(" .", F.reverse(cut))
    at = F.when(spaced > 0, most - spaced - 1).when(cut.endswith("."), most - 1).otherwise(-1)
    return F.when(F.length(c) <= most, c).when(at >= most / 2, F.substring(cut, F.lit(1), at + 1)).otherwise(F.concat(cut, F.lit("\n[...truncated]")))


def requirement_key(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"(?U)\s+", " "), r"[.;,]+$", "")


def is_meta(c: Column) -> Column:
    text = F.coalesce(c, F.lit(""))
    return text.rlike(K.META_ALL) | text.rlike(K.META_ROLES)


def family_of(control_id: Column) -> Column:
    return F.when(F.contains(control_id, F.lit(".")), F.substring_index(control_id, ".", 1)).when(F.contains(control_id, F.lit("-")), F.substring_index(control_id, "-", 1)).otherwise(control_id)


def json_object(raw: Column) -> Column:
    """The JSON object in a model's answer: fenced, else from first to last brace, else all."""
    text = strip(raw)
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braced = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(fenced != "", fenced).when(braced != "", braced).otherwise(text)


def json_array(raw: Column) -> Column:
    """The text of the JSON array in a model's answer, null if there is none."""
    text = strip(raw)
    found = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    return F.when(found != "", found)


def page_segments(c: Column, threshold: int = 1500) -> Column:
    """Long pages cut before every numbered heading."""
    parts = F.filter(F.transform(F.split(c, NUMBERED_LINE), strip), lambda s: s != "")
    return F.when(F.length(c) <= threshold, F.array(c)).when(F.size(F.split(c, NUMBERED_LINE)) <= 1, F.array(c)).otherwise(parts)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns; 0 where either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def filled(template: str, **values: Column) -> Column:
    """A text with its <<names>> replaced by columns."""
    parts = re.split(r"<<(\w+)>>", template)
    return F.concat(*[values[x].cast("string") if i % 2 else F.lit(x) for i, x in enumerate(parts)])


def truth(raw: Column, field: str, unreadable: bool) -> Column:
    """A flag of the JSON object in a model's answer; false where the object lacks it."""
    found = json_object(raw)
    readable = F.coalesce(F.try_parse_json(found).isNotNull() & found.startswith("{"), F.lit(False))
    value = F.get_json_object(found, f"$.{field}")
    told = F.coalesce(~F.lower(value).isin("false", "", "0", "0.0", "null", "[]", "{}"), F.lit(False))
    return F.when(readable, told).otherwise(F.lit(unreadable))
