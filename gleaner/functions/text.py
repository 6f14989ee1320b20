"""Text functions as built-in column expressions: no Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK_SIZE = 1000
ID_LENGTH = 16

#: What counts as a redaction, and the mail prefixes of replies and forwards.
REDACTION_GLYPHS = "█▮▯■▆▇"
REDACTION_MARKERS = r"(?i)\[(?:…|\.\.\.|gelakt|zwartgelakt|weggelakt|verwijderd)\]"
ARTICLE_ANNOTATIONS = r"(?U)\b(?:5\.1\.(?:1|2e?|5)|10\.[12]|11\.1)\b"
REPLY_PREFIXES = r"(?i)^(?:(?:re|fw|fwd|antw|aw)\s*:\s*)+"
#: White space as Python's str methods see it.
SPACE = r"\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def normalize_text(c: Column) -> Column:
    """Line ends to \\n, no white space at line ends, at most one empty line in a row, none around the text."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, rf"[{SPACE}&&[^\n]]+(?=\n|\z)", "")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def content_id(text: Column, source_path: Column) -> Column:
    return F.substring(F.sha2(F.concat(text, F.lit("\0"), source_path), 256), 1, ID_LENGTH)


def _removed(c: Column, pattern: str) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, pattern, ""))


def redaction_ratio(c: Column) -> Column:
    """Share of non-space characters that are glyphs, markers or article annotations; 0 to 1, 0 for a blank text."""
    solid = F.length(F.regexp_replace(c, f"[{SPACE}]+", ""))
    # markers and annotations are counted as written, white space in them included
    hidden = _removed(c, f"[{REDACTION_GLYPHS}]") + _removed(c, REDACTION_MARKERS) + _removed(c, ARTICLE_ANNOTATIONS)
    return F.when(solid == 0, 0.0).otherwise(F.least(F.lit(1.0), hidden / solid))


def tokens(c: Column) -> Column:
    """Lower-cased ASCII letter and digit runs, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit("([0-9a-z]+)"), F.lit(1))


def term_overlap(query: Column, text: Column) -> Column:
    """Distinct query terms that the text holds, in query order."""
    return F.array_intersect(tokens(query), tokens(text))


def let(value: Column, body) -> Column:
    """body(value) with value computed once: an expression inside a lambda would be computed for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingles(toks: Column, width: int = 3) -> Column:
    """Distinct runs of `width` tokens; shorter token lists: the distinct tokens."""

    def of(t: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(t) - width), lambda i: F.concat_ws(" ", F.slice(t, i + 1, width)))
        return F.array_distinct(F.when(F.size(t) < width, t).otherwise(runs))

    return let(toks, of)


def chunks(text: Column, size: int = CHUNK_SIZE) -> Column:
    """Windows of `size` code points without overlap; none for an empty or null text."""
    starts = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int"))
    parts = F.transform(starts, lambda i: F.substring(text, i * size + 1, F.lit(size)))
    return F.when(F.length(text) > 0, parts).otherwise(F.array().cast("array<string>"))


def even_sample(items: Column, cap: int) -> Column:
    """Up to `cap` evenly spaced items; 0 or less: all."""
    if cap <= 0:
        return items

    def of(x: Column) -> Column:
        picked = F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda i: F.element_at(x, F.floor(i * F.size(x) / cap).cast("int") + 1))
        return F.when(F.size(x) > cap, picked).otherwise(x)

    return let(items, of)


def norm_subject(c: Column) -> Column:
    return F.lower(strip(F.regexp_replace(strip(c), REPLY_PREFIXES, "")))


def truncate_words(c: Column, limit: int) -> Column:
    words = F.split(strip(c), f"[{SPACE}]+")
    return F.when(F.size(words) <= limit, c).otherwise(F.concat_ws(" ", F.slice(words, 1, limit)))


def is_exclude_verdict(c: Column) -> Column:
    return F.lower(strip(c)).startswith("uitsluiten")


def doc_type_of(filename: Column) -> Column:
    suffix = F.lower(F.regexp_extract(filename, r"\.([^./]+)$", 1))
    return (
        F.when(suffix == "pdf", "pdf_digital")
        .when(suffix.isin("doc", "docx", "xls", "xlsx", "ppt", "pptx", "odt", "ods", "odp"), "office")
        .otherwise("other")
    )


def doc_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def category(topic: Column, subtopic: Column) -> Column:
    topic, subtopic = F.coalesce(topic, F.lit("")), F.coalesce(subtopic, F.lit(""))
    return F.when((subtopic == "") | (subtopic == topic), topic).otherwise(F.concat_ws(" / ", topic, subtopic))


def formula_safe(c: Column) -> Column:
    """A leading apostrophe before what a spreadsheet would run as a formula."""
    return F.when(F.substring(c, 1, 1).isin("=", "+", "-", "@", "\t", "\r"), F.concat(F.lit("'"), c)).otherwise(c)


def excluded_kind(reason: Column) -> Column:
    return F.when(reason.startswith("validity:"), "validity").otherwise("semantic")


def parse_score(answer: Column) -> Column:
    """struct<relevance, rationale> of a free-form answer: `score: 0-100`, `motivatie: ...`; without a score 0 and the answer."""
    score = F.regexp_extract(answer, r"(?i)score\s*[:=]?\s*(\d{1,3})", 1)
    motive = F.regexp_extract(answer, r"(?is)motivatie\s*[:=]?\s*(.+)", 1)
    plain = F.substring(strip(answer), 1, 200)
    missing = F.when(plain == "", "geen score uit LLM-antwoord").otherwise(plain)
    value = F.least(F.lit(100), F.greatest(F.lit(0), score.cast("int"))) / 100.0
    return F.struct(
        F.when(score == "", 0.0).otherwise(value).alias("relevance"),
        F.when(score == "", missing).when(motive == "", plain).otherwise(strip(motive)).alias("rationale"),
    )


def parse_score_json(answer: Column) -> Column:
    """The same from a JSON object with both fields; null where it is none."""
    raw = F.from_json(answer, "score string, motivatie string")
    number = F.floor(F.expr("try_cast(1 as double)") * raw["score"].try_cast("double")).cast("int")
    text = F.substring(strip(raw["motivatie"]), 1, 200)
    relevance = F.least(F.lit(100), F.greatest(F.lit(0), number)) / 100.0
    made = F.struct(relevance.alias("relevance"), F.when(text == "", "geen motivatie uit LLM-antwoord").otherwise(text).alias("rationale"))
    return F.when(number.isNotNull() & raw["motivatie"].isNotNull(), made)
