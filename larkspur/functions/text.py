"""Text functions as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def fts_tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores of any script."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def fts_query(text: Column) -> Column:
    """Quoted tokens joined by AND; null without a token."""
    quoted = F.transform(fts_tokens(text), lambda t: F.concat(F.lit('"'), t, F.lit('"')))
    return F.when(F.size(quoted) > 0, F.array_join(quoted, " AND "))


def fts_query_plain(text: Column) -> Column:
    """Lower-cased tokens of two characters or more joined by AND; texts with operators pass as they are."""
    tokens = F.filter(fts_tokens(F.lower(text)), lambda t: F.length(t) > 1)
    plain = F.when(F.size(tokens) > 0, F.array_join(F.transform(tokens, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " AND "))
    return F.when(text.rlike(r'[*^":()]'), text).otherwise(plain)


def ascii_words(text: Column) -> Column:
    """Runs of a-z, digits and underscores of the text in lower case, in order, repeats too."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))


def ascii_tokens(text: Column) -> Column:
    """The distinct ASCII words of a text in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0)))


def long_words(text: Column) -> Column:
    """The distinct words of three characters or more, cut at white space, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.length(w) > 2))


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """Intersection over union of two arrays of distinct values."""
    shared = F.size(F.array_intersect(a, b)).cast("double")
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, F.lit(both_empty)).otherwise(shared / union)


def content_hash(text: Column, pepper: str = "") -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(text, F.lit(pepper)), 256))


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """One less the distance as a share of the longer text; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def snippet(text: Column, most: int) -> Column:
    return F.substring(text, 1, most)


def truncated(text: Column, most: int) -> Column:
    return F.length(text) > most


def elide(text: Column, most: int = 140) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, max(0, most - 1))), F.lit("…")))


def one_line(text: Column, most: int = 160) -> Column:
    return elide(F.trim(F.regexp_replace(text, r"\s+", " ")), most)


def session_text(text: Column) -> Column:
    """White space collapsed, ends trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s*\n+\s*", " "), r"\s+", " "))


def strip_invisible(text: Column) -> Column:
    """Without zero-width, direction and tag characters."""
    return F.regexp_replace(text, r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{206A}-\x{206F}\x{FEFF}\x{E0000}-\x{E007F}]", "")


def comparable(text: Column) -> Column:
    """Trimmed, lower-cased, without pictographs, spaces collapsed."""
    bare = F.regexp_replace(F.lower(F.trim(text)), r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}\x{200D}]", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def hyphen_slug(text: Column) -> Column:
    cleaned = F.regexp_replace(F.lower(F.trim(text)), r"\s+", "-")
    cleaned = F.regexp_replace(cleaned, r"[^a-z0-9#@._+-]+", "-")
    return F.regexp_replace(F.regexp_replace(cleaned, "-{2,}", "-"), r"^[-.]+|[-.]+$", "")


def links(text: Column, most: int) -> Column:
    """Bare http links in order, without those in Markdown links and those to local hosts, each once, at most `most`."""
    bare = F.regexp_replace(F.trim(text), r"(?i)\[[^\]]*]\((https?://\S+?)\)", " ")
    found = F.regexp_extract_all(bare, F.lit(r"(?i)https?://\S+"), F.lit(0))
    local = r"(?i)^https?://(localhost|127\.|10\.|192\.168\.|169\.254\.|0\.0\.0\.0|\[?::1)"
    return F.slice(F.array_distinct(F.filter(found, lambda u: ~u.rlike(local))), 1, most)


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def citation(path: Column, start: Column, end: Column) -> Column:
    one = F.concat(path, F.lit("#L"), start)
    return F.when(start == end, one).otherwise(F.concat(one, F.lit("-L"), end))


def line_range(text: Column, first: int, count: int) -> Column:
    return F.array_join(F.slice(F.split(text, "\n"), max(1, first), max(1, count)), "\n")


# --- scores of statements

# Words that make a statement vague, weights, importance by category.
VAGUE = ["maybe", "perhaps", "possibly", "might", "could be", "sort of", "kind of"]
IMPORTANCE = {"User": 0.9, "FutureTask": 0.85, "CurrentProject": 0.8, "SelfImprovement": 0.7, "KnowledgeBase": 0.6}
DATES = r"(?i)\b(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|tomorrow|yesterday|today|\d{1,2}[/-]\d{1,2})\b"


def clarity(text: Column) -> Column:
    vague = F.exists(F.array(*[F.lit(w) for w in VAGUE]), lambda w: F.contains(F.lower(text), w))
    off = lambda when, by: F.when(when, by).otherwise(0.0)
    return F.greatest(F.lit(0.0), 1.0 - off(vague, 0.2) - off(F.length(text) > 200, 0.1) - off(text.endswith("?"), 0.3))


def importance(category: Column) -> Column:
    out = F.lit(0.5)
    for name, value in IMPORTANCE.items():
        out = F.when(category == name, F.lit(value)).otherwise(out)
    return out


def specificity(text: Column) -> Column:
    add = lambda when, by: F.when(when, by).otherwise(0.0)
    score = 0.5 + add(text.rlike("[0-9]"), 0.2) + add(text.rlike("[A-Z][a-z]+"), 0.15) + add(text.rlike(DATES), 0.15) - add(F.length(text) < 20, 0.2)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def support(messages: Column) -> Column:
    return F.when(messages >= 3, 1.0).when(messages == 2, 0.9).when(messages == 1, 0.75).otherwise(0.5)


def confidence(text: Column, category: Column, messages: Column) -> Column:
    weighted = 0.3 * clarity(text) + 0.3 * importance(category) + 0.25 * specificity(text) + 0.15 * support(messages)
    return F.floor(weighted * 100 + 0.5) / 100


def confidence_tier(value: Column) -> Column:
    return F.when(value >= 0.8, "high").when(value >= 0.6, "medium").otherwise("low")


# Capitalised words that are no names; technologies that are told by their names.
NO_NAMES = ("The", "And", "For", "With")
TECHNOLOGIES = ("Neo4j", "Docker", "Kubernetes", "GitHub")


def entities(text: Column, technologies: tuple[str, ...] | list[str] = TECHNOLOGIES) -> Column:
    """Capitalised runs (0.7), technologies in any case (0.9) and ISO dates (0.8) as structs of type, name, confidence,
    each name once. A word's letters are ASCII here: others are no part of a name, and end one."""
    apart = lambda p: F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?<![A-Za-z0-9_])(?:{p})(?![A-Za-z0-9_])"), F.lit(0)))
    names = F.filter(apart(r"[A-Z][a-z]+(?:[ \t\n\r][A-Z][a-z]+)*"), lambda x: (F.length(x) > 2) & ~x.isin(*NO_NAMES))
    as_rows = lambda xs, kind, c: F.transform(xs, lambda x: F.struct(F.lit(kind).alias("type"), x.alias("name"), F.lit(c).alias("confidence")))
    known = apart("(?i:" + "|".join(map(re.escape, technologies)) + ")")
    return F.concat(as_rows(names, "Person", 0.7), as_rows(known, "Project/Technology", 0.9), as_rows(apart(r"[0-9]{4}-[0-9]{2}-[0-9]{2}"), "Date", 0.8))
