"""Text functions as column expressions.

Patterns carry ``(?U)`` where Unicode white space and word borders matter.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..vocabulary import ACRONYMS, CANDIDATE_NOISE, EVENT_REWRITES, GUARDED, PROJECT_SUFFIXES, SMALL_WORDS


def first_filled(*columns: Column, default: str | None = "") -> Column:
    """The first that is neither null nor empty."""
    filled = [F.nullif(c, F.lit("")) for c in columns]
    return F.coalesce(*filled, F.lit(default))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def summary(c: Column, most: int = 120) -> Column:
    """The first ``most`` characters of the collapsed text; no more of it is read than one character beyond them needs."""
    clean = F.regexp_replace(F.regexp_extract(c, rf"(?U)^\s*+((?:\S|\s++(?=\S)){{0,{most + 1}}})", 1), r"(?U)\s+", " ")
    return F.concat(F.substring(clean, 1, most), F.when(F.length(clean) > most, "...").otherwise(""))


def quoted(text: str) -> str:
    return "".join("\\" + x if not x.isalnum() and x.isascii() and not x.isspace() else x for x in text)


def contains_alias(text: Column, alias: str) -> Column:
    """Whether lower-case ``text`` has the alias; one with a-z or 0-9 not next to another such character."""
    return contains_any(text, [alias])


def contains_any(text: Column, aliases: list[str] | tuple[str, ...]) -> Column:
    clean = [a for a in (x.lower().strip() for x in aliases) if a]
    latin = [quoted(a) for a in clean if re.search("[a-z0-9]", a)]
    found = [text.contains(a) for a in clean if not re.search("[a-z0-9]", a)]
    if latin:
        found.insert(0, text.rlike(f"(?<![a-z0-9])(?:{'|'.join(latin)})(?![a-z0-9])"))
    return reduce(Column.__or__, found) if found else F.lit(False)


class Part:
    """A lower-case text with those of some words that it has as whole runs of a-z and 0-9, in one or more arrays.

    ``has_any`` is contains_any, given the first run of each alias was among the
    words: an alias of one run is there if its run is, and one of more characters
    is looked for in the text only if its first run is there.
    """

    def __init__(self, text: Column, *words: Column):
        self.text, self.words = text, words

    def _word(self, run: str) -> Column:
        return reduce(Column.__or__, [F.array_contains(w, run) for w in self.words])

    def has(self, alias: str) -> Column:
        return self.has_any([alias])

    def has_any(self, aliases: list[str] | tuple[str, ...]) -> Column:
        found = []
        for a in (x.lower().strip() for x in aliases):
            run = first_run(a)
            if run is None and a:
                found.append(self.text.contains(a))
            elif run is not None:
                found.append(self._word(run) if run == a else self._word(run) & contains_alias(self.text, a))
        return reduce(Column.__or__, found) if found else F.lit(False)

    def has_topic(self, alias: str) -> Column:
        return contains_topic(self.text, alias) if alias.lower().strip() in GUARDED else self.has(alias)


def first_run(alias: str) -> str | None:
    """The first run of a-z and 0-9 in an alias."""
    found = re.search("[a-z0-9]+", alias.lower().strip())
    return found[0] if found else None


def words_of(text: Column, words: list[str]) -> Column:
    """Those of ``words`` that lower-case ``text`` has as whole runs of a-z and 0-9."""
    runs = F.regexp_extract_all(text, F.lit("([a-z0-9]+)"), 1)
    return F.array_intersect(runs, F.array(*map(F.lit, words))) if words else F.array().cast("array<string>")


def contains_topic(text: Column, alias: str) -> Column:
    """As contains_alias, but guarded aliases count only in their contexts."""
    guard = GUARDED.get(alias.lower().strip())
    if guard is None:
        return contains_alias(text, alias)
    veto, phrases, near = guard
    pairs = text.rlike("(?U)" + "|".join(f"{a}.{{0,20}}{b}" for a, b in near))
    return ~contains_any(text, veto) & (contains_any(text, phrases) | pairs)


def contains_column(text: Column, alias: Column) -> Column:
    """contains_alias for an alias that is a column."""
    a = F.lower(strip(alias))
    bounded = F.rlike(text, F.concat(F.lit(r"(?<![a-z0-9])\Q"), a, F.lit(r"\E(?![a-z0-9])")))
    return F.when(F.length(a) == 0, False).when(a.rlike("[a-z0-9]"), bounded).otherwise(F.contains(text, a))


def title_tokens(c: Column) -> Column:
    """Distinct runs of a-z, 0-9 and CJK ideographs of more than one character."""
    return F.filter(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9\\u4e00-\\u9fff]+)"), 1)), lambda t: F.length(t) > 1)


# Candidate names.


def cleaned_name(c: Column) -> Column:
    c = F.regexp_replace(strip(c), "^[\"'`]+|[\"'`]+$", "")
    return collapse(F.translate(c, "：–—", ":--"))


def candidate_key(c: Column) -> Column:
    return collapse(F.replace(F.lower(cleaned_name(c)), F.lit(" & "), F.lit(" and ")))


def category_key(category: Column, key: Column) -> Column:
    """A candidate key by the rules of its category."""
    project = key
    for suffix in PROJECT_SUFFIXES:
        project = F.regexp_replace(project, f"(?iU){suffix}", "")
    event = key
    for pattern, to in EVENT_REWRITES:
        event = F.regexp_replace(event, f"(?iU){pattern}", to)
    return F.when(category == "project", strip(project)).when(category == "topic", collapse(key)).when(category == "event_keyword", collapse(event)).otherwise(key)


def is_noise(category: Column, combined: Column) -> Column:
    out = F.lit(False)
    for name, patterns in CANDIDATE_NOISE.items():
        out = out | ((category == name) & combined.rlike("(?iU)" + "|".join(f"(?:{p})" for p in patterns)))
    return out


def title_case(c: Column) -> Column:
    """Each run of letters with a capital first letter."""
    cut = F.regexp_replace(c, r"(?U)(\p{L}+)", "\u0001$1\u0002")
    parts = F.split(cut, "\u0001")
    up = lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 30)))
    return F.replace(F.array_join(F.transform(parts, lambda p: F.when(p.contains("\u0002"), up(p)).otherwise(p)), ""), F.lit("\u0002"), F.lit(""))


def display_name(category: Column, key: Column, fallback: Column) -> Column:
    return F.when(F.coalesce(fallback, F.lit("")) != "", fallback).when(category == "token", F.upper(key)).otherwise(title_case(key))


def review_name(category: Column, name: Column) -> Column:
    """Casing of a reviewed name: tokens upper; all-lower Latin text by word."""
    clean = cleaned_name(name)
    word = lambda w: (
        F.when(w.isin(*SMALL_WORDS), w).when(F.upper(w).isin(*ACRONYMS), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30))))
    )
    cased = F.array_join(F.transform(F.split(clean, " "), word), " ")
    first = F.concat(F.upper(F.substring(cased, 1, 1)), F.substring(cased, 2, 1 << 30))
    lower_latin = clean.rlike("[A-Za-z]") & (clean == F.lower(clean))
    return F.when(clean == "", clean).when(category == "token", F.upper(clean)).when(lower_latin, first).otherwise(clean)


def source_id(category: Column, name: Column) -> Column:
    return F.concat_ws("::", category, name)


# JSON arrays.


def json_text(values: Column) -> Column:
    return F.to_json(F.coalesce(values, F.array().cast("array<string>")))


def json_list(text: Column) -> Column:
    """The texts of a JSON array; none for null, empty text, or anything else."""
    return F.coalesce(F.from_json(F.nullif(strip(text), F.lit("")), "array<string>"), F.array().cast("array<string>"))


# Query and item texts.


def listed(values: Column, default: str) -> Column:
    return first_filled(F.array_join(values, ", "), default=default)


def profile_query(query: Column | None = None) -> Column:
    """The text that stands for a profile row when it is embedded."""
    text = F.concat(
        F.lit("User interest profile for crypto content retrieval.\nInterests: "), listed(F.col("interests"), "crypto market"),
        F.lit("\nFollowed projects: "), listed(F.col("followed_projects"), "none"),
        F.lit("\nMuted topics: "), listed(F.col("muted_topics"), "none"),
        F.lit("\nRisk preference: "), F.coalesce(F.col("risk_preference"), F.lit("medium")),
        F.lit("\nPreferred languages: "), listed(F.col("preferred_languages"), "zh"),
    )
    if query is None:
        return text
    asked = strip(F.coalesce(query, F.lit("")))
    return F.concat(text, F.when(asked != "", F.concat(F.lit("\nCurrent user request: "), asked)).otherwise(""))


def item_text() -> Column:
    """The text that stands for a normalised item when it is embedded."""
    e = F.col("entities")
    terms = F.slice(F.concat(e["projects"], e["tokens"], e["chains"], e["topics"]), 1, 12)
    return F.concat_ws(
        "\n", F.concat(F.lit("Title: "), F.col("title")), F.concat(F.lit("Summary: "), F.col("summary")),
        F.concat(F.lit("Content: "), F.substring("content", 1, 800)), F.concat(F.lit("Entities: "), F.array_join(terms, ", ")),
        F.concat(F.lit("Event type: "), F.col("event_type")), F.concat(F.lit("Source: "), F.col("source_name")),
    )


def content_hash() -> Column:
    return F.md5(item_text().cast("binary"))


def profile_signature() -> Column:
    """Equal for equal profiles, whatever made them."""
    names = ("followed_kols", "followed_projects", "interests", "muted_topics", "preferred_languages", "risk_preference", "user_id")
    return F.sha2(F.to_json(F.struct(*names)).cast("binary"), 256)


def batch_prompt(documents: DataFrame) -> DataFrame:
    """(batch_id, prompt): the documents of each batch, in order of ``ord``, as one text: number, title, source, beginning of the content."""
    c = lambda *names: first_filled(*[F.col(n) for n in names if n in documents.columns])
    title, content = c("translated_title", "title"), c("translated_content", "content", "translated_full_content", "full_content")
    source = F.when(c("source_title", "source_name") == "", "unknown").otherwise(c("source_title", "source_name"))
    shown = F.concat(F.lit("title: "), title, F.lit("\nsource: "), source, F.lit("\ncontent: "), F.substring(content, 1, 500), F.lit("\n"))
    held = documents.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("ord", shown.alias("t")))).alias("d"))
    numbered = F.transform("d", lambda x, i: F.concat(F.lit("[DOC "), (i + 1).cast("string"), F.lit("]\n"), x["t"]))
    return held.select("batch_id", F.array_join(numbered, "\n").alias("prompt"))


def profile_summary() -> Column:
    """A line about a profile; a default phrase if nothing is set."""
    part = lambda label, c, n: F.when(F.size(c) > 0, F.concat(F.lit(label + ": "), F.array_join(F.slice(c, 1, n), ", ")))
    text = F.concat_ws(
        "; ", part("interests", F.col("interests"), 4), part("follows", F.col("followed_projects"), 4), part("mutes", F.col("muted_topics"), 3),
        F.when(F.col("risk_preference") != "", F.concat(F.lit("risk: "), F.col("risk_preference"))), part("languages", F.col("preferred_languages"), 2),
    )
    return first_filled(text, default="no preferences set")
