"""Text expressions. Each takes and returns Columns and stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions import tables as T


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once and not again wherever body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def clean(text: Column) -> Column:
    """One line: runs of white space are one space, then page marks go. The marks' own spaces stay."""
    lines = F.regexp_replace(text, r"\n+", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(lines, r"\s+", " "), r"Page \d+", ""))


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?]) +")


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(split_words(text))


def search_tokens(text: Column) -> Column:
    """Lower-case words of letters, digits and underscores, longer than one character."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " "), r"\s+"), lambda t: F.length(t) > 1)


def plain_tokens(text: Column) -> Column:
    """Lower-case runs without white space."""
    return split_words(F.lower(text))


def forms(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(T.FORM), F.lit(0))


def citations(text: Column) -> Column:
    """Distinct cited ids, in order of first mention."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(T.CITATION), F.lit(1)))


def has_any(text: Column, words: Iterable[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def ladder(text: Column, rungs: Iterable[tuple[str, Iterable[str]]], default: str | None = None) -> Column:
    """The value of the first rung one of whose words is in the text."""
    out = F
    for value, words in rungs:
        out = out.when(has_any(text, words), F.lit(value))
    return out.otherwise(F.lit(default))


def topic(text: Column) -> Column:
    return ladder(F.lower(text), (("withdrawal", ("withdrawal",)), ("kyc", ("kyc",)), ("pension", ("pension",)), ("tax", ("tds",))), "general")


def rule_conditions(text: Column) -> Column:
    """Conditions that three rules find: (field, operator, value, outcome, kind)."""
    t = F.lower(text)
    made = lambda test, *v: F.when(test, F.struct(*[F.lit(x).alias(n) for n, x in zip(("field", "operator", "value", "outcome", "kind"), v, strict=True)]))
    return F.array_compact(F.array(
        made(F.contains(t, F.lit("less than 5 years")), "service_years", "lt", "5", "TDS_APPLICABLE", "WARNING"),
        made(has_any(t, ("more than 50000", "above 50000")), "withdrawal_amount", "gt", "50000", "TDS_APPLICABLE", "WARNING"),
        made(F.contains(t, F.lit("kyc")) & F.contains(t, F.lit("complete")), "kyc_status", "eq", "complete", "ELIGIBLE", "MANDATORY"),
    ))


def encoder_text(title: Column, content: Column, limit: int = 500) -> Column:
    """What an encoder reads of a passage: `title: content` (content alone without a title), its first `limit` words."""
    whole = F.when(F.coalesce(title, F.lit("")) == "", content).otherwise(F.concat(title, F.lit(": "), content))
    return F.array_join(F.slice(split_words(whole), 1, limit), " ")


def unfenced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "```json|```", ""))


def json_object(text: Column) -> Column:
    """The widest {...} in a text, or null."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def tool_call(text: Column) -> Column:
    """(tool, argument, done) of an agent's output: the first tool, in a fixed order, that it calls."""
    arg = lambda tool: F.nullif(F.regexp_extract(text, rf"""Action:\s*{tool}\(["'](.+?)["']\)""", 1), F.lit(""))
    search, policy = arg("SearchKB"), arg("GetPolicy")
    tool = F.when(search.isNotNull(), "SearchKB").when(policy.isNotNull(), "GetPolicy").when(text.rlike(r"Action:\s*ParsePayslip\(\)"), "ParsePayslip")
    return F.struct(tool.alias("tool"), F.coalesce(search, policy).alias("argument"), F.contains(text, F.lit("Done:")).alias("done"))


def slot_key(slots: Column) -> Column:
    """k=v of a string map, sorted, with | between."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(slots), lambda e: F.concat_ws("=", e["key"], e["value"]))), "|")


def fill(template: Column, slots: Column) -> Column:
    """A template with its {slot}s filled from a string map; null if one of them has no value."""
    filled = F.aggregate(F.map_entries(slots), template, lambda acc, e: F.when(e["value"].isNull(), acc).otherwise(F.replace(acc, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"])))
    return once(filled, lambda t: F.when(~t.rlike(r"\{\w+\}"), t))


def cites_line(hit: Column, place: Column, limit: int = 1500) -> Column:
    """A passage as a prompt shows it."""
    return F.format_string("[Source %d] doc_id=%s | date=%s | domain=%s\n%s", place, hit["doc_id"], F.coalesce(hit["effective_date"], F.lit("None")), hit["domain"], F.substring(hit["content"], 1, limit))


def prompt_block(hits: Column, limit: int = 1500) -> Column:
    """Passages (an array in their order) joined as a prompt shows them."""
    return F.array_join(F.transform(hits, lambda h, i: cites_line(h, i + 1, limit)), "\n\n---\n\n")
