"""Slots of a question: rule-based extraction, validation of a model's answer, and merging over turns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions import tables as T
from tessella.functions.text import has_any, ladder, unfenced


def group(text: Column, pattern: str) -> Column:
    """The first group of a pattern's first match, or null."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def whole(digits: Column) -> Column:
    """An integer written with commas, or null."""
    return F.replace(digits, F.lit(","), F.lit("")).try_cast("long")


def number(text: Column, name: str) -> Column:
    return whole(group(text, T.NUMBER_PATTERNS[name]))


def state(text: Column) -> Column:
    """The state of the first alias, in the table's order, that is in the text."""
    return ladder(F.lower(text), [(s, (a,)) for a, s in T.STATE_ALIASES.items()])


def years(text: Column, words: tuple[str, ...] = ("service", "worked", "kaam")) -> Column:
    """Years after one of the words, else any whole number of years, else any number of years; rounded down."""
    low = F.lower(text)
    patterns = (T.YEARS_AFTER.format(words="|".join(re.escape(w) for w in words)), *T.YEARS)
    return F.floor(F.coalesce(*[group(low, p).try_cast("double") for p in patterns])).cast("long")


def amount(text: Column, words: tuple[str, ...] = ()) -> Column:
    """Rupees: a number of lakhs, else the first pattern that gives more than 100."""
    patterns = ([r"(?:" + "|".join(re.escape(w) for w in words) + r")\s*(?:is|of|was|=|:)?\s*(?:Rs\.?|₹)?\s*([\d,]+)"] if words else []) + list(T.AMOUNTS)
    plain = [whole(group(text, f"(?i){p}")) for p in patterns]
    lakhs = group(text, f"(?i){T.NUMBER_PATTERNS['lakhs']}").try_cast("double")
    return F.when(lakhs.isNotNull(), (lakhs * 100000).cast("long")).otherwise(F.coalesce(*[F.when(v > 100, v) for v in plain]))


def _rungs(domain: str, slot: str, text: Column, default: str | None = None) -> Column:
    return ladder(text, T.LADDERS[domain, slot], default)


def pf(text: Column) -> dict[str, Column]:
    q = F.lower(text)
    intent = _rungs("pf", "intent", q, "general")
    weeks = number(q, "weeks_ago")
    return {
        "intent": intent, "employment_status": _rungs("pf", "employment_status", q),
        "months_unemployed": F.when(weeks.isNotNull(), F.greatest(F.lit(1).cast("long"), F.floor(weeks / 4))).otherwise(number(q, "months_ago")),
        "service_years": years(q), "uan_status": F.when(F.contains(q, F.lit("uan")), _rungs("pf", "uan_status", q)),
        "kyc_status": F.when(has_any(q, ("kyc", "aadhaar", "aadhar")), _rungs("pf", "kyc_status", q)), "employer_name": F.trim(group(q, T.EMPLOYER_NAME)),
        "incident_type": F.when(intent == "employer_complaint", _rungs("pf", "incident_type", q)),
    }


def payslip(text: Column) -> dict[str, Column]:
    q = F.lower(text)
    epf, esi = number(q, "epf_deducted"), number(q, "esi_deducted")
    return {
        "intent": _rungs("payslip", "intent", q, "general"), "basic_salary": number(q, "basic_salary"), "gross_salary": number(q, "gross_salary"), "epf_deducted": F.when(epf < 50000, epf),
        "esi_deducted": F.when(has_any(q, T.NO_ESI), F.lit(0).cast("long")).when(esi < 10000, esi), "state": state(q), "employee_count": number(q, "employee_count"),
    }


def labour(text: Column) -> dict[str, Column]:
    q = F.lower(text)
    salary = number(q, "last_drawn_salary")
    return {
        "intent": _rungs("labour", "intent", q, "general"), "employment_years": years(q), "termination_reason": _rungs("labour", "termination_reason", q),
        "last_drawn_salary": F.when(salary > 1000, salary), "is_pregnant": _rungs("labour", "is_pregnant", q).cast("boolean"), "employer_type": _rungs("labour", "employer_type", q),
        "state": state(q), "notice_period_days": F.coalesce(number(q, "months_notice") * 30, number(q, "days_notice")),
    }


def tax(text: Column) -> dict[str, Column]:
    q = F.lower(text)
    rungs = T.LADDERS["tax", "intent"]
    intent = F.coalesce(ladder(q, rungs[:4]), F.when(has_any(q, T.TDS_ON_PF_WITH_TDS) & F.contains(q, F.lit("tds")), "tds_on_pf"), ladder(q, rungs[4:], "general"))
    lakhs, income, drawn = group(q, T.NUMBER_PATTERNS["lakhs"]).try_cast("double"), number(q, "income"), number(q, "pf_withdrawal_amount")
    written = group(q, T.NUMBER_PATTERNS["section_80c"])
    invested = written.try_cast("double")
    in_lakhs = F.regexp_like(q, F.concat(F.lit("80[cC].*"), F.replace(written, F.lit("."), F.lit("\\.")), F.lit(r"\s*(?:lakhs?|lacs?|lac)")))
    return {
        "intent": intent, "annual_income": F.when(lakhs.isNotNull(), (lakhs * 100000).cast("long")).when(income > 50000, income), "tax_regime": _rungs("tax", "tax_regime", q),
        "rent_paid": number(q, "rent_paid"), "city_type": _rungs("tax", "city_type", q), "has_form16": _rungs("tax", "has_form16", q).cast("boolean"),
        "section_80c_investments": F.when(in_lakhs | (invested < 10), (invested * 100000).cast("long")).otherwise(invested.cast("long")),
        "pf_withdrawal_amount": F.when(drawn > 1000, drawn), "service_years": years(q),
    }


EXTRACTORS = {"pf": pf, "payslip": payslip, "labour": labour, "tax": tax}


def extract(text: Column, domain: str) -> list[Column]:
    """A domain's slots as named columns; of an unknown domain only a general intent."""
    made = EXTRACTORS[domain](text) if domain in EXTRACTORS else {"intent": F.lit("general")}
    return [c.alias(n) for n, c in made.items()]


def route(text: Column) -> Column:
    """The domain whose keywords in the text have the most words; pf if there is none, ties by priority."""
    q = F.lower(text)
    scores = {d: sum((F.when(F.contains(q, F.lit(k)), len(k.split())).otherwise(0) for k in ks), F.lit(0)) for d, ks in T.DOMAIN_KEYWORDS.items()}
    best = F.array_max(F.array(*[F.struct(scores[d].alias("score"), F.lit(-p).alias("priority"), F.lit(d).alias("domain")) for p, d in enumerate(T.ROUTER_PRIORITY)]))
    return F.when(best["score"] == 0, "pf").otherwise(best["domain"])


def parsed_route(answer: Column) -> Column:
    """(domain, confidence) of a router model's JSON: an unknown domain is pf, no JSON is pf with confidence 0."""
    j = F.from_json(unfenced(answer), "domain string, confidence string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    domain, confidence = F.lower(F.trim(F.coalesce(j["domain"], F.lit("pf")))), F.coalesce(j["confidence"], F.lit("0.5")).try_cast("double")
    ok = j.isNotNull() & j["_bad"].isNull() & confidence.isNotNull()
    return F.struct(F.when(ok & domain.isin(*T.DOMAINS), domain).otherwise("pf").alias("domain"), F.when(ok, confidence).otherwise(F.lit(0.0)).alias("confidence"))


def validated(answer: Column, domain: str) -> list[Column]:
    """A domain's slots out of a model's JSON answer: unknown intents are general, other unknown values and numbers that can't be read are null."""
    j = F.from_json(unfenced(answer), "map<string,string>")
    out = []
    for name, kind in T.SLOTS[domain].items():
        v = F.try_element_at(j, F.lit(name))
        if name == "intent":
            c = F.when(v.isin(*T.VALID_INTENTS[domain]), v).when(v.isNotNull(), "general")
        elif name in T.VALID_VALUES:
            c = F.when(v.isin(*T.VALID_VALUES[name]), v)
        elif kind == "number":
            c = v.try_cast("double").try_cast("long")
        elif kind == "flag":
            c = F.when(F.lower(v).isin("true", "yes", "1"), True).when(F.lower(v).isin("false", "no", "0"), False)
        else:
            c = F.trim(v)
        out.append(c.alias(name))
    return out


def same_value(predicted: Column, expected: Column) -> Column:
    """Equal as flags, else as numbers within 1 after truncation, else as trimmed text without case."""
    a, b = predicted.try_cast("double").try_cast("long"), expected.try_cast("double").try_cast("long")
    return F.when(predicted.isNull() | expected.isNull(), False).when(a.isNotNull() & b.isNotNull(), F.abs(a - b) <= 1).otherwise(F.lower(F.trim(predicted)) == F.lower(F.trim(expected)))
