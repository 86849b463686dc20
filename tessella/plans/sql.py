"""DuckDB expressions for the oracles, written out of the same fixed tables."""

from __future__ import annotations

import re

from tessella.functions import tables as T


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_of(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, {text(w)})" for w in words) + ")"


def ladder(c: str, rungs, default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {any_of(c, words)} THEN {text(v)}" for v, words in rungs) + f" ELSE {default} END"


def group(c: str, pattern: str, k: int = 1) -> str:
    return f"nullif(regexp_extract({c}, {text(pattern)}, {k}), '')"


def whole(e: str) -> str:
    return f"try_cast(replace({e}, ',', '') AS BIGINT)"


def number(c: str, name: str) -> str:
    return whole(group(c, T.NUMBER_PATTERNS[name]))


def double(e: str) -> str:
    return f"try_cast({e} AS DOUBLE)"


def years(c: str) -> str:
    patterns = (T.YEARS_AFTER.format(words="|".join(re.escape(w) for w in ("service", "worked", "kaam"))), *T.YEARS)
    return f"floor(coalesce({', '.join(double(group(c, p)) for p in patterns)}))::BIGINT"


def state(c: str) -> str:
    return ladder(c, [(s, (a,)) for a, s in T.STATE_ALIASES.items()])


def rungs(c: str, domain: str, slot: str, default: str = "NULL") -> str:
    return ladder(c, T.LADDERS[domain, slot], default)


def slots(domain: str, c: str) -> dict[str, str]:
    """Expressions of a domain's slots on a lower-cased column."""
    L = lambda slot, default="NULL": rungs(c, domain, slot, default)  # noqa: E731, N806
    when = lambda test, then: f"CASE WHEN {test} THEN {then} END"
    if domain == "pf":
        weeks = number(c, "weeks_ago")
        return {
            "intent": L("intent", "'general'"), "employment_status": L("employment_status"), "months_unemployed": f"CASE WHEN {weeks} IS NOT NULL THEN greatest(1, {weeks} // 4) ELSE {number(c, 'months_ago')} END",
            "service_years": years(c), "uan_status": when(f"contains({c}, 'uan')", L("uan_status")), "kyc_status": when(any_of(c, ("kyc", "aadhaar", "aadhar")), L("kyc_status")),
            "employer_name": f"trim({group(c, T.EMPLOYER_NAME)})", "incident_type": when(f"{L('intent', chr(39) + 'general' + chr(39))} = 'employer_complaint'", L("incident_type")),
        }
    if domain == "payslip":
        epf, esi = number(c, "epf_deducted"), number(c, "esi_deducted")
        return {
            "intent": L("intent", "'general'"), "basic_salary": number(c, "basic_salary"), "gross_salary": number(c, "gross_salary"), "epf_deducted": when(f"{epf} < 50000", epf),
            "esi_deducted": f"CASE WHEN {any_of(c, T.NO_ESI)} THEN 0 WHEN {esi} < 10000 THEN {esi} END", "state": state(c), "employee_count": number(c, "employee_count"),
        }
    if domain == "labour":
        pay = number(c, "last_drawn_salary")
        return {
            "intent": L("intent", "'general'"), "employment_years": years(c), "termination_reason": L("termination_reason"), "last_drawn_salary": when(f"{pay} > 1000", pay),
            "is_pregnant": f"({L('is_pregnant')})::BOOLEAN", "employer_type": L("employer_type"), "state": state(c), "notice_period_days": f"coalesce({number(c, 'months_notice')} * 30, {number(c, 'days_notice')})",
        }
    r = T.LADDERS["tax", "intent"]
    lakhs, income, drawn, inv = double(group(c, T.NUMBER_PATTERNS["lakhs"])), number(c, "income"), number(c, "pf_withdrawal_amount"), group(c, T.NUMBER_PATTERNS["section_80c"])
    in_lakhs = f"coalesce(regexp_matches({c}, concat('80[cC].*', replace({inv}, '.', '\\.'), '\\s*(?:lakhs?|lacs?|lac)')) AND {inv} IS NOT NULL, false)"
    return {
        "intent": f"coalesce({ladder(c, r[:4])}, CASE WHEN {any_of(c, T.TDS_ON_PF_WITH_TDS)} AND contains({c}, 'tds') THEN 'tds_on_pf' END, {ladder(c, r[4:], chr(39) + 'general' + chr(39))})",
        "annual_income": f"CASE WHEN {lakhs} IS NOT NULL THEN trunc({lakhs} * 100000)::BIGINT WHEN {income} > 50000 THEN {income} END", "tax_regime": L("tax_regime"), "rent_paid": number(c, "rent_paid"),
        "city_type": L("city_type"), "has_form16": f"({L('has_form16')})::BOOLEAN", "section_80c_investments": f"CASE WHEN {in_lakhs} OR {double(inv)} < 10 THEN trunc({double(inv)} * 100000)::BIGINT ELSE trunc({double(inv)})::BIGINT END",
        "pf_withdrawal_amount": when(f"{drawn} > 1000", drawn), "service_years": years(c),
    }


def route(c: str) -> str:
    score = {d: "(" + " + ".join(f"CASE WHEN contains({c}, {text(k)}) THEN {len(k.split())} ELSE 0 END" for k in ks) + ")" for d, ks in T.DOMAIN_KEYWORDS.items()}
    best = f"greatest({', '.join(score[d] for d in T.ROUTER_PRIORITY)})"
    return "CASE " + " ".join(f"WHEN {score[d]} = {best} THEN '{d}'" for d in T.ROUTER_PRIORITY) + " END"


def required() -> str:
    """Rows (intent, domain, pos, slot)."""
    return "(VALUES " + ", ".join(f"('{i}', '{d}', {p}, '{s}')" for (i, d), names in T.REQUIRED_SLOTS.items() for p, s in enumerate(names)) + ") AS need(intent, domain, pos, slot)"


def pairs(table: dict, names: str) -> str:
    return "(VALUES " + ", ".join(f"({text(k)}, {text(v)})" for k, v in table.items()) + f") AS {names}"
