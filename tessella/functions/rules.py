"""Rules over slots: the sufficiency gate, conditions of three outcomes, and pay computations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import tables as T


def mapped(key: Column, table: dict[str, str], default: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), default)


def question(field: Column, table: dict[str, str]) -> Column:
    return mapped(field, table, F.concat(F.lit("Could you provide your "), F.replace(field, F.lit("_"), F.lit(" ")), F.lit("?")))


def gate(slots: Column, domain: Column) -> Column:
    """(sufficient, question, missing): whether the slots (a string map with intent) have what the intent needs. 0 and false are values."""
    intent = F.try_element_at(slots, F.lit("intent"))
    needed = F
    for (i, d), names in T.REQUIRED_SLOTS.items():
        needed = needed.when((intent == i) & (domain == d), F.array(*[F.lit(n) for n in names]))
    required = F.when(intent.isNull() | intent.isin(*T.CONTEXT_FREE_INTENTS), F.array().cast("array<string>")).otherwise(F.coalesce(needed.otherwise(None), F.array().cast("array<string>")))
    missing = F.filter(required, lambda n: F.try_element_at(slots, n).isNull())
    first = F.get(missing, 0)
    return F.struct((F.size(missing) == 0).alias("sufficient"), F.when(first.isNotNull(), question(first, T.GATE_QUESTIONS)).alias("question"), missing.alias("missing"))


def normal(value: Column) -> Column:
    v = F.lower(F.trim(value))
    return mapped(v, T.VALUE_ALIASES, v)


def status(slot: Column, operator: Column, value: Column, values: Column | None = None, aliases: bool = True) -> Column:
    """RESOLVED_MET, RESOLVED_NOT_MET or UNRESOLVED. No slot, or a comparison of what is no number, is unresolved; NaN meets nothing; an unknown operator isn't met."""
    a, b = slot.try_cast("double"), value.try_cast("double")
    real = ~F.isnan(a) & ~F.isnan(b)
    norm = normal if aliases else (lambda c: F.lower(c))
    within = F.exists(values, lambda v: norm(v) == norm(slot)) if values is not None else F.lit(None).cast("boolean")
    met = (
        F.when(operator == "gte", (a >= b) & real).when(operator == "lte", (a <= b) & real).when(operator == "gt", (a > b) & real).when(operator == "lt", (a < b) & real)
        .when(operator == "eq", norm(slot) == norm(value)).when(operator == "in", within).when(operator == "not_null", True).otherwise(False)
    )
    return F.when(slot.isNull() | met.isNull(), "UNRESOLVED").when(met, "RESOLVED_MET").otherwise("RESOLVED_NOT_MET")


def parsed_condition(text: Column) -> Column:
    """(field, operator, value) of `field == value` and its like, or of `field is known`; null for other texts."""
    known = F.regexp_extract(text, r"^\s*(\w+)\s+is\s+known\s*$", 1)
    part = lambda k: F.regexp_extract(text, r"^\s*(\w+)\s*(==|>=|<=|>|<)\s*(.+?)\s*$", k)
    names = F.create_map(*[F.lit(x) for kv in (("==", "eq"), (">=", "gte"), ("<=", "lte"), (">", "gt"), ("<", "lt")) for x in kv])
    made = lambda f, o, v: F.struct(f.alias("field"), o.alias("operator"), v.alias("value"))
    return F.when(known != "", made(known, F.lit("not_null"), F.lit(None).cast("string"))).when(part(1) != "", made(part(1), F.try_element_at(names, part(2)), part(3)))


def resolved(statuses: Column) -> Column:
    """(decision, eligible, question, coverage, met, failed, unresolved, warnings) of checked conditions, an array of structs with field, status and mandatory."""
    mandatory = lambda c: F.coalesce(c["mandatory"], F.lit(True))
    of = lambda s: F.filter(statuses, lambda c: mandatory(c) & (c["status"] == s))
    met, failed, open_ = of("RESOLVED_MET"), of("RESOLVED_NOT_MET"), of("UNRESOLVED")
    n = F.size(F.filter(statuses, mandatory))
    any_failed, any_open = F.size(failed) > 0, F.size(open_) > 0
    coverage = F.when(n == 0, F.lit(0.0)).otherwise(F.bround((F.size(met) + F.size(failed)) / n, 2))
    return F.struct(
        F.when(any_failed, "ANSWER").when(any_open, "ASK").when(n == 0, "ESCALATE").otherwise("ANSWER").alias("decision"),
        F.when(any_failed, False).when(any_open | (n == 0), F.lit(None)).otherwise(True).alias("eligible"),
        F.when(~any_failed & any_open, question(F.get(open_, 0)["field"], T.REASONER_QUESTIONS)).alias("question"), coverage.alias("coverage"),
        met.alias("met"), failed.alias("failed"), open_.alias("unresolved"), F.filter(statuses, lambda c: ~mandatory(c) & (c["status"] == "RESOLVED_MET")).alias("warnings"),
    )


def epf(basic: Column) -> dict[str, Column]:
    employee = F.bround(basic * F.lit(0.12)).cast("long")
    eps = F.bround(F.least(basic, F.lit(15000)) * F.lit(0.0833)).cast("long")
    return {"expected": employee, "employer_eps": eps, "employer_epf": employee - eps}


def esi(gross: Column) -> dict[str, Column]:
    applies = gross <= 21000
    share = lambda rate: F.when(applies, F.bround(gross * F.lit(rate)).cast("long")).otherwise(F.lit(0).cast("long"))
    return {"applicable": applies, "expected": share(0.0075), "employer": share(0.0325)}


def pt_slabs(spark: SparkSession) -> DataFrame:
    """(pt_state, above, up_to, amount): salaries in (above, up_to]; exempt states have one slab of 0. A few dozen rows."""
    rows = [(s, None, None, 0) for s in T.PT_EXEMPT_STATES]
    for s, slabs in T.PT_SLABS.items():
        low = None
        for high, amount in slabs:
            rows.append((s, low, high, amount))
            low = high
    return spark.createDataFrame(rows, "pt_state string, above long, up_to long, amount long")


def with_pt(df: DataFrame, salary: Column, state: Column) -> DataFrame:
    """df with pt: the monthly professional tax, null where state or salary has no slab."""
    slabs = F.broadcast(pt_slabs(df.sparkSession))  # fixed size
    hit = salary.isNotNull() & (state == F.col("pt_state")) & (F.col("above").isNull() | (salary > F.col("above"))) & (F.col("up_to").isNull() | (salary <= F.col("up_to")))
    return df.join(slabs, hit, "left").withColumnRenamed("amount", "pt").drop("pt_state", "above", "up_to")


def deduction_verdict(actual: Column, expected: Column) -> Column:
    d = actual - expected
    return F.when(actual.isNull(), "NO_ACTUAL").when(F.abs(d) <= 1, "CORRECT").when(d < 0, "UNDER_DEDUCTED").otherwise("OVER_DEDUCTED")


def audit(df: DataFrame) -> DataFrame:
    """Up to three rows (kind, expected, actual, verdict) for each row of df (basic_salary, gross_salary, epf_deducted, esi_deducted, state); a part without its salary is left out."""
    basic, salary = F.col("basic_salary"), F.coalesce("gross_salary", "basic_salary")
    taxed = with_pt(df, salary, F.col("state"))
    e = esi(salary)
    esi_verdict = F.when(e["applicable"], deduction_verdict(F.col("esi_deducted"), e["expected"])).when(F.col("esi_deducted").isNull(), "NOT_APPLICABLE").when(F.col("esi_deducted") == 0, "CORRECT").otherwise("SHOULD_NOT_DEDUCT")
    row = lambda test, kind, expected, actual, verdict: F.when(test, F.struct(F.lit(kind).alias("kind"), expected.cast("long").alias("expected"), actual.cast("long").alias("actual"), verdict.alias("verdict")))
    rows = F.array_compact(F.array(
        row(basic.isNotNull(), "EPF", epf(basic)["expected"], F.col("epf_deducted"), deduction_verdict(F.col("epf_deducted"), epf(basic)["expected"])),
        row(salary.isNotNull(), "ESI", e["expected"], F.col("esi_deducted"), esi_verdict),
        row(salary.isNotNull(), "Professional Tax", F.col("pt"), F.lit(None), F.when(F.col("pt").isNotNull(), "COMPUTED").otherwise("CANNOT_COMPUTE")),
    ))
    return taxed.withColumn("d", F.explode(rows)).select(*df.columns, "d.*")


def audit_text(basic: Column, gross: Column, state: Column, deductions: Column) -> Column:
    """An audit as text; a salary of 0 or null is `not provided`. deductions: structs of audit() in order."""
    money = lambda c: F.when(c.isNull() | (c == 0), "not provided").otherwise(F.concat(F.lit("₹"), F.format_number(c, 0)))
    lines = F.transform(deductions, lambda d: F.concat(F.lit("  ["), d["kind"], F.lit("]\n    Expected: "), F.coalesce(F.format_number(d["expected"], 0), F.lit("unknown")), F.lit("\n    Verdict: "), d["verdict"], F.lit("\n")))
    head = F.concat_ws("\n", F.lit("PAYSLIP AUDIT RESULT:"), F.concat(F.lit("  Basic Salary: "), money(basic)), F.concat(F.lit("  Gross Salary: "), money(gross)), F.concat(F.lit("  State: "), F.coalesce(F.nullif(state, F.lit("")), F.lit("not provided"))), F.lit(""))
    return F.concat_ws("\n", head, F.array_join(lines, "\n"))


def gratuity(salary: Column, years: Column) -> Column:
    """15/26 of a month's salary for each year, from five years on, rounded down."""
    return F.when(years >= 5, (salary * 15 * years / 26).cast("long")).otherwise(F.lit(0).cast("long"))


def hra_parts(basic: Column, rent: Column, metro: Column) -> dict[str, Column]:
    return {"rent_less_tenth": rent - F.bround(basic * F.lit(0.1)).cast("long"), "share_of_basic": F.bround(basic * F.when(metro, 0.5).otherwise(0.4)).cast("long")}


def section_80c(invested: Column, regime: Column) -> Column:
    return F.when(regime == "new_regime", F.lit(0).cast("long")).otherwise(F.least(invested, F.lit(150000).cast("long")))


def tds_on_withdrawal(amount: Column, years: Column) -> Column:
    return F.when((years >= 5) | (amount <= 50000), F.lit(0).cast("long")).otherwise(F.bround(amount * F.lit(0.1)).cast("long"))
