"""Registration of queries, and inputs that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.operators.storage import cut, shared_dir  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SPREAD_ROWS = 20_000


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt by a key into partitions of about SPREAD_ROWS. A narrow table is a few row groups, each read by one task; where a row takes much work, the work is
    so split by rows and not by bytes. The number is given, so that adaptive execution doesn't merge partitions of few bytes."""
    return rows.repartition(max(1, -(-rows.count() // SPREAD_ROWS)), key)


#: Questions of each domain; {a} an amount, {y} years, {s} a place. Written for these queries.
QUESTIONS = (
    ("pf", "I left my job {y} months ago, can I withdraw my PF? I worked {y} years in all"),
    ("pf", "my employer Acme Tools has not deposit anything, UAN is inactive"),
    ("pf", "how do I transfer my pf account to the new company, uan not generated"),
    ("pf", "KYC not done on the unified portal, aadhaar name mismatch for {y} weeks now, since {y} weeks ago"),
    ("pf", "Will TDS be cut on my provident fund withdrawal after service of {y} years?"),
    ("pf", "Pension scheme question: I am retired, nominee details attached"),
    ("payslip", "My basic salary is {a} and gross salary {a}, pf deducted 1,800 in {s}"),
    ("payslip", "Is ESI right? gross pay of {a}, esi cut {y} this month, office in {s}"),
    ("payslip", "Please do a full audit of my salary slip: basic {a}"),
    ("payslip", "minimum wage in {s} for {y} workers, gross is {a}"),
    ("payslip", "When is the statutory bonus paid? no esi on my pay slip"),
    ("payslip", "professional tax deduction looks wrong in {s}, basic pay {a}"),
    ("labour", "Gratuity after I worked {y} years with salary of {a}?"),
    ("labour", "I was fired from a factory in {s} without notice period of {y} days notice"),
    ("labour", "maternity leave at a private company in {s}, I am pregnant"),
    ("labour", "overtime for 12 hours at a retail shop, pay was {a}"),
    ("labour", "terminated after {y} yrs, {y} months notice was promised"),
    ("labour", "I resigned from a government post, what about the industrial dispute?"),
    ("tax", "House rent allowance: rent of {a} in {s}, old regime, income is {y} lakhs"),
    ("tax", "80C investment of {y} lakh under the new regime"),
    ("tax", "have form 16, income tax on salary {a}"),
    ("tax", "pf withdrawal of {a} with tds after worked {y} years"),
    ("tax", "refund of tax not received, form 16 nahi mila"),
    ("tax", "it return for income of {a} in a non-metro city"),
)
PLACES = ("Pune", "Delhi", "Bengaluru", "Chennai", "Kolkata", "Hyderabad", "Lucknow", "Mumbai", "Kochi in Kerala", "Patna in Bihar", "Jaipur in Rajasthan")


def question_sql(n: str, domain: bool = False) -> str:
    """SQL, for either engine, of the question (or its domain) that a number n chooses."""
    if domain:
        return "CASE " + " ".join(f"WHEN {n} % {len(QUESTIONS)} = {k} THEN '{d}'" for k, (d, _) in enumerate(QUESTIONS)) + " END"
    amount, years = f"cast(1000 + ({n} * 7919) % 59000 AS string)", f"cast(1 + ({n} * 31) % 17 AS string)"
    place = "CASE " + " ".join(f"WHEN {n} % {len(PLACES)} = {k} THEN '{p}'" for k, p in enumerate(PLACES)) + " END"
    q = "CASE " + " ".join(f"WHEN {n} % {len(QUESTIONS)} = {k} THEN '{t}'" for k, (_, t) in enumerate(QUESTIONS)) + " END"
    return f"replace(replace(replace({q}, '{{a}}', {amount}), '{{y}}', {years}), '{{s}}', {place})"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, domain, q) of every customer."""
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", f"{question_sql('c_custkey', True)} AS domain", f"{question_sql('c_custkey')} AS q")


QUESTIONS_SQL = f"(SELECT c_custkey AS id, {question_sql('c_custkey', True)} AS domain, {question_sql('c_custkey')} AS q FROM customer)"
