"""Text, slot and rule functions on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from tessella.functions import rules as R
from tessella.functions import slots as S
from tessella.functions import tables as T
from tessella.functions import text as X
from tessella.operators import knowledge, synthesis


def one(spark, expr, **values):
    """An expression's value on one row."""
    cols = ", ".join(f"{k} {'string' if isinstance(v, str | type(None)) else 'bigint'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], cols).select(expr.alias("v")).first()["v"]


def test_text(spark):
    assert one(spark, X.clean(F.col("t")), t=" a\n\n\nb  c Page 12 d ") == "a b c  d"
    assert one(spark, X.sentences(F.col("t")), t="A b. C?  D! e.f") == ["A b.", "C?", "D!", "e.f"]
    assert one(spark, X.search_tokens(F.col("t")), t="Été, a b_c! x-yz") == ["été", "b_c", "yz"]
    assert one(spark, X.citations(F.col("t")), t="[A_1] [b] [A_1] [C2]") == ["A_1", "C2"]
    assert one(spark, X.encoder_text(F.lit(""), F.col("t"), 2), t="a b c") == "a b"
    assert one(spark, X.json_object(F.col("t")), t="x {\n1} y") == "{\n1}"
    assert one(spark, X.tool_call(F.col("t")), t='Action: GetPolicy("P1")\nAction: SearchKB("q")').asDict() == {"tool": "SearchKB", "argument": "q", "done": False}
    assert one(spark, X.fill(F.col("t"), F.create_map(F.lit("a"), F.lit("1"))), t="{a} {b}") is None


@pytest.mark.parametrize(("text", "want"), [("3.5 years", 5), ("after 7 yrs 2 months", 7), ("worked 4.9 years of 9 years", 4), ("none", None)])
def test_years(spark, text, want):
    assert one(spark, S.years(F.col("t")), t=text) == want


def test_amount_and_state(spark):
    assert one(spark, S.amount(F.col("t")), t="about 14.5 Lakhs") == 1450000
    assert one(spark, S.amount(F.col("t")), t="Rs. 50 then salary is 12,000") == 12000
    assert one(spark, S.state(F.col("t")), t="I live in Goa, near a camp") == "Madhya Pradesh"  # aliases match inside words, in order


def test_route(spark):
    for text, want in (("hello", "pf"), ("gratuity and overtime", "labour"), ("PF balance", "pf"), ("income tax refund", "tax"), (None, "pf")):
        assert one(spark, S.route(F.col("t")), t=text) == want
    got = one(spark, S.parsed_route(F.col("t")), t='```json{"domain": " TAX ", "confidence": 0.7}```')
    assert (got["domain"], got["confidence"]) == ("tax", 0.7)
    assert one(spark, S.parsed_route(F.col("t")), t="no json").asDict() == {"domain": "pf", "confidence": 0.0}


def test_validated(spark):
    df = spark.createDataFrame([('{"intent":"x","basic_salary":"12.9","state":" Goa ","gross_salary":null}',), ("not json",), (None,)], "a string")
    got = [tuple(r) for r in df.select(*S.validated(F.col("a"), "payslip")).collect()]
    assert got == [("general", 12, None, None, None, "Goa", None)] + [(None,) * 7] * 2


def gate(spark, domain, **slots):
    m = F.create_map(*[F.lit(x) for kv in slots.items() for x in kv])
    return one(spark, R.gate(m, F.lit(domain)))


def test_gate(spark):
    assert gate(spark, "pf", intent="full_withdrawal")["missing"] == ["employment_status"]
    assert gate(spark, "pf", intent="full_withdrawal", employment_status="retired")["sufficient"]
    esi = gate(spark, "payslip", intent="verify_esi")
    assert esi["missing"] == ["gross_salary", "esi_deducted"] and esi["question"] == T.GATE_QUESTIONS["gross_salary"]
    assert gate(spark, "payslip", intent="verify_esi", gross_salary="0", esi_deducted="0")["sufficient"]
    assert gate(spark, "tax", intent="refund_status")["sufficient"] and gate(spark, "tax", other="1")["sufficient"]


@pytest.mark.parametrize(("slot", "op", "value", "want"), [
    ("5", "gte", "5", "RESOLVED_MET"), ("4", "gte", "5", "RESOLVED_NOT_MET"), (None, "gte", "5", "UNRESOLVED"), ("abc", "lt", "5", "UNRESOLVED"), ("NaN", "gt", "1", "RESOLVED_NOT_MET"),
    (" Done ", "eq", "verified", "RESOLVED_MET"), ("x", "not_null", None, "RESOLVED_MET"), (None, "not_null", None, "UNRESOLVED"), ("x", "like", "x", "RESOLVED_NOT_MET"),
])
def test_status(spark, slot, op, value, want):
    assert one(spark, R.status(F.col("s"), F.col("o"), F.col("v")), s=slot, o=op, v=value) == want


@pytest.mark.parametrize(("statuses", "decision", "eligible", "coverage"), [
    ("MM", "ANSWER", True, 1.0), ("MNU", "ANSWER", False, 0.67), ("MU", "ASK", None, 0.5), ("", "ESCALATE", None, 0.0), ("w", "ESCALATE", None, 0.0),
])
def test_resolved(spark, statuses, decision, eligible, coverage):
    names = {"M": "RESOLVED_MET", "N": "RESOLVED_NOT_MET", "U": "UNRESOLVED", "w": "RESOLVED_MET"}
    df = spark.createDataFrame([([("age", names[s], s != "w") for s in statuses],)], "c array<struct<field:string,status:string,mandatory:boolean>>")
    r = df.select(R.resolved(F.col("c")).alias("r")).first()["r"]
    assert (r["decision"], r["eligible"], r["coverage"]) == (decision, eligible, coverage)
    assert (r["question"] == "How old are you?") == (decision == "ASK")


def test_conditions_grammar(spark):
    assert tuple(one(spark, R.parsed_condition(F.col("t")), t="employment_years >= 5")) == ("employment_years", "gte", "5")
    assert tuple(one(spark, R.parsed_condition(F.col("t")), t="rent is known")) == ("rent", "not_null", None)
    assert one(spark, R.parsed_condition(F.col("t")), t="something else") is None


PAYSLIPS = [
    ((20000, 25000, 2400, None, "Maharashtra"), {"EPF": (2400, "CORRECT"), "ESI": (0, "NOT_APPLICABLE"), "Professional Tax": (200, "COMPUTED")}),
    ((20000, 25000, 1800, None, "Karnataka"), {"EPF": (2400, "UNDER_DEDUCTED"), "ESI": (0, "NOT_APPLICABLE"), "Professional Tax": (150, "COMPUTED")}),
    ((15000, 28000, None, 0, "Karnataka"), {"EPF": (1800, "NO_ACTUAL"), "ESI": (0, "CORRECT"), "Professional Tax": (150, "COMPUTED")}),
    ((15000, 25000, None, 500, "Tamil Nadu"), {"EPF": (1800, "NO_ACTUAL"), "ESI": (0, "SHOULD_NOT_DEDUCT"), "Professional Tax": (208, "COMPUTED")}),
    ((20000, 30000, None, None, "Delhi"), {"EPF": (2400, "NO_ACTUAL"), "ESI": (0, "NOT_APPLICABLE"), "Professional Tax": (0, "COMPUTED")}),
    ((10000, 18500, None, 139, "Telangana"), {"EPF": (1200, "NO_ACTUAL"), "ESI": (139, "CORRECT"), "Professional Tax": (150, "COMPUTED")}),
    ((None, None, 1, 1, "Goa"), {}),
    ((None, 30000, None, None, None), {"ESI": (0, "NOT_APPLICABLE"), "Professional Tax": (None, "CANNOT_COMPUTE")}),
]


def test_payslip_audit(spark):
    df = spark.createDataFrame([(n, *v) for n, (v, _) in enumerate(PAYSLIPS)], "n int, basic_salary long, gross_salary long, epf_deducted long, esi_deducted long, state string")
    got = {}
    for r in R.audit(df).collect():
        got.setdefault(r["n"], {})[r["kind"]] = (r["expected"], r["verdict"])
    assert [got.get(n, {}) for n in range(len(PAYSLIPS))] == [w for _, w in PAYSLIPS]


@pytest.mark.parametrize(("gross", "want"), [(600, 4), (1400, 10), (200, 2), (21000, 158), (21001, 0)])
def test_esi_rounds_half_to_even(spark, gross, want):
    assert one(spark, R.esi(F.col("g"))["expected"], g=gross) == want


@pytest.mark.parametrize(("salary", "want"), [(14999, 0), (15000, 150), (29999, 150), (30000, 200)])
def test_slab_bounds(spark, salary, want):
    df = spark.createDataFrame([(salary, "Karnataka")], "s long, state string")
    assert R.with_pt(df, F.col("s"), F.col("state")).first()["pt"] == want


def test_chunks():
    words = lambda n: " ".join(["w"] * (n - 1) + ["w."])
    assert [len(c.split()) for c, _ in knowledge.chunk(" ".join([words(200), words(200), words(100)]))] == [200, 364]
    assert [c for c, _ in knowledge.chunk(words(400))][0] == "" and knowledge.chunk("") == []
    parts = knowledge.chunk(" ".join(words(150) for _ in range(5)))
    assert parts[1][1] == len(parts[0][0])


def test_every_verdict_turns_into_its_opposite(spark):
    """In one pass, so that nothing is turned twice."""
    want = {
        "You are eligible. He is Not eligible, they are ineligible.": "You are Not eligible. He is Eligible, they are Eligible.", "This is correct and that is incorrect": "This is incorrect and that is correct",
        "EPF— **matches** it": "EPF— **does not match** it", "EPF — **matches**": "EPF — **matches**", "it matches expected pay": "it does not match expected pay", "not applicable, applicable": "applicable, not applicable",
        "Applicable: Yes": "not applicable: No", "Applicable: No": "not applicable: No", "Applicable: None": "not applicable: None", "Not applicable": "Not not applicable", "eligible": "Not eligible", "noneligible misapplicable": "noneligible misapplicable", "": "", "eligibleeligible": "eligibleeligible",
    }
    df = spark.createDataFrame([(k, t) for k, t in enumerate(want)], "id long, t string")
    assert {r["t"]: r["f"] for r in df.select("t", synthesis.flip_verdict(F.col("t"), F.col("id")).alias("f")).collect()} == want
