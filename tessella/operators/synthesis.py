"""Training data: hash-based choices, templates, contrastive answers, validation, quotas and splits.

Every choice is a hash of the row's number and a name, so results don't depend on order or partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import answers as A
from tessella.functions import rules as R
from tessella.functions import tables as T
from tessella.functions import text as X


def draw(key: Column, name: str, n: int | Column) -> Column:
    """A number in [0, n), by the first 28 bits of an MD5 that other engines have too."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), F.lit(name))), 1, 7), 16, 10).cast("long"), n if isinstance(n, Column) else F.lit(n)).cast("int")


def choice(key: Column, name: str, values: tuple) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), draw(key, name, len(values)))


def payslip_slots(rows: DataFrame, key: str) -> DataFrame:
    """Adds a consistent payslip: basic, gross, and deductions that are right for 60 of 100 rows."""
    k = F.col(key)
    rows = rows.withColumn("basic_salary", choice(k, "basic", (9000, 12000, 15000, 18000, 22000, 30000)).cast("long"))
    rows = rows.withColumn("gross_salary", F.col("basic_salary") + choice(k, "extra", (3000, 5000, 7000, 10000)))
    due = F.bround(F.col("basic_salary") * F.lit(0.12)).cast("long")
    due_esi = F.when(F.col("gross_salary") <= 21000, F.bround(F.col("gross_salary") * F.lit(0.0075)).cast("long")).otherwise(F.lit(0))
    right = lambda name: draw(k, name, 100) < 60
    return rows.withColumn("epf_deducted", F.when(right("epf_ok"), due).otherwise(due + choice(k, "epf_off", (-600, -300, 300, 600)))).withColumn("esi_deducted", F.when(right("esi_ok") | (F.col("gross_salary") > 21000), due_esi).otherwise(due_esi + choice(k, "esi_off", (-50, 50, 100))))


def trace(conditions: Column) -> Column:
    """(decision, eligible, coverage) of a synthesised trace: coverage counts met ones alone, and unmet optional conditions only warn."""
    of = lambda test: F.size(F.filter(conditions, test))
    mandatory = lambda c: F.coalesce(c["mandatory"], F.lit(True))
    met, open_ = of(lambda c: c["met"]), of(lambda c: c["met"].isNull())
    failed = of(lambda c: ~c["met"] & mandatory(c))
    total = met + failed + open_
    ask = (open_ > 0) & (met + failed == 0)
    made = F.struct(F.when(ask, "ASK").otherwise("ANSWER").alias("decision"), F.when(ask, F.lit(None)).otherwise(failed == 0).alias("eligible"), F.when(ask, F.lit(None)).when(total == 0, 1.0).otherwise(F.bround(met / total, 2)).alias("coverage"))
    return F.when(F.size(conditions) > 0, made)


def _check(*tests: tuple[Column, Column | str]) -> Column:
    out = F
    for bad, reason in tests:
        out = out.when(bad, reason if isinstance(reason, Column) else F.lit(reason))
    return out.otherwise(F.lit("ok"))


def _read(answer: Column, **more: Column) -> Column:
    """What the validators ask of an answer, worked out once for all their tests: its lower case, words and citations."""
    return F.struct(F.lower(answer).alias("low"), X.word_count(answer).alias("n"), X.citations(answer).alias("cited"), *[c.alias(k) for k, c in more.items()])


def sft_reason(answer: Column, allowed: Column) -> Column:
    """`ok` or the first reason against a training answer; allowed: ids it may cite."""
    def of(a: Column) -> Column:
        low, cited, n, made_up = a["low"], a["cited"], a["n"], F.array_sort(F.array_except(a["cited"], allowed))
        refused = [(F.contains(low, F.lit(p)), f"refusal: '{p}'") for p in T.SFT_REFUSALS]
        tool = F.array_contains(allowed, T.TOOL_DOC) & ~F.array_contains(cited, T.TOOL_DOC)
        return _check((n < 60, "too short"), (n > 450, "too long"), *refused, (F.size(cited) == 0, "no citations"), (F.size(made_up) > 0, F.concat(F.lit("fabricated cites: "), F.array_join(F.slice(made_up, 1, 3), ", "))),
                      (tool, "tool passage not cited"), (~X.has_any(low, T.SFT_VERDICTS), "no verdict keyword"))

    return X.once(_read(answer), of)


def chosen_reason(answer: Column, allowed: Column, dimension: Column) -> Column:
    refusal = dimension == "refusal_and_escalation"

    def of(a: Column) -> Column:
        low, cited, n, made_up = a["low"], a["cited"], a["n"], F.array_sort(F.array_except(a["cited"], allowed))
        return _check((n < 40, "chosen too short"), (n > 550, "chosen too long"), (refusal & ~X.has_any(low, T.DPO_REFUSAL_SIGNALS), "chosen missing refusal/escalation signal"), (refusal, "ok"),
                      *[(F.contains(low, F.lit(p)), f"chosen accidental refusal: {p}") for p in T.DPO_REFUSALS], (F.size(cited) == 0, "chosen no citations"),
                      (F.size(made_up) > 0, F.concat(F.lit("chosen fabricated cites: "), F.array_join(F.slice(made_up, 1, 2), ", "))), (~X.has_any(low, T.DPO_VERDICTS), "chosen no verdict keyword"))

    return X.once(_read(answer), of)


def rejected_reason(answer: Column, chosen: Column, dimension: Column) -> Column:
    has = lambda t, w: F.contains(t, F.lit(w))
    eligible = lambda t: has(t, "eligible") & ~has(t, "not eligible") & ~has(t, "ineligible")
    correct = lambda t: has(t, "is correct") | (has(t, "matches") & ~has(t, "does not match"))

    def of(a: Column) -> Column:
        same = (eligible(a["low"]) == eligible(a["other"])) & (correct(a["low"]) == correct(a["other"]))
        return _check((a["n"] < 40, "rejected too short"), (a["n"] > 600, "rejected too long"), (F.trim(answer) == F.trim(chosen), "rejected identical to chosen"), (F.size(a["cited"]) == 0, "rejected no citations"),
                      ((dimension == "verdict_correctness") & same, "rejected verdict matches chosen"))

    return X.once(_read(answer, other=F.lower(chosen)), of)


def pair_reason(first: Column, second: Column) -> Column:
    """The reason against the chosen answer, or else against the rejected one."""
    return X.once(first, lambda f: F.when(f != "ok", f).otherwise(second))


def flip_verdict(answer: Column, key: Column) -> Column:
    """The opposite verdict, and one threshold of the answer changed to a wrong one."""
    opposite = F.create_map(*[F.lit(x) for kv in T.OPPOSITES.items() for x in kv])
    flipped = lambda text, said: F.array_join(F.zip_with(text, said, lambda t, v: F.concat(t, F.coalesce(F.try_element_at(opposite, v), F.lit("")))), "")
    answer = flipped(F.split(answer, T.VERDICT), F.regexp_extract_all(answer, F.lit(T.VERDICT), F.lit(0)))

    def changed(t: Column, one: Column) -> Column:
        at = F.instr(t, one["old"])
        return F.when(one.isNull(), t).otherwise(F.concat(F.substr(t, F.lit(1), at - 1), one["new"], F.substr(t, at + F.length(one["old"]))))

    def threshold(t: Column) -> Column:
        there = F.filter(F.array(*[F.when(F.contains(t, F.lit(p)), F.struct(F.lit(p).alias("old"), choice(key, f"wrong{n}", ps).alias("new"))) for n, (p, ps) in enumerate(T.WRONG_THRESHOLDS)]), lambda x: x.isNotNull())
        return X.once(there, lambda found: X.once(F.get(found, draw(key, "threshold", F.greatest(F.size(found), F.lit(1)))), lambda one: changed(t, one)))

    return X.once(answer, threshold)


def permute_citations(answer: Column, allowed: Column, key: Column) -> Column:
    """Each citation becomes another of the allowed ones; null with fewer than two citations or ids, or if nothing changes."""
    usable = F.filter(allowed, lambda c: c != T.TOOL_DOC)
    usable = F.when(F.size(usable) < 2, allowed).otherwise(usable)

    def other(c: Column, i: Column, among: Column) -> Column:
        rest = F.filter(among, lambda u: u != c)
        n = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), i.cast("string"))), 1, 7), 16, 10).cast("long"), F.greatest(F.size(rest), F.lit(1)))
        return F.coalesce(F.get(rest, n.cast("int")), c)

    def of(x: Column) -> Column:
        ids = x["ids"]
        made = F.array_join(F.transform(F.split(answer, T.CITATION), lambda p, i: F.when(i < F.size(ids), F.concat(p, F.lit("["), other(F.get(ids, i), i, x["usable"]), F.lit("]"))).otherwise(p)), "")
        return F.when((F.size(ids) >= 2) & (F.size(allowed) >= 2), X.once(made, lambda m: F.when(m != answer, m)))

    return X.once(F.struct(F.regexp_extract_all(answer, F.lit(T.CITATION), F.lit(1)).alias("ids"), usable.alias("usable")), of)


def inject_rule(answer: Column, allowed: Column, key: Column) -> Column:
    """An invented rule, cited as one of the allowed documents, before the fourth line from the end (at the end of short answers)."""
    usable = F.filter(allowed, lambda c: c != T.TOOL_DOC)
    usable = F.when(F.size(usable) == 0, allowed).otherwise(usable)
    cite = F.get(usable, draw(key, "cite", F.greatest(F.size(usable), F.lit(1))))
    rule = F
    for n, (form, a, b) in enumerate(T.INVENTED_RULES):
        rule = rule.when(draw(key, "rule", len(T.INVENTED_RULES)) == n, F.replace(F.replace(F.lit(form), F.lit("{a}"), choice(key, f"a{n}", a)), F.lit("{b}"), choice(key, f"b{n}", b)))
    rule = F.replace(rule, F.lit("{cite}"), cite)

    def put(lines: Column) -> Column:
        at = F.greatest(F.lit(3), F.size(lines) - 4)
        long = F.concat(F.array_join(F.slice(lines, F.lit(1), at), "\n"), rule, F.lit("\n"), F.array_join(F.slice(lines, at + 1, F.size(lines)), "\n"))
        return F.when(F.size(lines) > 4, long).otherwise(F.concat(answer, rule))

    return F.when(F.size(allowed) > 0, X.once(F.split(answer, "\n"), put))


def split(rows: DataFrame, stratum: str, key: str, share: float, least_rows: int) -> DataFrame:
    """Adds split: of each stratum of least_rows rows and more a share, at least one, goes to `val`, in the order of a hash of key. Rows are numbered
    within slices of a stratum, so that a stratum may hold most of the rows: slices whose hashes come first fill up first."""
    order = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit("split")))
    rows = rows.withColumns({"_h": order, "_slice": F.substring(order, 1, 2)})
    sizes = rows.groupBy(stratum, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(stratum)
    n = F.sum("_n").over(w)
    quota = F.when(n >= least_rows, F.greatest(F.lit(1), F.floor(n * F.lit(share)))).otherwise(0)
    before = F.coalesce(F.sum("_n").over(w.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col(stratum).alias("_stratum"), F.col("_slice").alias("_s"), quota.alias("_quota"), before.alias("_before"))
    rank = F.row_number().over(Window.partitionBy(stratum, "_slice").orderBy("_h", key))
    placed = rows.withColumn("_rank", rank).join(sizes, F.col(stratum).eqNullSafe(F.col("_stratum")) & (F.col("_slice") == F.col("_s")))
    return placed.withColumn("split", F.when(F.col("_rank") + F.col("_before") <= F.col("_quota"), "val").otherwise("train")).drop("_h", "_slice", "_rank", "_stratum", "_s", "_quota", "_before")


def budget(docs: Column, cap: int = T.SUBDOMAIN_CAP, per_doc: int = T.SUBDOMAIN_PER_DOC) -> Column:
    return F.least(F.lit(cap), docs * per_doc)


SLICE = 4096


def breaker(attempts: DataFrame, group: str, order: str, most: float = T.MAX_REJECT_RATE, warmup: int = T.REJECT_WARMUP) -> DataFrame:
    """attempts (group, order: a whole number, rejected): (group, stopped_at, attempts): the first attempt at which a group's reject rate passes the
    limit, null if none does. Running sums are made within slices of the order and start from the sums of earlier slices."""
    rows = attempts.withColumn("_slice", F.floor(F.col(order) / SLICE))
    sums = rows.groupBy(group, "_slice").agg(F.count(F.lit(1)).alias("_sn"), F.sum(F.col("rejected").cast("int")).alias("_sr"))
    before = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(group).alias("_g"), F.col("_slice").alias("_s"), F.coalesce(F.sum("_sn").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_sr").over(before), F.lit(0)).alias("_r0"))
    w = Window.partitionBy(group, "_slice").orderBy(order)
    rated = rows.withColumn("_n", F.row_number().over(w)).withColumn("_r", F.sum(F.col("rejected").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rated = rated.join(sums, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_slice") == F.col("_s")))
    n, r = F.col("_n") + F.col("_n0"), F.col("_r") + F.col("_r0")
    return rated.groupBy(group).agg(F.min(F.when((n >= warmup) & (r / n > most), n)).alias("stopped_at"), F.count(F.lit(1)).alias("attempts"))


#: Answers by intent, in this engine's own words; {cite} is the first document, other names are columns.
ANSWERS = {
    "verify_epf": "**Result:** on a basic salary of ₹{basic_salary} the EPF share is 12% [{cite}], that is ₹{due_epf} a month. Your slip shows ₹{epf_deducted}, so the deduction {epf_says}.",
    "verify_esi": "**Result:** with ₹{gross_salary} gross, ESI is 0.75% [{cite}] up to a gross of ₹21,000. The amount due is ₹{due_esi}; your slip shows ₹{esi_deducted}, so the deduction {esi_says}.",
    "full_audit": "**Result:** EPF due ₹{due_epf} against ₹{epf_deducted} [{cite}], ESI due ₹{due_esi} against ₹{esi_deducted} [{cite}]. The EPF deduction {epf_says}.",
}
STEPS = (
    "\n\n**Why:** the amounts above follow from the rates and limits in the cited source, applied to the salary that you gave. Rounding is to the nearest rupee, and a difference of one rupee is within the rule."
    "\n\n**Next steps:**\n1. Keep the payslip and a statement of the account.\n2. Compare the monthly entry with the amount above [{cite}].\n3. If they differ, write to the payroll office and ask for a correction.\n4. If nothing happens within a month, file a grievance with the regional office."
)


def template_answers(rows: DataFrame) -> DataFrame:
    """rows (id, intent, payslip slots, allowed) with chosen: the template answer of the intent."""
    due, due_esi = F.bround(F.col("basic_salary") * F.lit(0.12)).cast("long"), F.when(F.col("gross_salary") <= 21000, F.bround(F.col("gross_salary") * F.lit(0.0075)).cast("long")).otherwise(F.lit(0))
    says = lambda actual, d: F.when(F.abs(actual - d) <= 1, "is correct and matches expected pay").when(actual < d, "is incorrect: under-deducted").otherwise("is incorrect: over-deducted")
    values = {"basic_salary": F.format_number("basic_salary", 0), "gross_salary": F.format_number("gross_salary", 0), "epf_deducted": F.format_number("epf_deducted", 0), "esi_deducted": F.format_number("esi_deducted", 0),
              "due_epf": F.format_number(due, 0), "due_esi": F.format_number(due_esi.cast("long"), 0), "epf_says": says(F.col("epf_deducted"), due), "esi_says": says(F.col("esi_deducted"), due_esi), "cite": F.get("allowed", 0)}
    text = F
    for intent, form in ANSWERS.items():
        text = text.when(F.col("intent") == intent, form + STEPS)
    return rows.withColumn("chosen", X.fill(text.otherwise(None), F.create_map(*[x for n, v in values.items() for x in (F.lit(n), v)])))


DIMENSIONS = ("verdict_correctness", "citation_faithfulness", "grounding")


def contrastive_pairs(rows: DataFrame, quota: int | None = None) -> DataFrame:
    """rows of template_answers() with dimension, rejected and reason; with a quota, at most so many accepted pairs of a dimension, by key order of hashes.
    Dimensions go round by the id; each has its own way to spoil an answer."""
    k = F.col("id")
    rows = rows.withColumn("dimension", F.get(F.array(*[F.lit(d) for d in DIMENSIONS]), F.pmod(k, F.lit(len(DIMENSIONS))).cast("int")))
    rejected = F.when(F.col("dimension") == DIMENSIONS[0], flip_verdict(F.col("chosen"), k)).when(F.col("dimension") == DIMENSIONS[1], permute_citations(F.col("chosen"), F.col("allowed"), k)).otherwise(inject_rule(F.col("chosen"), F.col("allowed"), k))
    rows = rows.withColumn("rejected", rejected)
    first, second = chosen_reason(F.col("chosen"), F.col("allowed"), F.col("dimension")), rejected_reason(F.col("rejected"), F.col("chosen"), F.col("dimension"))
    rows = rows.withColumn("reason", F.when(F.col("rejected").isNull(), "rejected not made").otherwise(pair_reason(first, second)))
    if quota is None:
        return rows
    best = Window.partitionBy("dimension").orderBy(F.md5(k.cast("string")), k)
    return rows.where("reason = 'ok'").withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= quota).drop("_n")


def records(rows: DataFrame, slots: dict[str, Column], **fields: Column) -> DataFrame:
    """(prompt, full_prompt, chosen, rejected, metadata) of rows with full_prompt, chosen and rejected. metadata is a VARIANT of the fields and of `slots`, each of its own type; what is null is left
    out, so that records of different intents have different members."""
    members = F.struct(*[c.alias(n) for n, c in fields.items()], F.struct(*[c.alias(n) for n, c in slots.items()]).alias("slots"))
    return rows.select(F.left("full_prompt", F.lit(1500)).alias("prompt"), "full_prompt", "chosen", "rejected", F.parse_json(F.to_json(members)).alias("metadata"))


def read_record(line: Column) -> Column:
    """A record's struct out of its line of JSON; members of metadata are read by path, with variant_get."""
    v = F.try_parse_json(line)
    get = lambda n: F.try_variant_get(v, f"$.{n}", "string").alias(n)
    return F.struct(get("prompt"), get("full_prompt"), get("chosen"), get("rejected"), F.try_variant_get(v, "$.metadata", "variant").alias("metadata"))


AMOUNTS = ("months_unemployed", "service_years", "pf_withdrawal_amount", "basic_salary", "epf_deducted", "gross_salary", "esi_deducted", "employment_years", "last_drawn_salary", "notice_period_days", "annual_income", "rent_paid", "section_80c_investments")
NAMES = ("kyc_status", "uan_status", "state", "termination_reason", "tax_regime", "city_type")


def intent_slots(rows: DataFrame, key: str) -> DataFrame:
    """rows with `intent`, drawn by the key's hash, and its slots, of their own types; those of other intents are null. Deductions are right for about 60 of 100 rows."""
    k = F.col(key)
    rows = rows.withColumn("intent", choice(k, "intent", tuple(A.RANGES)))
    intent = F.col("intent")
    for names, kind in ((AMOUNTS, "long"), (NAMES, "string")):
        for n in names:
            value = F
            for i, slots in A.RANGES.items():
                if n in slots:
                    value = value.when(intent == i, choice(k, n, slots[n]).cast(kind))
            rows = rows.withColumn(n, F.lit(None).cast(kind) if value is F else value)
    due, due_esi = F.bround(F.col("basic_salary") * F.lit(0.12)).cast("long"), F.bround(F.col("gross_salary") * F.lit(0.0075)).cast("long")
    right = draw(k, "right", 100) < 60
    epf = F.when(intent == "verify_epf", F.when(right, due).otherwise(due + choice(k, "off", (-450, -200, 350))))
    esi = F.when(intent == "verify_esi", F.when(F.col("gross_salary") > 21000, F.when(right, 0).otherwise(150)).when(right, due_esi).otherwise(due_esi + choice(k, "off", (-40, 25, 60))))
    return rows.withColumns({"epf_deducted": epf.cast("long"), "esi_deducted": esi.cast("long")})


def intent_answers(rows: DataFrame) -> DataFrame:
    """rows of intent_slots() with `allowed` (the ids to cite), and `verdict`, `amount`, `share` and `chosen`: the answer of intent and verdict."""
    c, i = F.col, F.col("intent")
    metro = c("city_type") == "metro"
    monthly = F.floor(c("annual_income") / 12).cast("long")
    amount = (
        F.when(i == "tds_query", R.tds_on_withdrawal(c("pf_withdrawal_amount"), c("service_years"))).when(i == "verify_epf", R.epf(c("basic_salary"))["expected"]).when(i == "verify_esi", R.esi(c("gross_salary"))["expected"])
        .when(i == "gratuity", R.gratuity(c("last_drawn_salary"), c("employment_years"))).when(i == "hra_exemption", R.hra_parts(monthly, c("rent_paid"), metro)["rent_less_tenth"]).when(i == "deductions_80c", R.section_80c(c("section_80c_investments"), c("tax_regime")))
    )
    rows = rows.withColumn("amount", amount).withColumn("share", F.when(i == "hra_exemption", R.hra_parts(monthly, c("rent_paid"), metro)["share_of_basic"]))
    near = lambda a: F.abs(a - c("amount")) <= 1
    verdict = (
        F.when(i == "full_withdrawal", F.when(c("months_unemployed") < 2, "early").when(c("service_years") >= 5, "untaxed").otherwise("taxed")).when(i == "tds_query", F.when(c("service_years") >= 5, "long").when(c("pf_withdrawal_amount") <= 50000, "small").otherwise("due"))
        .when(i == "transfer", F.when((c("uan_status") == "active") & (c("kyc_status") == "complete"), "ready").otherwise("blocked")).when(i == "verify_epf", F.when(near(c("epf_deducted")), "right").otherwise("wrong"))
        .when(i == "verify_esi", F.when(c("gross_salary") > 21000, F.when(c("esi_deducted") == 0, "exempt").otherwise("undue")).when(near(c("esi_deducted")), "right").otherwise("wrong")).when(i == "gratuity", F.when(c("employment_years") < 5, "short").otherwise("due"))
        .when(i == "deductions_80c", F.when(c("tax_regime") == "new_regime", "none").otherwise("claim")).otherwise("only")
    )
    rows, form = rows.withColumn("verdict", verdict), F
    for (intent, v), text in A.SAYS.items():
        form = form.when((i == intent) & (c("verdict") == v), text + A.THEN)
    values = {n: F.format_number(n, 0) for n in (*AMOUNTS, "amount", "share")} | {n: F.replace(n, F.lit("_"), F.lit(" ")) for n in NAMES} | {"cite": F.get("allowed", 0)}
    return rows.withColumn("chosen", X.fill(form.otherwise(None), F.create_map(*[x for n, v in values.items() for x in (F.lit(n), v)])))


def uncovered(domain: Column, cite: Column) -> Column:
    """(chosen, rejected) for a question that the sources don't cover: sent on to the domain's office, and answered without ground."""
    office = F
    for d, o in A.OFFICES.items():
        office = office.when(domain == d, o)
    put = lambda text: F.replace(F.replace(F.lit(text), F.lit("{office}"), office.otherwise(A.OFFICES["pf"])), F.lit("{cite}"), cite)
    return F.struct(put(A.UNCOVERED).alias("chosen"), put(A.MADE_UP).alias("rejected"))


REFUSALS_OF_TEN = 3


def refusal_pairs(rows: DataFrame) -> DataFrame:
    """rows (id, question, domain, allowed) as pairs of a refusal and an answer without ground: three of ten, by the id's hash, as out of scope, the others as not covered; with the
    validators' reason."""
    scope = draw(F.col("id"), "kind", 10) < REFUSALS_OF_TEN
    cite = F.get("allowed", 0)
    made = rows.withColumn("kind", F.when(scope, "out_of_scope").otherwise("not_covered")).withColumn("category", F.when(scope, refusal(F.col("question"))["category"]))
    made = made.withColumn("chosen", F.when(scope, refusal(F.col("question"))["answer"]).otherwise(uncovered(F.col("domain"), cite)["chosen"])).withColumn("rejected", uncovered(F.col("domain"), cite)["rejected"])
    dimension = F.lit("refusal_and_escalation")
    first, second = chosen_reason(F.col("chosen"), F.col("allowed"), dimension), rejected_reason(F.col("rejected"), F.col("chosen"), dimension)
    return made.withColumn("reason", pair_reason(first, second))


REDIRECTS = {
    "legal": "a lawyer or the legal services authority", "medical": "a doctor", "investment": "a registered adviser", "visa": "the embassy or an immigration office", "other": "the authority in charge",
}


def refusal(question: Column) -> Column:
    """(category, answer) for a question that is out of scope."""
    category = X.ladder(F.lower(question), T.OUT_OF_SCOPE, "other")
    to = F
    for c, where in REDIRECTS.items():
        to = to.when(category == c, where)
    text = F.concat(F.lit("**Result:** this question is outside the scope of provident fund, payslip, labour and tax help.\n\n**Where to go:** please consult "), to.otherwise(None),
                    F.lit(". They can look at your documents and your specific situation, which general sources can't cover. Bring earlier letters, account numbers and a short list of what happened and when, so that nothing has to be asked twice."))
    return F.struct(category.alias("category"), text.alias("answer"))


def least_filled(items: DataFrame, order: str, fills: DataFrame) -> DataFrame:
    """items with `dimension`: in the order of a column of distinct whole numbers, each goes to the least filled dimension that isn't full, of equal ones the first by
    place; null once all are full. fills (dimension, place, n, target).

    No item waits for the one before: the level of dimension d's next free place being L, as many places come before it as all dimensions have below L, and those of earlier
    dimensions at L. Places are joined to items by that number.
    """
    f = fills.select("dimension", "place", F.col("n").cast("long").alias("n"), F.col("target").cast("long").alias("target"))
    every = F.broadcast(f.agg(F.collect_list(F.struct("place", "n", "target")).alias("_all")))  # a row a dimension, fixed by the caller
    level, place = F.col("_level"), F.col("place")
    below = lambda a, x: a + F.greatest(F.lit(0), F.least(level, x["target"]) - x["n"])
    at = lambda x: F.when((x["place"] < place) & (x["n"] <= level) & (level < x["target"]), 1).otherwise(0)
    number = F.aggregate("_all", F.lit(0).cast("long"), lambda a, x: below(a, x) + at(x))
    free = f.where("n < target").select("*", F.explode(F.sequence("n", F.col("target") - 1)).alias("_level")).crossJoin(every).select("dimension", number.alias("_number"))
    from tessella.operators.generation import numbered

    rows = numbered(items.withColumn("_one", F.lit(1)), ["_one"], F.floor(F.col(order) / SLICE), [order], "_number").drop("_one")
    return rows.join(free, "_number", "left").drop("_number")
