"""Secret scans in DataFrame functions only: fixed patterns, and a pair of character Markov models.

Two first-order Markov models over characters, one of random strings and one of ordinary identifiers, are counted
from labelled samples. Long tokens of a text are scored by the mean log-likelihood ratio of their transitions;
tokens above a limit that don't overlap a pattern's match are added as spans of kind `random`.

Defined results: a null text is an empty text (no spans). Matches of one kind never overlap; matches of different
kinds may, and all stay. Equal rows are rows of their own. An empty table gives an empty result. Texts of any length are read whole, in time
linear in their length but for sorting: places are prefix sums made in blocks, overlaps are found by bisection, and
tokens are read character by character. A column `found` of the caller's is replaced by the result; others are carried.

What the models can't tell apart: encoded images and other compressed data look like keys and are reported. Keys in lower-case
hexadecimal below 32 characters look like parts of UUIDs and aren't.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import let


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


KEYS = "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|" + _either_case("api") + "_?" + _either_case("key")
ASSIGN = rf"""({KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
#: Kinds in the order in which spans of equal start are listed.
KINDS = ("assign", "access", "hex", "random")
#: Tokens that the models score: long runs of characters that keys are written in.
TOKEN = "[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
MIN_LLR = 0.7  # mean nats a transition
SAMPLES = 4000  # labelled strings of either class
MILLI = 1000

#: Parts of ordinary identifiers, for the labelled samples.
PARTS = (
    "get set add remove user name list item index value count total size file path read write open close buffer stream request response "
    "handler manager service client server config option default error message table column query result page node parent child event "
    "listener update delete create load save data model view controller test unit batch worker thread task queue timeout retry cache "
    "session account number address street order customer product price currency language country region version release build module "
    "package import export format parse string integer double boolean array object function method class interface abstract static "
    "public private protected internal external override version information international communication development organisation"
).split()


def labelled_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """(text, is_random): n random strings in hex, base-64, upper-case and mixed alphabets, and n strings that aren't keys: identifiers and words in the
    usual writing styles, and UUIDs, runs of digits, dates, and sequences of a few letters, which look random but are common in texts. All are
    functions of the row's number, so that every run learns the same model."""
    i = spark.range(0, n, 1, 4)
    digest = lambda s: F.sha2(F.concat(F.lit(s), F.col("id").cast("string")), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(digest("b"))), "[^A-Za-z0-9+/=]", "")
    style = F.pmod(F.col("id"), F.lit(4))
    rand = F.when(style == 0, F.substring(digest("h"), 1, 40)).when(style == 1, b64).when(style == 2, F.upper(F.regexp_replace(b64, "[+/=]", ""))).otherwise(F.regexp_replace(b64, "[+/=]", ""))
    parts = F.array(*[F.lit(p) for p in PARTS])
    part = lambda s: F.element_at(parts, (F.pmod(F.xxhash64(F.col("id"), F.lit(s)), F.lit(len(PARTS))) + 1).cast("int"))
    four = [part(f"p{k}") for k in range(4)]
    style = F.pmod(F.col("id"), F.lit(10))
    uuid = F.regexp_replace(F.substring(digest("u"), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    digits = F.translate(F.substring(digest("d"), 1, 32), "abcdef", "012345")
    date = F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2), F.substring(digits, 9, 6), part("q"))
    letters = F.translate(F.substring(digest("l"), 1, 60), "0123456789abcdef", "ACGTACGTACGTACGT")
    names = (F.when(style == 0, F.concat_ws("_", *four)).when(style == 1, F.concat(four[0], *map(F.initcap, four[1:]))).when(style == 2, F.concat_ws("-", *four))
             .when(style == 3, F.upper(F.concat_ws("_", *four[:3]))).when(style == 4, F.concat_ws("/", *four)).when(style == 5, F.concat(*four)).when(style == 6, F.when(F.col("id") % 20 < 10, uuid).otherwise(F.upper(uuid)))
             .when(style == 7, digits).when(style == 8, date).otherwise(F.when(F.col("id") % 20 < 10, letters).otherwise(F.lower(letters))))
    return i.select(rand.alias("text"), F.lit(True).alias("is_random")).unionByName(i.select(names.alias("text"), F.lit(False).alias("is_random")))


def train(samples: DataFrame, smoothing: float = 0.5) -> list[int]:
    """Log-likelihood ratios in thousandths, of ALPHABET's character pairs row by row. Gathers at most 2 * 67 * 67 counts.
    A pair with a character outside the alphabet isn't counted; null texts have no pairs."""
    places = F.sequence(F.lit(1), F.length("text") - 1)
    pairs = samples.where(F.length("text") > 1).select("is_random", F.explode(F.transform(places, lambda p: F.col("text").substr(p, F.lit(2)))).alias("pair"))
    counts: dict[bool, dict[str, int]] = {True: {}, False: {}}
    for r in pairs.where(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$")).groupBy("is_random", "pair").count().collect():
        counts[r["is_random"]][r["pair"]] = r["count"]
    out = []
    for a in ALPHABET:
        rows = [[counts[c].get(a + b, 0) + smoothing for b in ALPHABET] for c in (True, False)]
        sums = [sum(r) for r in rows]
        out += [round(MILLI * (math.log(x / sums[0]) - math.log(y / sums[1]))) for x, y in zip(*rows, strict=True)]
    return out


def mean_llr(token: Column, model: list[int]) -> Column:
    """The mean log-likelihood ratio of a token's transitions, in nats; null for a token of one character."""
    ratios = F.split(F.lit(",".join(map(str, model))), ",").cast("array<int>")  # one literal, folded once
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    n = F.length(token) - 1
    total = lambda cs: F.aggregate(F.sequence(F.lit(1), n), F.lit(0).cast("long"), lambda acc, p: acc + F.get(ratios, F.get(cs, p - 1) * len(ALPHABET) + F.get(cs, p)))
    return F.when(n > 0, let(codes, total) / (n * MILLI))


#: Prefix values are made in blocks of so many: arrays that grow step by step are copied at each step, so none grows longer.
BLOCK = 128
SPANS = "array<struct<start:int,kind:int,stop:int,value:string>>"


def with_prefix(df: DataFrame, name: str, join: Callable[[Column, Column], Column]) -> DataFrame:
    """df with the array of longs `name` replaced by its running join (a sum, or a maximum): at each place over all up to it. Blocks are run through on
    their own, then joined with the run over the blocks' last values; each step is a column, and what a lambda reads is bound by let(), so that nothing is worked out twice."""

    def run(xs: Column) -> Column:
        return F.aggregate(xs, F.array().cast("array<bigint>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(join(F.try_element_at(acc, F.lit(-1)), x), x))))

    c, blocks, ends = F.col(name), F.col("_blocks"), F.col("_ends")
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda k: run(F.slice(v, k * BLOCK + 1, BLOCK)))
    df = df.withColumn("_blocks", let(c, lambda v: F.when(F.size(v) > 0, cut(v)).otherwise(F.array().cast("array<array<bigint>>"))))
    df = df.withColumn("_ends", run(F.transform(blocks, lambda b: F.element_at(b, -1))))
    joined = let(ends, lambda e: F.flatten(F.transform(blocks, lambda b, k: F.when(k == 0, b).otherwise(F.transform(b, lambda x: join(F.get(e, k - 1), x))))))
    return df.withColumn(name, joined).drop("_blocks", "_ends")


def with_matches(df: DataFrame, text: str, pattern: str, kind: int, name: str) -> DataFrame:
    """df with the spans (start, kind, stop, value) of all leftmost matches that don't overlap, in code points.

    The text's pieces between matches and the matches alternate, so their lengths add up to every match's place."""
    hits, parts = F.col("_hits"), F.col("_parts")
    df = df.withColumn("_hits", F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
    df = df.withColumn("_parts", F.when(F.size(hits) > 0, F.split(F.col(text), pattern, -1)).otherwise(F.array().cast("array<string>")))
    lengths = let(parts, lambda p: F.transform(hits, lambda h, i: (F.length(F.get(p, i)) + F.length(h)).cast("long")))
    df = with_prefix(df.withColumn("_stops", lengths), "_stops", lambda a, b: a + b)
    span = lambda e: lambda h, i: F.struct((F.get(e, i) - F.length(h)).cast("int").alias("start"), F.lit(kind).alias("kind"), F.get(e, i).cast("int").alias("stop"), h.alias("value"))
    return df.withColumn(name, let(F.col("_stops"), lambda e: F.transform(hits, span(e)))).drop("_hits", "_parts", "_stops")


def before(starts: Column, place: Column) -> Column:
    """How many of the sorted starts are below a place, by bisection."""
    zero = F.struct(F.lit(0).alias("lo"), F.size(starts).alias("hi"))

    def step(acc: Column, _: Column) -> Column:
        mid = F.shiftright(acc["lo"] + acc["hi"], 1)
        below = (acc["lo"] < acc["hi"]) & (F.get(starts, mid) < place)
        return F.struct(F.when(below, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(below | (acc["lo"] >= acc["hi"]), acc["hi"]).otherwise(mid).alias("hi"))

    steps = F.ceil(F.log2(F.size(starts) + F.lit(1.0))).cast("int")
    return F.aggregate(F.sequence(F.lit(0), steps), zero, step, lambda acc: acc["lo"])


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None, model: list[int] | None = None, min_llr: float = MIN_LLR) -> DataFrame:
    """docs (the columns in keep, all by default) with `found`: an array of (start, kind, stop, value), sorted; kind is a place in KINDS."""
    model = model or train(labelled_samples(docs.sparkSession))
    carried = [F.col(c).alias(f"_c{n}") for n, c in enumerate(docs.columns if keep is None else keep) if c != "found"]
    names = [c for c in (docs.columns if keep is None else keep) if c != "found"]
    df = docs.select(*carried, F.coalesce(docs[text], F.lit("")).alias("_t"))
    held = df.columns[:-1]
    for kind, pattern in enumerate((ASSIGN, ACCESS, "[0-9a-f]{32,}", TOKEN)):  # runs of 32 and more: what [0-9a-f]+ leaves
        df = with_matches(df, "_t", pattern, kind, f"_kind{kind}")
    long_assign = rf"^[A-Za-z_]+[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{{8,}}$"
    assign, access = F.filter("_kind0", lambda s: s["value"].rlike(long_assign)), F.filter("_kind1", lambda s: s["stop"] - s["start"] >= 16)
    df = df.withColumn("_base", F.sort_array(F.concat(assign, access, "_kind2")))
    # Tokens that no base span overlaps: the largest stop of those that start before a token's end isn't behind its start.
    df = df.withColumns({"_starts": F.transform("_base", lambda b: b["start"].cast("long")), "_reach": F.transform("_base", lambda b: b["stop"].cast("long"))})
    df = with_prefix(df, "_reach", F.greatest)
    clear = lambda s, r: F.filter("_kind3", lambda k: F.coalesce(F.get(r, before(s, k["stop"].cast("long")) - 1), F.lit(0)) <= k["start"])
    df = df.withColumn("_clear", F.when(F.size("_base") == 0, F.col("_kind3")).otherwise(let(F.col("_starts"), lambda s: let(F.col("_reach"), lambda r: clear(s, r)))))
    found = F.sort_array(F.concat("_base", F.filter("_clear", lambda s: mean_llr(s["value"], model) > min_llr)))
    return df.select(*[F.col(h).alias(n) for h, n in zip(held, names, strict=True)], found.alias("found"))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The digest columns of scan()'s spans."""
    base = F.filter("found", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return found.select(key, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs with every span of the text replaced by <kind>; of spans that overlap, their union is replaced, named by the first.
    A text without spans, null included, stays as it is."""
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    found = scan(docs.withColumn("_text", docs[text]), text, **options)
    # Four bytes a character, so that any stretch is cut out without reading what is before it.
    found = found.withColumns({"_chars": F.when(F.size("found") > 0, F.encode("_text", "UTF-32")), "_reach": F.transform("found", lambda s: s["stop"].cast("long"))})
    found = with_prefix(found, "_reach", F.greatest)
    cut = lambda c, a, b: F.decode(F.substring(c, a * 4 + 1, (b - a) * 4), "UTF-32")
    behind = lambda r, i: F.coalesce(F.get(r, i - 1), F.lit(0)).cast("int")
    kept = lambda c, r: F.transform("found", lambda s, i: F.when(s["start"] < behind(r, i), "").otherwise(F.concat(cut(c, behind(r, i), s["start"]), F.get(names, s["kind"]))))
    whole = let(F.col("_chars"), lambda c: let(F.col("_reach"), lambda r: F.concat(F.array_join(kept(c, r), ""), cut(c, F.element_at(r, -1).cast("int"), F.length("_text")))))
    return found.withColumn(text, F.when(F.size("found") == 0, F.col("_text")).otherwise(whole)).drop("found", "_text", "_chars", "_reach")
