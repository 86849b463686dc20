"""Operators 2, 3, 6, 7, 8 and 9: brute force, round trips, held-out accuracy."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import chat_format, decontaminate, html_extract, language_id, packing, queries, warc

SF = "/root/testdata/sf0.001"


# --- 2: HTML -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def extractor():
    return html_extract.train()


def test_extractor_on_held_out_pages(extractor):
    pages = html_extract.labelled_pages(120, seed=99)
    got = extractor([p for p, _ in pages])
    hit = missed = extra = 0
    for g, (_, want) in zip(got, pages, strict=True):
        a, b = Counter(g.split("\n")), Counter(want.split("\n"))
        hit, missed, extra = hit + (a & b).total(), missed + (b - a).total(), extra + (a - b).total()
    assert hit / (hit + missed) > 0.95 and hit / (hit + extra) > 0.95


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_extract_table(spark, sf):
    """The article's blocks of every page of the table, by a plain rule that knows its layout."""
    import html

    pages = spark.read.parquet(f"/root/testdata/sf{sf}/pages.parquet")
    got = {r["page_id"]: r for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert got[r["page_id"]]["text"] == "\n".join(b for b in blocks if b), r["page_id"]
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"]) and got[r["page_id"]]["url"] == r["url"]


def test_very_long_pages(extractor):
    """Deep, wide and unfinished pages take time in proportion to their length: sixteen times as long, not 256 times as much."""
    import time

    for page in (lambda n: "<x>" * n + "x", lambda n: "<p " * n * 20, lambda n: "<ul>" + "<li>x" * n, lambda n: "<div></x>" * n + "x", lambda n: "<a href='" * n * 20, lambda n: "<!--" * n * 20, lambda n: "<title " * n * 20):
        took = []
        for n in (5_000, 80_000):
            began = time.perf_counter()
            extractor([page(n)])
            took.append(time.perf_counter() - began)
        assert took[1] < 64 * max(took[0], 0.05), took


def test_extract_edges(spark, extractor):
    article = "<p>" + "A long enough sentence, of ordinary words, that says something. " * 8 + "</p>"
    rows = [(1, None), (2, ""), (3, "no tags &amp; text"), (4, "<script>var x = 1"), (5, f"<article>{article}<div"), (6, "<!-- open"), (7, "<p " * 2000), (8, "<div>" * 3000 + "x"), (9, f"<article>{article * 300}</article>"), (None, f"<article>{article}</article>")]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame([(i, "u", h, 1) for i, h in rows], "page_id long, url string, html string, text int")).collect()}
    assert got[1] == got[2] == got[4] == got[6] == "" and len(got[9].split("\n")) == 300 and got[None].startswith("A long enough")
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_math_svg_and_object_are_read(extractor):
    runs = lambda page: [t for t in html_extract.Tree(page).text if t]
    assert runs("<p>Let <math><mi>x</mi><mo>+</mo><mn>1</mn></math> be</p><p>so</p>") == ["Let x+1 be", "so"]
    assert runs('<p>See <svg><title>no</title><path d="M0"/><text>one</text><text>two</text></svg></p>') == ["See one two"]
    assert runs("<object data=x><p>fallback</p></object><svg><g><p>rest</p><div>more</div>") == ["fallback", "rest", "more"]
    say = "A long enough sentence, of ordinary words, that says something. " * 4
    got = extractor([f"<article><p>{say}<math><mi>E</mi><mo>=</mo><mi>mc</mi></math> holds.</p><p>{say}<svg>open</p><p>{say}last</p></article>"])[0]
    assert "E=mc holds." in got and got.endswith("last")


def test_references_of_any_length(extractor):
    """A page with references of several MB is read, and says what a short one would."""
    word = "word " * 80
    page = lambda ref: f"<html><body><article><h1>T</h1><p>{word}{ref} end</p></article></body></html>"
    for ref, want in (("&#" + "7" * 5_000_000 + ";", "\ufffd"), ("&#" + "0" * 5_000_000 + "65;", "A"), ("&#x" + "0" * 5000 + "41;", "A"), ("&#99999999;", "\ufffd"), ("&#1114112;", "\ufffd")):
        assert extractor([page(ref)]) == extractor([page(want)]) and want in extractor([page(ref)])[0], ref[:30]


def test_decoding_never_contradicts_and_is_best():
    import itertools

    import numpy as np

    r = random.Random(1)
    for _ in range(60):
        t = html_extract.Tree("<div><p>a</p><section><p>b</p>c</section></div><p>d</p>" if r.random() < 0.5 else "<div>a<div>b</div></div><ul><li>c<li>d</ul>").pruned()
        odds = np.array([r.uniform(-3, 3) for _ in t.tag])
        kids = defaultdict(list)
        for k, p in enumerate(t.parent):
            kids[p].append(k)
        ok = lambda y: all((not y[k] or p < 0 or y[p]) for k, p in enumerate(t.parent)) and all(not y[k] or t.text[k] is not None or any(y[c] for c in kids[k]) for k in range(len(y)))
        score = lambda y: sum(-np.logaddexp(0, -o) if k else -np.logaddexp(0, o) for k, o in zip(y, odds, strict=True))
        best = max((y for y in itertools.product((False, True), repeat=len(t.tag)) if ok(y)), key=score)
        got = html_extract.decode(t, odds)
        assert ok(got) and score(got) == pytest.approx(score(best))


# --- 3: WARC -------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    table = spark.read.parquet(f"{SF}/pages.parquet")
    nested = warc.record(7, "u", b"inner" * 50, None, warc.base32_sha1(b"inner" * 50)).decode("latin-1")
    extra = spark.createDataFrame([(100_000, "u", None), (100_001, None, ""), (100_002, "u\r\nX: y%0D", "same"), (100_003, "u", "same"), (99_999, "u", "same"), (100_004, "u", nested), (100_005, "u", "é" * 300_000), (100_006, "u", "w" * 3_000_000), (100_007, "http://x/a%0Db", "p"), (100_008, " \thttp://x/a b%20;% ", "q"), (100_009, "%A;\u2003", "r"), (100_010, "", "s")], "page_id long, url string, html string")
    pages = table.select("page_id", "url", "html").unionByName(extra).repartition(3)
    rows = pages.collect()
    first = {}
    for r in rows:
        p = (r["html"] or "").encode()
        first[p] = min(first.get(p, r["page_id"]), r["page_id"])
    for size in (1000, 1 << 16, 1 << 30):
        files = warc.write(warc.mark_revisits(pages), warc.new_dir(spark, "test"))
        got = {r["page_id"]: r for r in warc.read(spark, files, size, payloads=True).collect()}
        assert len(got) == len(rows) == sum(f[2] for f in files)
        for r in rows:
            p, g = (r["html"] or "").encode(), got[r["page_id"]]
            digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
            kind = "response" if first[p] == r["page_id"] else "revisit"
            assert (g["payload_bytes"], g["payload_digest"], g["record_type"], g["refers_to"], g["url"]) == (len(p), digest, kind, None if kind == "response" else first[p], r["url"])
            assert kind == "revisit" or bytes(g["payload"]) == p


def test_warc_min_bytes_and_empty(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef"), (4, "u", "abcdef"), (3, "u", "abcdef")], "page_id long, url string, html string")
    got = sorted((r["page_id"], r["record_type"]) for r in warc.round_trip(pages, min_bytes=5).collect())
    assert got == [(1, "response"), (2, "response"), (3, "response"), (3, "response"), (4, "revisit"), (4, "revisit")]
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_reader_survives_damage(spark, tmp_path):
    """A damaged member is skipped; the records after it are still found, whatever the split."""
    import pyarrow as pa

    members = [warc.record(i, "u", f"payload {i} ".encode() * 30, None, warc.base32_sha1(f"payload {i} ".encode() * 30)) for i in range(20)]
    broken = bytearray(members[5])
    broken[30:40] = b"\x1f\x8b\x08" + b"\0" * 7
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"".join(members[:5]) + bytes(broken) + b"".join(members[6:]))
    size = path.stat().st_size
    for step in (37, 500, size):
        found = [warc.parse(r)["page_id"] for a in range(0, size, step) for r in warc.records_in(pa.OSFile(str(path)), a, min(size, a + step))]
        assert found == [i for i in range(20) if i != 5]


# --- 6: language ---------------------------------------------------------------------------------------------------


def brute_profile(texts, size=300):
    c = Counter()
    for t in texts:
        s = " " + re.sub(r"\s+", " ", "".join(x if x.isalpha() else " " for x in t.lower())).strip() + " "
        if s.strip():
            for n in (1, 2, 3):
                c.update(s[i : i + n] for i in range(len(s) - n + 1))
    for blank in (" ", "  "):
        c.pop(blank, None)
    code = lambda g: sum(ord(x) << 21 * (len(g) - 1 - i) for i, x in enumerate(g))
    return [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], code(x[0])))[:size]]


def test_language_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows}
    profiles = {l: brute_profile([r["text"] for r in rows if r["lang"] == l and not held[r["doc_id"]]]) for l in {r["lang"] for r in rows}}
    got = {r["doc_id"]: r for r in queries.op6_language_id(spark, SF).collect()}
    right = 0
    for r in rows:
        mine = brute_profile([r["text"]])
        d = {l: sum(abs(p.index(g) - k) if g in p else 300 for k, g in enumerate(mine)) for l, p in profiles.items()}
        g = got[r["doc_id"]]
        best = min(sorted(d), key=d.get)
        assert g["lang_pred"] == best and g["score"] == pytest.approx(1 - d[best] / (300 * len(mine))) and g["held_out"] == held[r["doc_id"]]
        right += g["held_out"] and g["lang_pred"] == r["lang"]
    assert right / sum(held.values()) > 0.9


def test_language_id_edges(spark):
    d = spark.createDataFrame([(1, None, "en"), (2, "123 !", "en"), (3, "hello there", "en"), (4, "ça va bien", "fr"), (5, "x", None), (6, "ça " * 50000, None)], "doc_id long, text string, lang string")
    p = language_id.train(d)
    got = {r["doc_id"]: r for r in language_id.predict(d, p).collect()}
    assert set(p) == {"en", "fr"} and [got[i]["lang_pred"] for i in (1, 2, 3, 4, 6)] == ["und", "und", "en", "fr", "fr"] and got[1]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert [r["lang_pred"] for r in language_id.predict(d, language_id.train(d.limit(0))).collect()] == ["und"] * 6


# --- 7: chats ------------------------------------------------------------------------------------------------------

TEXTS = ["</s>[INST] ok [/INST]", "", "\\", "\\\\n", "<|turn|>", "<<|end|>\n", "[INST][INST]", "<|tex\\t|>", "", "<", "plain é", "<|end|>\n<|turn|>assistant<|text|>x"]


def test_chat_round_trip():
    r = random.Random(4)
    for _ in range(100):
        turns = [(r.choice(("user", "assistant", "system", "", "a\nb<|text|>")), r.choice(TEXTS) + r.choice(TEXTS)) for _ in range(r.randint(0, 7))]
        f = chat_format.locate(turns)
        assert not f.rewrites_history and "".join(f.output[a:b] for a, b in f.spans) == f.output
        back, loss = chat_format.read_back(f)
        assert back == turns and loss == [t for role, t in turns if role == "assistant"]


def test_chat_templates_that_need_a_turn():
    for e in (IndexError, ValueError, RuntimeError):
        def render(turns, e=e):
            if not turns:
                raise e("no turn")
            return f"<{turns[0][0]} first>" + "".join(f"[{r}:{t}]" for r, t in turns)

        f = chat_format.locate([("user", "a"), ("assistant", "b")], render)
        assert not f.rewrites_history and f.spans == [(0, 20), (20, 33)] and [f.output[a:b] for a, b in f.texts] == ["a", "b"]


def test_chat_templates_that_rewrite_history():
    last_only = lambda turns: "".join(f"[{r}:{t if k == len(turns) - 1 or r == 'user' else '...'}]" for k, (r, t) in enumerate(turns))
    turns = [("user", "a"), ("assistant", "b"), ("user", "c")]
    assert chat_format.locate(turns, last_only).rewrites_history
    plain = lambda turns: "<s>" + "".join(f"[{r}] {t.strip()} ;" for r, t in turns)
    f = chat_format.locate(turns, plain)
    assert not f.rewrites_history and [f.output[a:b] for a, b in f.texts] == ["a", "b", "c"] and f.spans[0] == (3, 13)


def test_chat_query(spark):
    rows = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        rows[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    rows[-1] = [(0, "user", TEXTS[0]), (1, "assistant", TEXTS[0])]
    got = queries.op7_chat_format(spark, SF).collect()
    assert len(got) == len(rows)
    for g in got:
        turns = sorted(rows[g["conv_id"]])
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert g["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in turns).encode()).hexdigest()
        assert (g["n_turns"], g["loss_chars"], g["loss_sha256"]) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_edges(spark):
    d = spark.createDataFrame([(1, None, None, None), (1, 1, "assistant", None), (None, 0, "user", "x"), (2, 0, "user", "y" * 100_000), (2, 0, "user", "y" * 100_000)], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat_format.digest(chat_format.format_chats(d)).collect()}
    assert got == {1: (2, 0), None: (1, 0), 2: (2, 0)}
    assert chat_format.digest(chat_format.format_chats(d.limit(0))).count() == 0


# --- 8: packing ----------------------------------------------------------------------------------------------------


def check_packed(got, tokens, seq_len):
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, ids in tokens.items():
        at = 0
        for k, r in enumerate(sorted(pieces[i], key=lambda r: r["piece"])):
            part = ids[at : at + r["length"]]
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)))
            assert k == 0 or r["length"] == seq_len
            at += r["length"]
        assert at == len(ids)
    for v in seqs.values():
        at = 0
        for off, n in sorted(v):
            assert off == at
            at += n
        assert at <= seq_len
    return len(seqs)


def test_packing_query(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    tokens = {r["doc_id"]: t.encode(r["text"] or "", add_special_tokens=False).ids + [2] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    n = check_packed(queries.op8_packing(spark, SF).collect(), tokens, 1024)
    assert n <= -(-sum(map(len, tokens.values())) // 1024) * 1.02 + 1


def test_packing_edges(spark):
    from tokenizers import Tokenizer

    texts = {1: None, 2: "", 3: "<|endoftext|> x <|endoftext|>", 4: "word " * 5000, 5: "é \n\n  x", 6: "a" * 3000, 7: "'Tis isn't '’"}
    t = Tokenizer.from_file(queries.tokenizer_path())
    tokens = {i: t.encode(s or "", add_special_tokens=False).ids + [2] for i, s in texts.items()}
    d = spark.createDataFrame([(i, s, 5) for i, s in texts.items()], "doc_id long, text string, length int")
    packed = packing.pack(packing.pieces(d, queries.tokenizer_path(), 2, seq_len=64, keep_ids=True), 64)
    check_packed(packed.collect(), tokens, 64)
    assert sum(len(r["ids"]) for r in packing.sequences(packed).collect()) == sum(map(len, tokens.values()))
    assert packing.pack(packing.pieces(d.limit(0), queries.tokenizer_path())).count() == 0


def test_plans():
    r = random.Random(2)
    for seq_len in (1, 2, 16, 100, 257):
        for _ in range(5):
            h = Counter(r.randint(1, seq_len) for _ in range(r.choice((1, 10, 3000))))
            p = packing.plan(dict(h), seq_len)
            used = Counter()
            for n, contents in p:
                assert n > 0 and sum(length * k for length, k in contents) <= seq_len
                for length, k in contents:
                    used[length] += n * k
            assert used == h
            assert sum(n for n, _ in p) <= sum(n for n, _ in packing.best_fit(dict(h), seq_len))


# --- 9: decontamination ---------------------------------------------------------------------------------------------


def brute_tokens(text):
    out, after_number = [], False
    for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[!-/:-@\[-`{-~]", "", text or "")):
        low = "".join(c.lower() if c.isascii() else c for c in w)
        if any(c in "0123456789" for c in w):
            out.append(("#", w))
        elif after_number and low in decontaminate.UNITS:
            out.append(("%", w))
        elif "A" <= w[0] <= "Z" or "À" <= w[0] <= "Þ":
            out.append(("@", w))
        else:
            out.append((low, None))
        after_number = out[-1][0] == "#"
    return out


def brute_leaks(docs, items, window=8, cover=0.2):
    out = {}
    for i, text in items:
        ti = brute_tokens(text)
        size = min(window, len(ti))
        win = {a: tuple(t for t, _ in ti[a : a + size]) for a in range(len(ti) - size + 1) if size}
        win = {a: w for a, w in win.items() if sum(ti[a + k][1] is None for k in range(size)) >= min(4, size)}
        for d, doc in docs:
            td = brute_tokens(doc)
            lines = defaultdict(list)
            at = defaultdict(list)
            for b in range(len(td) - size + 1):
                at[tuple(t for t, _ in td[b : b + size])].append(b)
            for a, w in win.items():
                for b in at.get(w, ()):
                    lines[b - a].append(a)
            for shift, hits in lines.items():
                pairs = {(ti[a + k][1], td[a + k + shift][1]) for a in hits for k in range(size) if ti[a + k][1]}
                if len({x for x, _ in pairs}) == len(pairs) and len(hits) / len(win) >= cover:
                    v = (len(hits), "verbatim" if all(x == y for x, y in pairs) else "reparameterised")
                    out[d, i] = max(out.get((d, i), v), v)
    return out


QUESTION = "Alice Smith bought 12 km of rope for 30 dollars and then sold half of it to Bob for a quarter of the price, how much did Alice Smith lose on the 12 km of rope"


def leak_rows(df):
    return {(r["doc_id"], r["item_id"]): (r["n_windows"], r["verdict"]) for r in df.collect()}


@pytest.mark.parametrize("limit", [decontaminate.FILTER_WINDOWS, 0])
def test_decontaminate(spark, limit):
    consistent = QUESTION.replace("Alice Smith", "Carla Jones").replace("12 km", "7 miles").replace("30", "45").replace("Bob", "Dan")
    broken = consistent.replace("Carla Jones lose", "Erik Brown lose").replace("the 7 miles", "the 9 miles")
    docs = [(1, "Some words before. " + QUESTION + " and after"), (2, "x y z " + consistent), (3, broken), (4, None), (5, "nothing of the kind " * 300), (6, QUESTION.upper().lower()), (7, "tiny test"), (8, "a tiny test item"), (9, "W 1 " * 5000), (1, "again")]
    items = [(10, QUESTION), (11, QUESTION), (12, "tiny test"), (13, None), (14, "A 1 B 2 C 3 D 4 E 5")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, doc_id int")
    got = leak_rows(decontaminate.leaks(d, i, filter_windows=limit))
    assert got == brute_leaks(docs, [x for x in items if x[0] != 11])
    assert got[1, 10][1] == "verbatim" and got[2, 10][1] == "reparameterised" and (7, 12) in got and (8, 12) in got and (5, 10) not in got
    assert decontaminate.leaks(d.limit(0), i).count() == 0 and decontaminate.leaks(d, i.limit(0)).count() == 0


def test_decontaminate_table(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = leak_rows(decontaminate.leaks(docs, items))
    want = brute_leaks([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert got == want and got


@pytest.mark.parametrize("limit", [decontaminate.FILTER_WINDOWS, 0])
def test_decontaminate_in_another_case(spark, limit):
    german = "Der Bäcker Müller verkauft täglich über 40 große Brötchen, und Frau Öztürk kauft davon jeden Morgen genau ein Viertel für ihre Gäste"
    items = [(1, QUESTION), (2, german), (3, "WHICH OF THESE RIVERS FLOWS THROUGH MORE THAN FOUR COUNTRIES ON ITS WAY TO THE SEA"), (4, "Anna 12 Bob 13 Carl 14 Dora 15 Emil 16 Fritz 17 Gerda 18")]
    cases = [str, str.upper, str.lower, str.title]
    docs = [(10 * i + k, f"some words before. {f(t)} and after") for i, t in items for k, f in enumerate(cases)]
    docs += [(100, "Anna 12 Bob 13 Carl 99 Dora 15 Emil 16 Fritz 17 Hans 18"), (101, "UNRELATED WORDS " * 40)]
    twice = QUESTION.replace("Alice Smith", "Carla Jones").replace("12 km", "7 miles")
    docs += [(102, twice), (103, twice + " " + QUESTION.upper())]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = leak_rows(decontaminate.leaks(d, i, filter_windows=limit))
    assert set(got) == {(10 * i + k, i) for i, _ in items for k in range(4)} | {(102, 1), (103, 1)}
    assert {v for k, (_, v) in got.items() if k[0] != 102} == {"verbatim"} and got[102, 1][1] == "reparameterised"


def test_token_ids_are_those_of_the_library():
    """Random Unicode, every added token by itself and inside words, and long runs of one character or pattern."""
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t, r = Tokenizer.from_file(path), random.Random(12)
    ranges = ((0x20, 0x7E), (0x09, 0x0D), (0xA0, 0x17F), (0x300, 0x36F), (0x370, 0x5FF), (0x900, 0x97F), (0x2000, 0x206F), (0x3040, 0x30FF), (0x4E00, 0x4FFF), (0xAC00, 0xACFF), (0x1F300, 0x1F64F), (0xE000, 0xE0FF), (0xFFF0, 0xFFFD), (0x10FF00, 0x10FFFF))
    texts = ["".join(chr(r.randint(*r.choice(ranges))) for _ in range(r.randint(1, 120))) for _ in range(1500)]
    texts += ["".join(r.choice((" ", "  ", "\n", "\r\n", "'s", "'LL", "12", "³", "½", "é", "é", "ǅ", "ab", "_", "…", " ", " ", "\t")) for _ in range(r.randint(1, 60))) for _ in range(1500)]
    added = [a.content for a in t.get_added_tokens_decoder().values()]
    texts += [x for a in added for x in (a, f"x{a}y", f" {a} ", f"{a}{a}", a[:-1], a.upper())]
    texts += [c * n for c in ("a", " ", "\n", "ab", "=", "é", "😀", "0", "\t ", "a ") for n in (31, 1000, 5000)]
    for s in texts:
        assert packing.token_ids(s, path, 2).tolist() == [*t.encode(s, add_special_tokens=False).ids, 2], repr(s[:80])


@pytest.mark.parametrize("unit", [" ", "\n", "\t \xa0", "ab", "7", "=", "é", " a"])
def test_token_ids_of_runs_of_five_megabytes(unit):
    """Runs of each class of the pattern, by themselves, before a word and before an added token."""
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t = Tokenizer.from_file(path)
    added = next(iter(t.get_added_tokens_decoder().values())).content
    for size, ends in ((5_000_000, ("x",)), (120_000, ("", "word", " word", "\nx", added, f" {added} "))):
        for end in ends:
            s = "y" + unit * (size // len(unit)) + end
            assert np.array_equal(packing.token_ids(s, path, 2), np.array([*t.encode(s, add_special_tokens=False).ids, 2]))


def test_decontamination_takes_bounded_memory_a_batch():
    """A batch of many texts is cut into tokens a bounded number of bytes at a time."""
    import tracemalloc

    import pyarrow as pa

    texts = pa.array(["Wörter and 12 Names of Places in texts " * 50] * 4000)
    tracemalloc.start()
    for _, some in decontaminate._chunks(list(range(len(texts))), texts):
        decontaminate.folded(some, decontaminate.Tokens(some)).windows(decontaminate.WINDOW, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
