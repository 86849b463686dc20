"""Chat formatting by incremental rendering of a black-box template.

The template is only a function from a list of turns to a string. Successive prefixes of a conversation are rendered;
where each output starts with the one before, what it adds is the new turn's span, and the text's place in the span is
found by rendering the same prefix with two probes in its place and comparing the outputs. A template whose output for a longer
prefix changes what it wrote before rewrites history: such conversations are reported (`rewrites_history`), with no spans
and an empty loss mask, since no training mask by turns would be true of them.

The own template marks turns by control strings; inside roles and texts a backslash after the first character breaks each
control string, and backslashes are doubled, so that the original comes back exactly.

A conversation is one record and is held as a whole, as is its output; other state is bounded by a batch.

Defined results: a null text or role is empty; turns are ordered by turn, then role, then text, null turns first, and
repeated rows stay. Conversations of a null id are one. An empty table gives an empty result. A template that raises without turns writes nothing there, so what it writes ahead of the
first turn is part of that turn's span. Renderings are quadratic in a conversation's turns. Columns other than the four named aren't read and may have any name.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]  # role, text
START, HEAD, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: Strings that no text or role may hold in the output: the own marks and those of common templates.
CONTROLS = (START, HEAD, "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_BREAK = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in sorted(CONTROLS)))


def escape(s: str) -> str:
    return _BREAK.sub(lambda m: m[0] + "\\", s.replace("\\", "\\\\"))


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.DOTALL)


@functools.lru_cache(4096)
def _turn(role: str, text: str) -> str:
    return f"{START}{escape(role)}{HEAD}{escape(text)}{END}"


def template(turns: list[Turn]) -> str:
    return "".join(_turn(role, text) for role, text in turns)


def parse(span: str) -> Turn:
    """The turn that the own template wrote as this span."""
    if not (span.startswith(START) and span.endswith(END)):
        raise ValueError("not a turn")
    role, mark, text = span[len(START) : -len(END)].partition(HEAD)
    if not mark:
        raise ValueError("not a turn")
    return unescape(role), unescape(text)


@dataclass
class Formatted:
    output: str
    spans: list[tuple[int, int]] = field(default_factory=list)  # of each turn
    texts: list[tuple[int, int]] = field(default_factory=list)  # of each turn's text, in the output
    rewrites_history: bool = False


#: Two texts that no control string holds; outputs with one and the other differ where a text starts.
PROBES = ("\ue000", "\ue001")


def _rendered_empty(render: Callable[[list[Turn]], str]) -> str:
    """What a template writes before any turn; nothing for one that needs a turn, whatever it raises without."""
    try:
        return render([])
    except Exception:
        return ""


def locate(turns: list[Turn], render: Callable[[list[Turn]], str] = template) -> Formatted:
    """Renders the prefixes of a conversation and takes every turn's span from two outputs in a row."""
    before, spans, texts = _rendered_empty(render) if turns else "", [], []
    for k, (role, _) in enumerate(turns):
        out = render(turns[: k + 1])
        one, two = (render([*turns[:k], (role, p)]) for p in PROBES)
        head = len(os.path.commonprefix([one[len(before) :], two[len(before) :]])) + len(before)
        tail = one[head + 1 :]
        if not (out.startswith(before) and one.startswith(before) and out.startswith(one[len(before) : head], len(before)) and out.endswith(tail) and len(out) >= head + len(tail)):
            return Formatted(render(turns), rewrites_history=True)
        spans.append((len(before), len(out)))
        texts.append((head, len(out) - len(tail)))
        before = out
    return Formatted(before, spans, texts)


def read_back(f: Formatted) -> tuple[list[Turn], list[str]]:
    """The turns and, from the loss mask, the assistant texts, both out of the output."""
    turns = [parse(f.output[a:b]) for a, b in f.spans]
    return turns, [unescape(f.output[a:b]) for (a, b), (role, _) in zip(f.texts, turns, strict=True) if role == "assistant"]


FIELDS = "conv_id long, n_turns long, formatted string, spans array<array<long>>, loss_spans array<array<long>>, rewrites_history boolean"


def conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order."""
    turns = F.struct(rows[turn].alias("turn"), F.coalesce(rows[role], F.lit("")).alias("role"), F.coalesce(rows[text], F.lit("")).alias("text"))
    return rows.select(rows[conv_id].cast("long").alias("conv_id"), turns.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def format_chats(rows: DataFrame, render: Callable[[list[Turn]], str] = template, **columns: str) -> DataFrame:
    """FIELDS of each conversation; loss_spans are the places of the assistant texts."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ll = pa.list_(pa.list_(pa.int64()))
        for b in batches:
            for conv, turns in zip(b.column("conv_id"), b.column("turns"), strict=True):
                turns = [(t["role"], t["text"]) for t in turns.as_py()]
                f = locate(turns, render)
                loss = [] if f.rewrites_history else [list(s) for s, (role, _) in zip(f.texts, turns, strict=True) if role == "assistant"]
                cols = ([conv.as_py()], pa.int64()), ([len(turns)], pa.int64()), ([f.output], pa.string()), ([[list(s) for s in f.spans]], ll), ([loss], ll), ([f.rewrites_history], pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in cols], names=["conv_id", "n_turns", "formatted", "spans", "loss_spans", "rewrites_history"])

    return conversations(rows, **columns).mapInArrow(of, FIELDS)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest(formatted: DataFrame) -> DataFrame:
    """The digest columns, read back from format_chats()'s outputs, spans and loss mask."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for b in batches:
            out = []
            for r in b.to_pylist():
                s = r["formatted"]
                turns = [parse(s[a:e]) for a, e in r["spans"]]
                loss = "".join(unescape(s[a:e]) for a, e in r["loss_spans"])
                out.append((r["conv_id"], len(turns), sha("".join(f"{role}\n{text}\n" for role, text in turns)), len(loss), sha(loss), len(s)))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[c.split()[0] for c in DIGEST.split(", ")])

    return formatted.mapInArrow(of, DIGEST)
