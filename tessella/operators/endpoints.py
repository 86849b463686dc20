"""Model calls as vectorised endpoints, each with a deterministic default that needs no model.

An endpoint is a function from a list of prompts to a list of answers; `column` runs it over Arrow batches. A call that fails is
tried again with a growing pause, and gives a marker instead of an answer when tries run out.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Endpoint = Callable[[list[str]], list[str | None]]
FAILED = "[error: no answer]"


def column(endpoint: Endpoint, prompt: Column, batch: int = 64, tries: int = 3, pause: float = 5.0) -> Column:
    """The endpoint's answers as a column; null prompts aren't sent."""

    @F.pandas_udf("string")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out: list[str | None] = [None] * len(s)
            ask = [k for k, p in enumerate(s) if p is not None]
            for at in range(0, len(ask), batch):
                part = ask[at : at + batch]
                for n in range(tries):
                    try:
                        answers = endpoint([s.iloc[k] for k in part])
                        break
                    except Exception:
                        if n + 1 < tries:
                            time.sleep(pause * (n + 1))
                else:
                    answers = [FAILED] * len(part)
                for k, a in zip(part, answers, strict=True):
                    out[k] = a
            yield pd.Series(out, dtype=object)

    return call(prompt)


Encoder = Callable[[list[str]], list[list[float]]]


def vectors(encoder: Encoder, text: Column, batch: int = 64) -> Column:
    """An encoder's vectors as a column; null texts aren't sent."""

    @F.pandas_udf("array<double>")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out: list[list[float] | None] = [None] * len(s)
            ask = [k for k, t in enumerate(s) if t is not None]
            for at in range(0, len(ask), batch):
                part = ask[at : at + batch]
                for k, v in zip(part, encoder([s.iloc[k] for k in part]), strict=True):
                    out[k] = [float(x) for x in v]
            yield pd.Series(out, dtype=object)

    return call(text)


def echo_generator(prompts: list[str]) -> list[str]:
    """Answers that cite the prompt's sources, so that what follows can be run without a model."""
    out = []
    for p in prompts:
        ids = [line.split("doc_id=")[1].split(" |")[0] for line in p.splitlines() if "doc_id=" in line]
        out.append(f"**Result:** according to the sources {' '.join(f'[{i}]' for i in ids)}." if ids else "**Result:** no source covers this; please escalate.")
    return out


def hashed_encoder(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """Signed feature hashing of words, L2-normalised: a stand-in for a sentence encoder."""

    def encode(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dim
            for w in t.lower().split():
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big")
                v[h % dim] += 1.0 if h >> 63 else -1.0
            n = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / n for x in v])
        return out

    return encode


def overlap_judge(answer: Column, sources: Column) -> Column:
    """A score of 1 to 5 by the share of an answer's words that its sources have: a stand-in for a judging model."""
    from tessella.functions.text import search_tokens

    a, s = F.array_distinct(search_tokens(answer)), search_tokens(sources)
    share = F.size(F.array_intersect(a, s)) / F.greatest(F.size(a), F.lit(1))
    return (F.floor(share * 4) + 1).cast("int")
