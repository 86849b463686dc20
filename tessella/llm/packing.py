"""Best-fit packing of token sequences by patterns fitted with non-negative least squares.

Documents become token ids plus an end id; those longer than a sequence are cut into pieces of its length, the first
piece taking what is left over. The histogram of piece lengths (at most seq_len numbers) is all that the driver sees.
Patterns are pairs and triples of lengths that fill a sequence exactly; non-negative least squares fits how often each
repeats, counts are rounded down so that no length is used more than it is there, and the residual histogram is packed by
best fit, longest first, on counts: bins with equal contents are one entry. The plan's size depends on seq_len alone.
Pieces are numbered within their length and take their places by a search in the plan.

Defined results: a null or empty text is the end id alone. Equal rows are packed as rows of their own. A null id is kept.
An empty table gives an empty result. Other columns of the input aren't carried.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import gapless, materialise

SEQ_LEN = 1024
#: The byte-level pre-tokeniser's pattern.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(2)
def encoder(path: str):
    """An encoder with the ids of the byte-level BPE in a tokenizers file. The file's vocabulary and merges are run by
    tiktoken, which gives the same ids at several times the speed; that needs ids in the order of the merges, which is
    checked here. Added tokens in a text are their ids, as with the file's own library."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"]
    if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
        raise ValueError("not a plain byte-level tokenizer")
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(rest)}
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    ids = [spec["model"]["vocab"]["".join(m)] for m in pairs]
    if ids != sorted(ids):
        raise ValueError("ids aren't in the order of merges")
    return tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added), set(added)


#: Runs of white space that are too long for the pattern, whose look-ahead steps back through them.
LONG_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{50000,}")


def token_ids(text: str | None, path: str, end_id: int) -> np.ndarray:
    """The ids of a text. A long run of white space is a piece of its own as far as the pattern takes it: up to its last character, which belongs to what follows, or whole
    where nothing or an added token follows."""
    enc, special = encoder(path)
    text, at, parts = text or "", 0, []
    for run in LONG_SPACE.finditer(text):
        whole = run.end() == len(text) or text.startswith(tuple(special), run.end())
        stop = run.end() if whole else run.end() - 1
        parts += [enc.encode_to_numpy(text[at : run.start()], allowed_special=special, disallowed_special=()), np.array(enc._encode_single_piece(text[run.start() : stop]), np.uint32)]
        at = stop
    ids = np.concatenate([*parts, enc.encode_to_numpy(text[at:], allowed_special=special, disallowed_special=())])
    return np.append(ids, np.array([end_id], ids.dtype)).astype("<u4")


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, end_id: int = 2, seq_len: int = SEQ_LEN, text: str = "text", doc_id: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """PIECE of every piece of every document, with keep_ids also its token ids."""
    names = PIECE + ", ids array<int>" * keep_ids

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * keep_ids
        heads = [x.split()[0] for x in names.split(", ")]
        for b in batches:
            out: list[tuple] = []
            held = 0
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = token_ids(t.as_py(), path, end_id)
                first = (len(ids) - 1) % seq_len + 1
                for k, stop in enumerate(range(first, len(ids) + 1, seq_len)):
                    start = max(0, stop - seq_len)
                    part = ids[start:stop]
                    out.append((i, k, start, stop - start, zlib.crc32(part.tobytes())) + ((part.astype(np.int32),) if keep_ids else ()))
                    held += len(part) * keep_ids + 8
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=heads)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=heads)

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(of, names)


def patterns(seq_len: int) -> np.ndarray:
    """Rows (a, b, c) of lengths with sum seq_len, rising; pairs have a = 0."""
    a = np.arange(0, seq_len // 3 + 1)
    rows = [np.stack([np.full(len(b), x), b, seq_len - x - b], axis=1) for x in a for b in [np.arange(max(x, 1), (seq_len - x) // 2 + 1)]]
    return np.concatenate(rows) if rows else np.empty((0, 3), np.int64)


def fit(histogram: np.ndarray, pats: np.ndarray, weight: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative repeat counts x of the patterns, minimising |W (A x - histogram)|^2 (A has a pattern's lengths as a column, W weighs
    lengths), by projected gradient steps with momentum; histogram[0] and pads of length 0 don't count."""
    if not len(pats) or not histogram.any():
        return np.zeros(len(pats))
    size = len(histogram)

    def apply(x: np.ndarray) -> np.ndarray:
        y = sum(np.bincount(pats[:, k], weights=x, minlength=size) for k in range(3))
        y[0] = 0
        return y

    v = np.ones(len(pats))
    for _ in range(20):  # largest eigenvalue of A^T A
        v = (weight * apply(v))[pats].sum(axis=1)
        v /= np.linalg.norm(v)
    step = 1 / ((weight * apply(v))[pats].sum(axis=1) @ v * 1.05)
    x, z, t = np.zeros(len(pats)), np.zeros(len(pats)), 1.0
    for _ in range(rounds):
        r = weight * (apply(z) - histogram)
        new = np.maximum(0, z - step * r[pats].sum(axis=1))
        u = (1 + (1 + 4 * t * t) ** 0.5) / 2
        x, z, t = new, new + (t - 1) / u * (new - x), u
    return x


Plan = list[tuple[int, list[tuple[int, int]]]]  # (sequences, [(length, pieces of it in each)])


#: Powers of the length by which a length's misfit is weighed, and shares of the fitted counts that are used. Short pieces
#: that the patterns leave over still fill gaps, long ones don't; how much that matters depends on the histogram.
WEIGHTS, SHARES = (0, 2, 4), (1.0, 0.9, 0.5)


def plan(histogram: dict[int, int], seq_len: int = SEQ_LEN) -> Plan:
    """How to pack so many pieces of each length: of the plans by WEIGHTS and SHARES, the one with the fewest sequences."""
    h = np.zeros(seq_len + 1, np.int64)
    for length, n in histogram.items():
        h[length] = n
    whole: Plan = [(int(h[seq_len]), [(seq_len, 1)])] if h[seq_len] else []
    h[seq_len] = 0
    pats = patterns(seq_len)
    pats = pats[((h[pats] > 0) | (pats == 0)).all(axis=1)]
    tried = []
    for power in WEIGHTS:
        x = fit(h.astype(float), pats, (np.arange(seq_len + 1) / seq_len) ** power)
        tried += [_rounded(h.copy(), pats, x * share, seq_len) for share in SHARES]
    return whole + min(tried, key=lambda p: sum(n for n, _ in p))


def _rounded(h: np.ndarray, pats: np.ndarray, fitted: np.ndarray, seq_len: int) -> Plan:
    """The patterns' counts rounded down, as far as pieces are there, and best fit of what is left."""
    out: Plan = []
    x = np.floor(fitted + 1e-9).astype(np.int64)
    for k in np.argsort(-x, kind="stable"):
        if x[k] <= 0:
            break
        need: dict[int, int] = defaultdict(int)
        for length in pats[k]:
            if length:
                need[int(length)] += 1
        n = min([int(x[k])] + [int(h[length]) // m for length, m in need.items()])
        if n > 0:
            out.append((n, sorted(need.items(), reverse=True)))
            for length, m in need.items():
                h[length] -= n * m
    return out + best_fit({int(length): int(h[length]) for length in np.flatnonzero(h)}, seq_len)


def best_fit(histogram: dict[int, int], seq_len: int) -> Plan:
    """Best fit, longest first, on counts: each piece goes to the fullest sequence that still takes it."""
    bins: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = defaultdict(list)  # by room left: (sequences, contents)
    for length in sorted(histogram, reverse=True):
        left, room = histogram[length], length
        rooms = iter(sorted(r for r in bins if r >= length and bins[r]))
        while left:
            room = next(rooms, None)
            entries = bins.pop(room) if room is not None else [(left, ())]
            base = room if room is not None else seq_len
            most = base // length
            for n, contents in entries:
                full = min(n, left // most)
                rest = left - full * most if full < n else 0
                part = min(rest, most - 1) if full < n else 0
                if full:
                    bins[base - most * length].append((full, (*contents, (length, most))))
                if part:
                    bins[base - part * length].append((1, (*contents, (length, part))))
                left -= full * most + part
                idle = n - full - bool(part)
                if idle and room is not None:
                    bins[room].append((idle, contents))
    return [(n, list(contents)) for room in sorted(bins) for n, contents in bins[room]]


class Places:
    """Where the r-th piece of a length goes: tables for a search, made from a plan."""

    def __init__(self, p: Plan):
        rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        used: dict[int, int] = defaultdict(int)
        sequence = 0
        for n, contents in p:
            at = 0
            for length, k in contents:
                rows[length].append((used[length], sequence, k, at))
                used[length] += n * k
                at += length * k
            sequence += n
        self.tables = {length: np.array(v, np.int64).T for length, v in rows.items()}
        self.sequences = sequence

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        edges = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            at = order[a:b]
            first, sequence, k, start = self.tables[int(length[at[0]])]
            g = np.searchsorted(first, rank[at], side="right") - 1
            j = rank[at] - first[g]
            seq[at], off[at] = sequence[g] + j // k[g], start[g] + j % k[g] * length[at]
        return seq, off


def pack(cut: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """pieces() with sequence_id and offset."""
    columns = cut.columns
    cut = materialise(cut, "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = Places(plan(histogram, seq_len))
    ranked = gapless(cut, ["length"], ["doc_id", "piece", "ids_crc32"], "_rank")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                seq, off = places(b.column("length").to_numpy(), b.column("_rank").to_numpy())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(seq), pa.array(off)], names=[*columns, "sequence_id", "offset"])

    return ranked.select(*columns, "_rank").mapInArrow(of, cut.schema.add("sequence_id", "long").add("offset", "long"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of packed pieces with ids; a sequence has at most seq_len tokens."""
    held = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return held.select("sequence_id", F.flatten("p.ids").alias("ids"))
