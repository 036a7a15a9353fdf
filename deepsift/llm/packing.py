"""Documents packed into fixed-length sequences by cutting-stock column generation.

One pass over the texts gives token ids; a document longer than a sequence is cut into full sequences and a
rest. The rests' lengths form a histogram of at most a few hundred width classes, whatever the input. The
driver solves the linear program over patterns of classes (revised simplex; new patterns priced by a knapsack
dynamic program), rounds it down, and packs what rounding leaves by best fit. Rests are ranked within their
class by distributed numbering; a table of a few thousand rows maps class and rank to sequence and place.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import INT, LONG, Scratch, fields, number_rows, slices, tidy

LENGTH = 4096
#: Class widths: multiples of UNIT tokens, above FINE tokens growing by 1/FINE_STEPS each.
UNIT, FINE, FINE_STEPS = 8, 256, 64
END_ID = 2
#: A word's ids are kept, within a task, while it is among the last so many to twice as many different words of a Python worker.
CACHE_WORDS = 250_000
#: Texts of so many bytes in all are split into words at once.
TOGETHER_BYTES = 1 << 20
#: New words are encoded in texts of so many words.
JOINED = 256
_CACHES: dict[str, "_Words"] = {}
#: A lower-cased word that no step before the merges changes or splits but between letters and marks.
_PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: So many runs of marks are kept.
CACHE_MARKS = 50_000


def _lean(path: str, tokenizer):
    """A tokenizer with the same merges for words of letters alone, and which ids end a word; None where the file's steps are others."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    told = json.loads(tokenizer.to_str())
    steps = lambda x: [y["type"] for y in (x or {}).get("normalizers") or (x or {}).get("pretokenizers") or [x] if y]
    suffix = told["model"].get("end_of_word_suffix")
    if steps(told["normalizer"]) != ["NFC", "Replace", "Lowercase"] or steps(told["pre_tokenizer"]) != ["Split", "ByteLevel"] or not suffix:
        return None
    out = Tokenizer.from_file(path)
    out.normalizer = normalizers.Sequence([])
    out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    vocabulary = tokenizer.get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
    return out, ends


class _Words:
    """From a white-space-free piece of text, lower-cased A-Z, to its ids as little-endian 32-bit numbers.

    Exact for tokenizers that split at white space, fold case and merge within what is left (word_bpe_49k).
    Words of Latin letters and marks behind them are merged without the steps that cannot change them, letters and
    marks apart, as the tokenizer parts them; any other word is encoded as it stands. Words live in two generations:
    when the young one is full it becomes the old one, and words met again move over, so frequent words are never
    forgotten and memory is bounded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads would only hold memory
        self.tokenizer = Tokenizer.from_file(path)
        self.lean = _lean(path, self.tokenizer)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}

    def learn(self, words: set[bytes]) -> None:
        """Make all of ``words`` young, encoding what neither generation knows."""
        if len(self.young) >= CACHE_WORDS:
            self.old, self.young = self.young, {}
        if len(self.marks) >= CACHE_MARKS:
            self.marks = {"": b""}
        new, letters, tails = [], [], []
        for w in words.difference(self.young):
            if (ids := self.old.get(w)) is not None:
                self.young[w] = ids
            elif self.lean and (parts := _PLAIN.fullmatch(w.decode().lower())):
                behind = parts[2]
                if behind not in self.marks:
                    self.marks[behind] = self.encode(behind.encode())
                new.append(w)
                letters.append(parts[1])
                tails.append(self.marks[behind])
            else:
                self.young[w] = self.encode(w)
        for lo in range(0, len(new), JOINED):
            part = slice(lo, lo + JOINED)
            lean, ends = self.lean
            ids = np.array(lean.encode_batch_fast([" ".join(letters[part])], add_special_tokens=False)[0].ids, "<u4")
            cuts = (4 * (np.flatnonzero(ends[ids]) + 1)).tolist()
            if len(cuts) != len(new[part]):
                raise RuntimeError("the tokenizer doesn't keep words apart")
            raw = ids.tobytes()
            for w, tail, start, end in zip(new[part], tails[part], [0, *cuts], cuts, strict=False):
                self.young[w] = raw[start:end] + tail

    def forget(self) -> None:
        self.young, self.old, self.marks = {}, {}, {"": b""}

    def encode(self, text: bytes) -> bytes:
        return pack_ids(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids)

    def ids(self, words: list[bytes]) -> bytes:
        """The ids of words that were learnt just now."""
        return b"".join(map(self.young.__getitem__, words))


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def words_of(path: str) -> _Words:
    if path not in _CACHES:
        _CACHES[path] = _Words(path)
    return _CACHES[path]


def token_bytes(texts: list[bytes | None], words: _Words) -> list[bytes]:
    """Each document's ids and the end id, 4 bytes each. Texts with a special token's string are not folded by word."""
    split = [None if t and b"<|" in t else (t or b"").lower().split() for t in texts]
    words.learn(set().union(*(x for x in split if x)))
    end = END_ID.to_bytes(4, "little")
    return [(words.encode(t) if x is None else words.ids(x)) + end for t, x in zip(texts, split, strict=True)]


PIECES = fields(doc_id=LONG, start=LONG, length=LONG, ids_crc32=LONG, doc_tokens=LONG)


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """A row per piece of documents(doc_id, text): full sequences and a rest."""

    def run(batches):
        words = words_of(tokenizer)
        for b in slices(batches, by_bytes=TOGETHER_BYTES):
            rows = []
            for i, ids in zip(b.column(0).to_pylist(), token_bytes(b.column(1).to_pylist(), words), strict=True):
                n = len(ids) // 4
                for s in range(0, n, length):
                    part = ids[4 * s : 4 * (s + length)]
                    rows.append((i, s, len(part) // 4, zlib.crc32(part), n))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], PIECES.names)
        words.forget()
        tidy()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, PIECES)


def class_bounds(length: int = LENGTH) -> np.ndarray:
    """The largest length of each class, ascending, multiples of UNIT."""
    out, x = [], 0
    while x < length:
        x = min(length, x + max(UNIT, 0 if x < FINE else x // FINE_STEPS // UNIT * UNIT))
        out.append(x)
    return np.array(out)


def knapsack(width: np.ndarray, value: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable counts of items whose widths fit into ``room``; an item may be taken again and again."""
    best, choice = np.zeros(room + 1), np.full(room + 1, -1)
    order = np.argsort(width, kind="stable")
    w, v = width[order], value[order]
    fit = np.searchsorted(w, np.arange(room + 1), side="right")
    for c in range(1, room + 1):
        best[c], choice[c] = best[c - 1], -1
        if k := fit[c]:
            worth = best[c - w[:k]] + v[:k]
            i = int(worth.argmax())
            if worth[i] > best[c]:
                best[c], choice[c] = worth[i], i
    counts, c = np.zeros(len(width), np.int64), room
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            counts[order[choice[c]]] += 1
            c -= w[choice[c]]
    return float(best[room]), counts


def generate_columns(width: np.ndarray, demand: np.ndarray, room: int, gap: float = 1e-3, most: int = 3000) -> tuple[np.ndarray, np.ndarray, float]:
    """Patterns (rows), how often each is used, and a lower bound of the linear program's optimum.

    Starts from patterns of one class and adds the pattern with the best reduced cost until Farley's bound is
    within ``gap``, or ``most`` steps are done; the result is a feasible basis at any time.
    """
    m = len(width)
    basis = np.diag(room // width).astype(np.float64)
    inverse = np.diag(1 / basis.diagonal())
    x = inverse @ demand
    bound = 0.0
    for _ in range(most):
        dual = inverse.sum(axis=0)
        value, pattern = knapsack(width, dual, room)
        bound = max(bound, float(x.sum()) / max(value, 1.0))
        if value <= 1 + 1e-7 or x.sum() - bound <= max(0.5, gap * bound):
            break
        move = inverse @ pattern
        ratio = np.where(move > 1e-9, x / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratio.argmin())
        x -= ratio[out] * move
        x[out] = ratio[out]
        np.maximum(x, 0, out=x)
        row = inverse[out] / move[out]
        inverse -= np.outer(move, row)
        inverse[out] = row
        basis[:, out] = pattern
    return np.rint(basis.T).astype(np.int64), x, bound


@dataclass
class Layout:
    """Runs of ranks: ranks first.. of a class stand ``each`` to a sequence from ``sequence`` on."""

    runs: list[tuple[int, int, int, int]]
    sequences: int
    bound: float


def layout(histogram: np.ndarray, bounds: np.ndarray, length: int = LENGTH) -> Layout:
    """histogram: rests by class."""
    used = np.nonzero(histogram)[0]
    if not len(used):
        return Layout([], 0, 0.0)
    width, demand, room = bounds[used] // UNIT, histogram[used].astype(np.int64), length // UNIT
    patterns, x, bound = generate_columns(width, demand.astype(np.float64), room)
    left, rank, runs, sequence = demand.copy(), np.zeros(len(used), np.int64), [], 0

    def place(counts: np.ndarray, times: int) -> None:
        nonlocal sequence
        for k in np.nonzero(counts)[0]:
            runs.append((int(used[k]), int(rank[k]), int(counts[k]), sequence))
            rank[k] += counts[k] * times
            left[k] -= counts[k] * times
        sequence += times

    for counts, times in zip(patterns, np.floor(x + 1e-6).astype(np.int64), strict=True):
        if counts.any():
            times = min(int(times), int((left[counts > 0] // counts[counts > 0]).min()))
            if times > 0:
                place(counts, times)
    # What rounding leaves: each sequence takes the widest that still fits. Its size depends on the classes alone.
    while left.any():
        counts, space = np.zeros(len(used), np.int64), room
        for k in range(len(used) - 1, -1, -1):
            counts[k] = min(left[k], space // width[k])
            space -= counts[k] * width[k]
        times = max(1, int((left[counts > 0] // counts[counts > 0]).min()))
        place(counts, times)
    return Layout(runs, sequence, bound)


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row per piece of documents(doc_id, text).

    A null or empty text is the end id alone. Repeated rows are packed as often as they occur. Sequences are
    numbered from 0; pieces stand in them without gaps from offset 0. Other columns are ignored. An empty
    table returns no rows.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "pack")
    bounds = class_bounds(length)
    cut = scratch.save(pieces(docs, tokenizer, length))
    rest = F.col("length") < length
    step = F.array(*[F.lit(int(b)) for b in bounds])
    kind = F.when(rest, F.size(F.filter(step, lambda b: b < F.col("length")))).otherwise(len(bounds))
    ranked = scratch.save(number_rows(cut.withColumn("kind", kind.cast("int")), ["kind", "doc_id", "start", "length", "ids_crc32"], scratch, "row"))
    starts = ranked.groupBy("kind").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    held = {r.kind: (r.first, r.n) for r in starts.select("kind", F.col("first"), "n").collect()}  # a row per class
    scratch.only(ranked)
    histogram = np.array([held.get(k, (0, 0))[1] for k in range(len(bounds))], np.int64)
    plan = layout(histogram, bounds, length)
    by_kind: dict[int, list] = {}
    for run in plan.runs:
        by_kind.setdefault(run[0], []).append(run[1:])
    tables = {k: tuple(np.array(c, np.int64) for c in zip(*sorted(v), strict=True)) for k, v in by_kind.items()}
    firsts = {k: v[0] for k, v in held.items()}
    full, whole = len(bounds), plan.sequences

    def assign(batches):
        for b in batches:
            kinds, rows = b.column("kind").to_numpy(), b.column("row").to_numpy()
            out = np.empty(len(kinds), np.int64)
            for k in np.unique(kinds):
                at = kinds == k
                rank = rows[at] - firsts[k]
                if k == full:
                    out[at] = whole + rank
                else:
                    first, each, sequence = tables[k]
                    i = np.searchsorted(first, rank, side="right") - 1
                    out[at] = sequence[i] + (rank - first[i]) // each[i]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*b.schema.names, "sequence_id"])

    placed = ranked.select(*PIECES.names, "kind", "row").mapInArrow(assign, T.StructType([*PIECES.fields, T.StructField("kind", INT), T.StructField("row", LONG), T.StructField("sequence_id", LONG)]))
    # Lengths before it in its sequence; a sequence has at most ``length`` pieces.
    before = Window.partitionBy("sequence_id").orderBy(F.desc("kind"), "row").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0))
    return placed.select(*PIECES.names, "sequence_id", offset.alias("offset"))
