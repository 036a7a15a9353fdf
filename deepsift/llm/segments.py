"""Toxic passages as maximum-scoring segments of token log-odds.

Token scores are log-odds with an informative Dirichlet prior between labelled toxic and other documents (Monroe,
Colaresi and Quinn, "Fightin' Words"), for and against, each as far as its z-score carries it; a token that tells
nothing costs the drift. A scan in linear time (Ruzzo and Tompa) finds all maximal-scoring segments of a document. Their scores follow an
extreme-value law (Karlin and Altschul): a document of n tokens has a segment of score S or more by chance with
probability 1 - exp(-K n exp(-lambda S)). Lambda solves the law's equation for the token scores of other documents,
K is the likeliest for those documents' best segments; neither sees the documents that the scores were learnt from.
Segments with a chance under LEVEL are passages. A document's evidence is summed over its segments and turned into
a probability by a logistic fit.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import DBL, INT, LONG, fields, slices

#: The model is fitted on so many labelled documents at most, by a hash of doc_id.
FIT_DOCS = 10_000
#: Tokens that the model may hold; the rest have the background's weight.
VOCABULARY = 50_000
CACHE_WORDS = 500_000
#: Mass of the Dirichlet prior, dealt out by a token's share of the corpus, and the least for any token.
PRIOR, PRIOR_LEAST = 500.0, 0.5
Z_LEAST = 3.2
#: A segment is a passage if its chance is under this; it adds to the evidence if its chance is under a half.
LEVEL = 0.01
_TRIM = b".,;:!?|()[]{}\"'*$%&#<>-_"


def token(word: bytes) -> str:
    """A word in lower case without marks around it."""
    return word.strip(_TRIM).decode().lower()


def tokens(text: bytes | None) -> list[str]:
    return list(map(token, (text or b"").split()))


def forms(word: str) -> list[str]:
    """What a token may be known by: itself, and its first 4 to 8 letters where it has more."""
    return [word, *[f"{word[:k]}*" for k in range(4, 9) if len(word) > k]] if word else []


class _Known(dict):
    """Weights by raw word, looked up once for each different word, CACHE_WORDS kept."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float | None:
        found = [self.weights[f] for f in forms(token(word)) if f in self.weights]
        if len(self) >= CACHE_WORDS:
            self.clear()
        out = self[word] = max(found, key=abs, default=None)  # the form that tells most
        return out


def maximal_segments(scores) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, past the last, score) of a sequence, by Ruzzo and Tompa."""
    total, kept = 0.0, []  # kept: first, end, sum before, sum through
    for i, s in enumerate(scores):
        before = total
        total += s
        if s <= 0:
            continue
        first, left, right = i, before, total
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= left:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= right:
                kept.append((first, i + 1, left, right, j))
                break
            first, left = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, r - l) for a, b, l, r, _ in kept]


@dataclass
class ToxicModel:
    #: By token, or by a token's beginning and "*".
    weights: dict[str, float] = field(default_factory=dict)
    base: float = -0.1
    lam: float = 1.0
    log_k: float = math.log(0.1)
    #: Of the logistic: intercept, and the weight of the evidence.
    logistic: tuple[float, float] = (-3.0, 1.0)

    def __post_init__(self):
        self.known = _Known(self.weights)

    def __reduce__(self):
        return ToxicModel, (self.weights, self.base, self.lam, self.log_k, self.logistic)

    def passages(self, text: bytes | None) -> tuple[int, list[tuple[int, int, float, float]]]:
        """Tokens, and (first, past the last, score, log of the chance of it) of segments that chance makes in under half of such texts."""
        words, base = (text or b"").split(), self.base
        hits = [(i, s) for i, s in enumerate(map(self.known.__getitem__, words)) if s is not None]
        if not any(s > 0 for _, s in hits):
            return len(words), []
        # runs between known words have the background's weight for each of theirs
        seq, where, last = [], [], -1
        for i, s in hits:
            if i - last > 1:
                seq.append(base * (i - last - 1))
                where.append((last + 1, i))
            seq.append(s)
            where.append((i, i + 1))
            last = i
        n, out = max(len(words), 2), []
        for a, b, s in maximal_segments(seq):
            expected = self.log_k + math.log(n) - self.lam * s
            log_p = expected if expected < -20 else math.log(-math.expm1(-math.exp(min(5.0, expected))))
            if log_p < math.log(0.5):
                out.append((where[a][0], where[b - 1][1], s, log_p))
        return len(words), out

    def evidence(self, text: bytes | None) -> tuple[float, int, list]:
        """The evidence, the number of tokens, and the passages."""
        n, found = self.passages(text)
        return sum(-p for *_, p in found), n, [x for x in found if x[3] < math.log(LEVEL)]

    def best(self, text: bytes | None) -> tuple[int, float]:
        """Tokens, and the score of the best segment."""
        words, low = (text or b"").split(), self.base
        total = least = most = 0.0
        for x in map(self.known.__getitem__, words):
            total += low if x is None else x
            least = min(least, total)
            most = max(most, total - least)
        return len(words), most

    def score(self, evidence: float) -> float:
        x = self.logistic[0] + self.logistic[1] * min(evidence, 200.0)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


def _lambda(weights: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum(share * exp(lambda * weight)) = 1, of weights with negative mean."""
    lo, hi = 1e-6, 1.0
    f = lambda x: float((share * np.exp(np.minimum(x * weights, 700))).sum()) - 1
    while f(hi) < 0 and hi < 1e3:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def _sketch(words: list[str]) -> tuple[int, ...]:
    """The three least hashes of word pairs: mostly the same for near copies, and for them alone."""
    return tuple(heapq.nsmallest(3, {zlib.crc32(f"{a} {b}".encode()) for a, b in zip(words, words[1:], strict=False)}))


def fit(rows: list[tuple[bytes | None, int]]) -> ToxicModel:
    """From (text, label) of a bounded sample. With one class or none, the model scores everything low.

    Weights come from three quarters of the sample, where near copies count once and a token once for each document;
    the logistic comes from the rest.
    """
    docs = [(t, y) for _, t, y in sorted((zlib.crc32(t or b""), t or b"", int(y)) for t, y in rows)]
    counts, seen = (Counter(), Counter()), set()
    for text, y in (x for i, x in enumerate(docs) if i % 4 != 3 or len(docs) < 40):
        words = tokens(text)
        if (mark := (_sketch(words), y)) not in seen:
            seen.add(mark)
            counts[y].update({f for w in set(words) for f in forms(w)})
    model = ToxicModel()
    sums = [sum(c.values()) for c in counts]
    if not all(sums):
        return model
    whole = counts[0] + counts[1]
    total, z = sum(whole.values()), {}
    for w, c in whole.items():
        if c < 3:
            continue
        prior = PRIOR_LEAST + PRIOR * c / total
        a, b = counts[1][w] + prior, counts[0][w] + prior
        log_odds = math.log(a / (sums[1] + PRIOR - a)) - math.log(b / (sums[0] + PRIOR - b))
        score = log_odds / math.sqrt(1 / a + 1 / b)
        if abs(score) >= Z_LEAST:
            z[w] = (abs(score), log_odds * (1 - Z_LEAST / (abs(score) + 1e-9)))
    best = sorted(z, key=lambda w: (-z[w][0], w))[:VOCABULARY]
    model.weights = {w: max(-6.0, min(z[w][1], 6.0)) for w in best if abs(z[w][1]) > 0.05}
    if not any(x > 0 for x in model.weights.values()):
        model.weights = {}
    model.known = _Known(model.weights)
    if not model.weights:
        return model
    test = docs[3::4] if len(docs) >= 40 else docs
    clean = [text for text, y in test if not y] or [text for text, y in docs if not y]
    scores = Counter(x for text in clean for x in map(model.known.__getitem__, text.split()))
    n = max(1, sum(scores.values()))
    told = [x for x in scores if x is not None]
    # the drift makes the mean of other documents' token scores negative enough for an extreme-value law
    model.base = -max(0.05, 3 * sum(x * scores[x] for x in told if x > 0) / n)
    values = np.array([model.base, *told, max(model.weights.values())])
    share = np.array([scores[None], *(scores[x] for x in told), 0.5]) / (n + 0.5)
    model.lam = _lambda(values, share)
    law = [(max(m, 2), math.exp(-model.lam * top)) for m, top in map(model.best, clean) if m]
    model.log_k = math.log((len(law) + 0.5) / (sum(m * e for m, e in law) + 0.5))
    x = np.array([min(200.0, model.evidence(text)[0]) for text, _ in test])
    model.logistic = _logistic(x, np.array([y for _, y in test], np.float64))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Newton steps on a penalised likelihood with targets of Platt's calibration."""
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    design, w = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - target) + ridge * w
        hess = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        size = np.abs(step).max()
        w -= step * min(1.0, 2.0 / max(size, 1e-12))
        if size < 1e-8:
            break
    return float(w[0]), float(max(w[1], 0.0))


def learn(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> ToxicModel:
    """Fit on the rows of documents(doc_id, text) that labels(doc_id, toxic) marks, ``fit_docs`` at most by hash.

    Null labels and ids teach nothing. Fold and other restrictions are for the caller: pass only what may be seen.
    """
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").alias("toxic"))
    chosen = marked.orderBy(F.xxhash64("id"), "id").limit(fit_docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "id")
    # texts meet the driver within the documented bound
    return fit([(bytes(r.text) if r.text is not None else None, r.toxic) for r in rows.select("text", "toxic").toLocalIterator()])


def score_documents(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id, n_tokens, evidence, score, passages(first, last, score, log_p) of documents(doc_id, text).

    Null and empty texts have no passages and the score of no evidence. Rows are scored one by one: repeated
    rows return repeated rows, other columns are ignored, an empty table returns none.
    """
    passage = T.StructType([T.StructField("first", INT), T.StructField("last", INT), T.StructField("score", DBL), T.StructField("log_p", DBL)])
    schema = T.StructType([*fields(doc_id=LONG, n_tokens=LONG, evidence=DBL, score=DBL).fields, T.StructField("passages", T.ArrayType(passage))])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # VOCABULARY entries at most

    def run(batches):
        m = shared.value
        for b in slices(batches):
            out = ([], [], [], [])
            for t in b.column(1).to_pylist():
                e, n, found = m.evidence(t)
                for column, x in zip(out, (n, e, m.score(e), [{"first": a, "last": z - 1, "score": s, "log_p": p} for a, z, s, p in found]), strict=True):
                    column.append(x)
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("log_p", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.float64()), pa.array(out[3], kind)], schema.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)
