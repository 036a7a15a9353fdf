"""Language by nearest centroid: TF-IDF vectors of character n-grams against several centroids per language."""

from __future__ import annotations

import bisect
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BOOL, DBL, LONG, STR, fields, slices

#: Labelled documents that the model is fitted on at most, for each language and in all, by a hash of doc_id.
FIT_DOCS, FIT_ALL = 400, 2400
#: N-grams of 1 to 3 characters go to so many buckets by hash.
BUCKETS = 1 << 13
CENTROIDS = 4
UNKNOWN = "und"
#: Every so many of a language's documents builds no centroid: they and cuts of them say how near a text of so many
#: characters is at least. Below this share of that a text is rejected; one of a quantile in 500 sets it.
HELD, LENGTHS, REJECT_SHARE, LOWEST = 4, (32, 64, 128, 256, 512), 0.6, 0.002
#: A text of many characters is counted in parts of this size; the counts add up to those of the whole.
PART = 1 << 18
_M = np.uint32(2654435761)


def grams(text: str) -> np.ndarray:
    """Counts by bucket of the n-grams of a whole text: letters in lower case, anything else one space."""
    out = np.zeros(BUCKETS, np.float32)
    tail = np.array([32, 32], np.uint32)
    for i in range(0, len(text), PART):
        raw = text[i : i + PART].lower()
        x = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32)
        # ASCII marks and digits are spaces; runs of spaces count little by their idf
        x = np.where((x < 65) | (x > 90) & (x < 97) | (x > 122) & (x < 170), np.uint32(32), x)
        x = np.concatenate([tail, x])
        one = x[2:] * _M
        two = (x[1:-1] * np.uint32(31) + x[2:] + np.uint32(7)) * _M
        three = ((x[:-2] * np.uint32(31) + x[1:-1]) * np.uint32(37) + x[2:] + np.uint32(13)) * _M
        at = np.concatenate([one, two, three]) >> np.uint32(19)
        out += np.bincount(at[np.concatenate([x[2:] != 32, (x[2:] != 32) | (x[1:-1] != 32), x[1:-1] != 32])], minlength=BUCKETS)
        tail = x[-2:]
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and (text.isalpha() or any(map(str.isalpha, text)))


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # unit rows
    owner: np.ndarray
    floor: np.ndarray  # by language and length: a text below it is rejected

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, cosine of the nearest centroid, rejected) of each text."""
        out: list = [(UNKNOWN, 0.0, True)] * len(texts)
        for lo in range(0, len(texts), 256):
            at = [i for i in range(lo, min(lo + 256, len(texts))) if has_letter(texts[i])]
            if not at or not self.languages:
                continue
            x = weigh(np.stack([grams(texts[i]) for i in at]), self.idf)
            cos = x @ self.centroids.T
            best = cos.argmax(axis=1)
            for i, b, c in zip(at, best, cos.max(axis=1), strict=True):
                k = int(self.owner[b])
                out[i] = (self.languages[k], float(min(1.0, max(0.0, c))), bool(c < self.floor[k, length_class(texts[i])]))
        return out


def length_class(text: str) -> int:
    return bisect.bisect_right(LENGTHS, len(text))


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit rows of log-scaled counts times idf; ``counts`` itself is overwritten."""
    np.log1p(counts, out=counts)
    counts *= idf
    counts /= np.maximum(np.sqrt(np.einsum("ij,ij->i", counts, counts))[:, None], np.float32(1e-12))
    return counts


def _cluster(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Spherical k-means; unit rows."""
    rng = np.random.default_rng(seed)
    at = [int(rng.integers(len(x)))]
    while len(at) < min(k, len(x)):
        at.append(int((x @ x[at].T).max(axis=1).argmin()))
    c = x[at]
    for _ in range(12):
        near = (x @ c.T).argmax(axis=1)
        c = np.stack([x[near == j].sum(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _each(languages: int, fit_docs: int = FIT_DOCS) -> int:
    """Documents of each of so many languages."""
    return min(fit_docs, max(2, FIT_ALL // max(1, languages)))


def fit(rows: list[tuple[str, str]]) -> LanguageModel:
    """From (text, language) of a bounded sample."""
    rows = sorted((t, g) for t, g in rows if has_letter(t))
    languages = sorted({g for _, g in rows})
    if not rows:
        return LanguageModel([], np.ones(BUCKETS, np.float32), np.zeros((0, BUCKETS), np.float32), np.zeros(0, int), np.zeros((0, len(LENGTHS) + 1)))
    each = _each(len(languages))
    by_hash = sorted(rows, key=lambda r: (zlib.crc32(r[0].encode("utf-8", "surrogatepass")), r[0]))
    rows = sorted((r for g in languages for r in [x for x in by_hash if x[1] == g][:each]), key=lambda r: (r[1], r[0]))
    held = [rows[i] for i in range(len(rows)) if i % HELD == HELD - 1]
    if {g for _, g in held} == set(languages) and len(held) >= HELD * len(languages):
        rows = [rows[i] for i in range(len(rows)) if i % HELD != HELD - 1]
    else:
        held = rows  # too few to set any aside
    counts = np.stack([grams(t) for t, _ in rows])
    idf = (np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))) + 0.1).astype(np.float32)
    x, of = weigh(counts, idf), np.array([languages.index(g) for _, g in rows])
    centroids, owner = [], []
    for k in range(len(languages)):
        centroids.append(_cluster(x[of == k], CENTROIDS, k))
        owner += [k] * len(centroids[-1])
    return LanguageModel(languages, idf, np.concatenate(centroids).astype(np.float32), np.array(owner), _floors(held, languages, idf, centroids))


def _floors(held: list[tuple[str, str]], languages: list[str], idf: np.ndarray, centroids: list[np.ndarray]) -> np.ndarray:
    """By language and length class, from texts and from cuts of them; a class without any has the floor of the one below."""
    out = np.zeros((len(languages), len(LENGTHS) + 1))
    for k, g in enumerate(languages):
        near: list[list[float]] = [[] for _ in range(len(LENGTHS) + 1)]
        texts = [t for t, own in held if own == g]
        cuts = [t[at : at + n] for t in texts for n in (24, *(x + x // 2 for x in LENGTHS)) if n < len(t) for at in [zlib.crc32(t.encode("utf-8", "surrogatepass")) % (len(t) - n)]]
        parts = [t for t in texts + cuts if has_letter(t)]
        for lo in range(0, len(parts), 256):
            some = parts[lo : lo + 256]
            cos = (weigh(np.stack([grams(t) for t in some]), idf) @ centroids[k].T.astype(np.float32)).max(axis=1)
            for t, c in zip(some, cos, strict=True):
                near[length_class(t)].append(float(c))
        for i, c in enumerate(near):
            out[k, i] = REJECT_SHARE * float(np.quantile(c, LOWEST)) if c else out[k, i - 1] if i else 0.0
    return out


def learn(docs: DataFrame, fit_docs: int = FIT_DOCS) -> LanguageModel:
    """Fit on documents(doc_id, text, lang) with both text and lang, ``fit_docs`` of each language at most, by hash.

    ``und`` is no language to learn: rows so labelled say that theirs is not known.
    """
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL AND lang <> 'und'").select(F.xxhash64("doc_id").alias("h"), F.col("doc_id").alias("id"), "lang")
    # A language with many rows is thinned by hash before its rows meet; four times what is needed is left.
    sizes = F.broadcast(known.groupBy("lang").agg(F.least(F.lit(1.0), 4.0 * fit_docs / F.count("*")).alias("share")))  # a row per language
    some = known.join(sizes, "lang").where(F.pmod("h", F.lit(1 << 20)) < F.col("share") * (1 << 20))
    each = _each(known.select("lang").distinct().count(), fit_docs)
    chosen = some.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))).where(F.col("r") <= each)
    chosen = chosen.select("id").distinct()
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL AND lang <> 'und'").join(F.broadcast(chosen), docs.doc_id == chosen.id)
    return fit([(r.text, r.lang) for r in rows.select("text", "lang").toLocalIterator()])


PREDICTED = fields(doc_id=LONG, lang_pred=STR, score=DBL, rejected=BOOL)


def predict_documents(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score, rejected of documents(doc_id, text).

    A text that is null or has no letter is ``und``, score 0, rejected. Any other has the language of its nearest
    centroid; rejected says that even that one is too far. Rows are predicted one by one; other columns are
    ignored; an empty table returns no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of centroids for each language

    def run(batches):
        for b in slices(batches):
            got = shared.value.predict(b.column(1).to_pylist())
            columns = list(zip(*got, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.bool_())], PREDICTED.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PREDICTED)
