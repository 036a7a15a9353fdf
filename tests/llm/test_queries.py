"""The queries' own columns - folds, sizes, checksums, laws - against plain Python over the smallest tables."""

import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from deepsift.llm import queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_toxicity_query(spark, docs):
    got = queries.op2_toxicity(spark, SF).collect()
    assert Counter(r.doc_id for r in got) == Counter(list(docs))
    for r in got:
        assert r.held_out == (fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        words = (docs[r.doc_id].text or "").split()
        assert all(0 <= p["first"] < p["last"] <= len(words) and p["log_p"] < -4.6 for p in r.passages)


def test_toxicity_query_learns_from_its_folds_only(spark, docs, tmp_path):
    """Labels of the held-out fold may be anything."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    other = spark.createDataFrame([(r.doc_id, r.quality, 1 - r.toxic if fold(r.doc_id, 5) == 0 and r.toxic is not None else r.toxic) for r in labels.collect()], labels.schema)
    other.write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{SF}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    score = lambda sf: {r.doc_id: r.score for r in queries.op2_toxicity(spark, sf).collect()}
    assert score(SF) == score(str(tmp_path))


def test_language_query(spark, docs):
    got = queries.op4_language(spark, SF).collect()
    known = {d.lang for i, d in docs.items() if d.lang and fold(i, 4) != 2}
    assert Counter(r.doc_id for r in got) == Counter(list(docs))
    for r in got:
        text = docs[r.doc_id].text
        lettered = bool(text) and any(c.isalpha() for c in text)
        assert r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1
        assert r.lang_pred in known if lettered else r.lang_pred == "und"


def test_mixing_query(spark, docs):
    got = queries.op8_mixing(spark, SF).collect()
    size = {i: len(WORD.findall(d.text or "")) for i, d in docs.items()}
    by = Counter()
    for i, d in docs.items():
        by[d.source] += size[i]
    order = sorted(s for s in by if s is not None) + [None] * (None in by)
    weight, target, open_, left = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}, {}, set(order), Fraction(sum(by.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * by[s]}
        target |= {s: Fraction(3 * by[s]) for s in over} if over else share
        left -= sum(3 * by[s] for s in over)
        open_ = open_ - over if over else set()
    taken = Counter()
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == by[docs[r.doc_id].source] and r.target == pytest.approx(float(target[docs[r.doc_id].source]))
        assert r.taken % max(1, r["size"]) == 0 and r.taken <= 3 * r["size"]
        taken[docs[r.doc_id].source] += r.taken
    assert len(got) == len(docs) and all(abs(taken[s] - target[s]) <= max(5, 0.02 * by[s]) for s in by)
    assert sorted(map(tuple, got)) == sorted(map(tuple, queries.op8_mixing(spark, SF).collect()))


def test_mixing_without_ansi(spark):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        docs = spark.createDataFrame([(1, None, "a"), (2, "one two", "a"), (None, "x", None), (None, "x", None), (None, None, None)], "doc_id long, text string, source string")
        assert sorted(r["size"] for r in queries.mixing.mix(docs).collect()) == [0, 0, 1, 1, 2]
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_mixed_rows(spark):
    """Rows come back whole, repeated and null ids among them, as often as the plan takes them."""
    rows = [(None, "a b c", "s", 1), (None, "a b c", "s", 2), (None, "d e", "s", 3), (5, "f g h i", "t", 4), (5, "j k", "t", 5), (6, None, None, 6)] + [(10 + i, "w " * (i % 7 + 1), "u", 7) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, times int")
    plan, got = Counter(), Counter()
    for r in queries.mixing.mix(docs).collect():
        plan[r.doc_id, r["size"], r.source] += r.copies
    for r in queries.mixing.mixed(docs).collect():
        got[r.doc_id, len((r.text or "").split()), r.source] += 1
        assert tuple(r) in rows
    assert got == +plan


def test_sharding_query(spark, docs):
    got = queries.op10_sharding(spark, SF).collect()
    slots = defaultdict(list)
    for r in got:
        raw = (docs[r.doc_id].text or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None) and 0 <= r.shard < 40
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(x) == list(range(len(x))) for x in slots.values()) and len(got) == len(docs)


def test_quality_query(spark, docs):
    for r in queries.op3_quality(spark, SF).collect():
        words = WORD.findall(docs[r.doc_id].text or "")
        assert r.n_words == len(words) and r.word_chars == sum(map(len, words))
        assert r.base_failed == (len(words) < 50 or 100 * r.n_repeat_words > 50 * len(words)) and not (r.kept and r.base_failed)
        assert r.kept == (not r.base_failed and not r.failed_rules)


def test_shared_folder(spark):
    """On a cluster an unset shared folder is an error."""
    from deepsift.llm import common

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: None)})
        sparkContext = Context()

    with pytest.raises(ValueError):
        common.shared_dir(Session())
