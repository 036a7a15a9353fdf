"""The pipeline's stages against plain Python."""

import itertools
import random
from collections import Counter

import pytest

import corpus_pipeline
from deepsift.llm import common, neartexts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def windows(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, words, least, most):
    """A copy with single words changed here and there, its five-word Jaccard to the first within the limits."""
    out, own = list(words), windows(" ".join(words))
    while True:
        at = rng.randrange(len(out))
        trial = [*out[:at], f"new{rng.randrange(10**6)}", *out[at + 1 :]]
        if (j := jaccard(own, windows(" ".join(trial)))) < least:
            return " ".join(out)
        out = trial
        if j <= most:
            return " ".join(out)


def near_rows():
    rng = random.Random(11)
    prose = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    rows = []
    for n in (40, 120, 400, 1000):
        for least, most in ((0.8, 0.82), (0.85, 0.87), (0.9, 0.92), (0.95, 0.99), (0.7, 0.79)):
            for _ in range(3):
                base = prose(n)
                rows += [" ".join(base), edited(rng, base, least, most)]
    base = prose(200)
    rows += [edited(rng, base, 0.88, 0.9) for _ in range(45)]  # a crowded group: pairs of 0.77 to 0.9
    rows += [edited(rng, base, 0.5, 0.6) for _ in range(15)]
    rows += [" ".join(base[:120] + prose(80)) for _ in range(30)]  # a common passage
    rows += [" ".join(prose(30)) for _ in range(60)]
    rows += [rows[0], rows[0].upper(), rows[0].replace(" ", "\n"), "one two", "One  two", "one two three", "", " \n", None]
    rng.shuffle(rows)
    out = [(i, t, "en", "s1", len(t or "")) for i, t in enumerate(rows)]
    return [*out, (7, "a repeated id with another text that is not near any", "en", "s1", 1), out[9], (None, "no id and no copies anywhere else at all", "en", "s1", 1), (None, "another text that has no id and no copies", "en", "s1", 1), (None, out[3][1], "en", "s1", 1)]


def brute_kept(rows):
    sets, root = [windows(r[1]) for r in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if jaccard(sets[a], sets[b]) >= 0.8:
            root[find(a)] = find(b)
    best = {}
    for i, r in enumerate(rows):
        k = find(i)
        if k not in best or (r[0] is None, r[0]) < (best[k][0] is None, best[k][0]):
            best[k] = r
    return best.values()


@pytest.mark.parametrize("small", [2, 16, 10_000])
def test_near_duplicates(spark, small):
    rows = near_rows()
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = neartexts.keep_first(docs, common.Scratch(spark, "t"), small).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in brute_kept(rows))


def test_near_duplicates_stage(spark):
    rows = near_rows()
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS), "")
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter((r[0], r[1]) for r in brute_kept(rows))
    assert corpus_pipeline.near_duplicates(spark, spark.createDataFrame([], DOCS), "").count() == 0


def test_lines_stage(spark):
    """A line of 10 characters or more stays in the document with the smallest doc_id only; n_chars follows."""
    rng = random.Random(4)
    pool = [f"a shared line number {i}" for i in range(20)] + ["short", ""]
    texts = ["\n".join([rng.choice(pool), f"own line of document {i}", rng.choice(pool).upper()]) for i in range(60)]
    rows = [(i, t, "en", "s1", len(t)) for i, t in enumerate(texts)]
    owner = {}
    for i, t in enumerate(texts):
        for x in t.lower().split("\n"):
            if len(x) >= 10:
                owner.setdefault(x, i)
    kept = ["\n".join(x for x in t.split("\n") if owner.get(x.lower(), i) == i) for i, t in enumerate(texts)]
    got = corpus_pipeline.lines(spark, spark.createDataFrame(rows, DOCS), "")
    assert sorted(map(tuple, got.collect())) == [(i, t, "en", "s1", len(t)) for i, t in enumerate(kept)]


def test_language_stage(spark):
    """Each row decides for itself by the model's verdict on its text; nothing else changes."""
    from deepsift.llm import langid

    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["lorem", "ipsum", "dolor", "amet"]) for _ in range(30)), "xx", "s1", 1) for i in range(100)]
    rows += [(7, "12 34 !?", None, "s1", 1), (None, rows[3][1], None, "s1", 1), (8, None, None, "s1", 1), (9, "ЖЖЖ ЩЩЩ ЮЮЮ", None, "s1", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    model = langid.learn(docs)
    want = Counter(r for r in rows if not model.predict([r[1]])[0][2])
    assert Counter(map(tuple, corpus_pipeline.language(spark, docs, "").collect())) == want and sum(want.values()) == 101


def test_mixture_stage_and_run(spark, tmp_path):
    """Each document comes as often as the mixture's plan takes it, and run() is its stages one after the other."""
    from deepsift.llm import mixing

    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["lorem", "ipsum", "dolor", "amet", f"w{i}"]) for _ in range(rng.randint(20, 60))), "xx", f"s{i % 7 % 3}", 1) for i in range(80)]
    docs = spark.createDataFrame(rows, DOCS)
    want = Counter({r.doc_id: r.taken // r.size for r in mixing.mix(docs).collect() if r.taken})
    got = corpus_pipeline.mixture(spark, docs, "").collect()
    assert Counter(r.doc_id for r in got) == want and {tuple(r) for r in got} <= set(rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    step = docs
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, str(tmp_path))
    pieces = lambda df: Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert pieces(corpus_pipeline.run(spark, str(tmp_path))) == pieces(step) != Counter()


def test_odd_rows_and_names(spark):
    """Null and repeated ids, null and empty texts, repeated rows and columns of any name pass every stage."""
    rng = random.Random(9)
    prose = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "amet", "sit"]) + str(rng.randrange(50)) for _ in range(n))
    rows = [(i, prose(40), "xx", rng.choice(["a", "b", None]), 1) for i in range(60)]
    rows += [(None, prose(40), "xx", "a", 1), (None, prose(40), None, None, 1), (5, prose(40), "xx", "a", 1), (5, None, None, None, None), (None, "", "xx", "b", 0), rows[3], rows[3], (70, "1 2 3", None, "b", 5)]
    names = ["key", "id", "times", "c0", "p_id", "n_lines", "rows", "h", "own", "__k", "__id", "__row", "size", "text_hash", "n", "root"]
    plain = spark.createDataFrame(rows, DOCS)
    docs = plain.select("*", *[common.F.lit(c).alias(c) for c in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got, alone = stage(spark, docs, ""), stage(spark, plain, "")
        assert got.columns == docs.columns, name
        many = Counter(map(tuple, alone.collect()))
        assert Counter(map(tuple, got.select(*plain.columns).collect())) == many, name
        assert {tuple(r) for r in got.select(*names).collect()} == {tuple(names)}, name
        if name == "language":
            assert sum(many.values()) == len(rows) - 3
        if name == "lines":
            assert Counter((k[0], k[1]) for k in many.elements()) == Counter((r[0], r[1]) for r in rows)
        if name == "near_duplicates":
            assert Counter((k[0], k[1]) for k in many.elements()) == Counter((r[0], r[1]) for r in brute_kept(rows))
        assert stage(spark, docs.limit(0), "").count() == 0, name
    assert Counter(r.doc_id for r in corpus_pipeline.packed(spark, docs, "").collect())[None] == 3
