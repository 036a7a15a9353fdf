"""The ten operators against brute force, and nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from deepsift.llm import chat, common, golay, langid, linededup, mixing, packing, quality, segments, sharding, simhash, vectors
from deepsift.llm.mphf import PerfectHash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = " \t\n\x0b\x0c\r"


def odd_docs():
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "déjà", "it's", "x1", "!!", "une", "der", "los"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s3", "s4", None]), 1) for i in range(120)]
    base = rows[7][1] + " end of one text that is long enough to be told apart from others"
    rows += [(200 + i, base, "en", "s1", 1) for i in range(40)]  # copies
    rows += [(300 + i, f"{base} {i}", "en", "s1", 1) for i in range(40)]  # near copies
    rows += [(400, None, None, None, None), (401, "", "en", "s1", 0), (402, " \n\t", "en", "s2", 3), (403, "word " * 60_000, "en", "s1", 9), (None, "a text without an id\nshared line of text", "en", "s1", 1)]
    rows += [(500, "shared line of text\nown\n\nShared LINE of text ", "en", "s2", 1), (501, "x\nshared line of text", "fr", "s2", 1), (501, "x\nshared line of text", "fr", "s2", 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(odd_docs(), DOCS)
    return df.withColumns({c: F.lit("clash") for c in ("fp", "shard", "slot", "key", "label", "component_id", "size", "h1", "sequence_id", "score", "stratum", "n_lines")})


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


def test_golay_code():
    words = np.arange(1 << 12) << 11
    codes = np.array([w ^ int(golay._remainder(int(w))) for w in words[:200]])
    assert min(bin(int(a ^ b)).count("1") for a, b in itertools.combinations(codes[:60], 2)) >= 7
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 22, 500)
    flips = (1 << rng.integers(0, 22, 500)) ^ (1 << rng.integers(0, 22, 500))
    for x, y in zip(golay.fuzzy_keys(a, 22), golay.fuzzy_keys(a ^ flips, 22)):
        assert {*x} & {*y} - {-1}


def brute_fingerprint(text):
    words = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def check_simhash(rows, got):
    prints = {int(r.fingerprint, 16) for r in got}
    roots = brute_components(prints, [(a, b) for a, b in itertools.combinations(prints, 2) if bin(a ^ b).count("1") <= 2])
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            k = roots[brute_fingerprint(t)]
            least[k] = min(least.get(k, i), i)
    want = Counter((i, f"{brute_fingerprint(t):016x}", least.get(roots[brute_fingerprint(t)])) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def test_simhash(spark, docs):
    check_simhash([r for r in odd_docs() if r[0] != 403] + [odd_docs()[-5]], simhash.near_duplicates(docs).collect())
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_simhash_crowded_keys(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    prints = {base ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (0, 1, 2, 2, 3, 4) for _ in range(60)} | {rng.getrandbits(64) for _ in range(100)}
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    for small in (2, 24, 10_000):
        scratch = common.Scratch(spark, "t")
        edges = [(r.u, r.v) for r in simhash.links(df, scratch, small).collect()]
        mask = (1 << 64) - 1
        assert all(bin((u ^ v) & mask).count("1") <= 2 for u, v in edges)
        signed = {simhash._signed(p) for p in prints}
        want = brute_components(signed, [(a, b) for a, b in itertools.combinations(signed, 2) if bin((a ^ b) & mask).count("1") <= 2])
        roots = {r.node: r.root for r in common.components(simhash.links(df, scratch, small), scratch).collect()}
        assert all(roots.get(n, n) == want[n] for n in signed)


def test_components_chain(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 101), (100, 101)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "u long, v long"), common.Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_maximal_segments():
    def brute(x):
        if not any(v > 0 for v in x):
            return []
        s, i, j = max(((sum(x[i:j]), i, j) for i in range(len(x)) for j in range(i + 1, len(x) + 1)), key=lambda t: (t[0], -t[2] + t[1]))
        return [*brute(x[:i]), (i, j), *[(a + j, b + j) for a, b in brute(x[j:])]]

    rng = random.Random(1)
    for _ in range(200):
        x = [rng.choice([-3, -2, -1, 1, 2, 5]) + rng.random() / 1e3 for _ in range(rng.randint(0, 13))]
        assert [(a, b) for a, b, _ in segments.maximal_segments(x)] == brute(x)


def test_toxicity(spark, docs):
    rng = random.Random(2)
    clean = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(1000):
        words = [rng.choice(clean) for _ in range(rng.randint(20, 200))]
        if i % 5 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(["Nasty!", "vile,", "rotten"]))
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    known = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = segments.learn(known.where("doc_id < 900"), known.select("doc_id", "toxic").unionByName(spark.createDataFrame([(None, 1), (5, None)], "doc_id long, toxic int")))
    got = {r.doc_id: r for r in segments.score_documents(known, model).collect()}
    assert sum((got[i].score >= 0.5) == bool(y) for i, _, y in rows if i >= 900) >= 98
    at = got[905].passages[0]
    assert rows[905][1].split()[at["first"] : at["last"] + 1][0].lower().strip("!,") in ("nasty", "vile", "rotten")
    odd = segments.score_documents(docs, model).collect()
    assert len(odd) == len(odd_docs()) and all(0 <= r.score <= 1 for r in odd)
    assert segments.score_documents(empty(spark), segments.learn(empty(spark), empty(spark, "doc_id long, toxic int"))).count() == 0


def test_quality(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 100)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = quality.judge(docs, labels).collect()
    want = Counter()
    for i, t, *_ in odd_docs():
        words = [w for w in (t or "").encode().split()]
        windows = Counter(zip(words, words[1:], words[2:]))
        hit = {j + k for j in range(len(words) - 2) if windows[tuple(words[j : j + 3])] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if x.strip(BLANK)]
        want[i, len(words), sum(len(w.decode()) for w in words), sum(map((t or "").count, "#*$%&|<>")), len(lines) - len(set(lines)), len(hit), len(words) < 50 or 100 * len(hit) > 50 * len(words)] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(r.kept == (not r.base_failed and not r.failed_rules) for r in got)
    assert quality.judge(empty(spark), empty(spark, "doc_id long, quality int")).count() == 0


def test_binomial_bound_and_cutoffs():
    for k, n, p in ((0, 10, 0.1), (3, 50, 0.07), (40, 2000, 0.02)):
        assert math.isclose(quality.binomial_cdf(k, n, p), sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel_tol=1e-9)
        assert abs(quality.binomial_cdf(k, n, quality.upper_bound(k, n, 0.01)) - 0.01) < 1e-6
    rng = np.random.default_rng(1)
    rows = [(i, "en", int(i % 10 > 0), (float(rng.random() + (i % 10 == 0) * 2), *[0.0] * 5)) for i in range(20_000)] + [(i, "fr", 1, (9.0, *[0.0] * 5)) for i in range(20)]
    cuts = quality.choose_cutoffs(rows)
    assert 0.99 < cuts["en"][0] < 2.2 and cuts["fr"][0] == math.inf


def test_language(spark, docs):
    rng = random.Random(4)
    parts = {"xx": ["lorem", "ipsum", "dolor", "amet"], "yy": ["który", "gdzie", "jest", "był"], "zz": ["the", "and", "with", "from"]}
    rows = [(i, " ".join(rng.choice(parts[g]) for _ in range(30)), g) for i, g in enumerate(itertools.islice(itertools.cycle(parts), 300))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(df.where("doc_id % 3 <> 5").unionByName(spark.createDataFrame([(1, None, "xx"), (2, "text", None)], df.schema)))
    got = {r.doc_id: r for r in langid.predict_documents(df, model).collect()}
    assert all(got[i].lang_pred == g and not got[i].rejected for i, _, g in rows)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !?"), (4, "ЖЖЖ ЩЩЩ ЮЮЮ"), (5, "lorem " * 100_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict_documents(odd, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[4].rejected and got[5].lang_pred == "xx"
    text = "Ünïcode test lörem " * 40_000
    assert np.array_equal(langid.grams(text), (lambda p: (setattr(langid, "PART", 1 << 30), langid.grams(text), setattr(langid, "PART", p))[1])(langid.PART))
    assert len(langid.predict_documents(docs, model).collect()) == len(odd_docs())
    assert langid.predict_documents(empty(spark), langid.learn(empty(spark))).count() == 0


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack(docs, path).collect()
    left = defaultdict(list)
    for r in got:
        left[r.doc_id, r.doc_tokens].append(r)
    want = Counter()
    for i, t, *_ in odd_docs():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        for s in range(0, len(ids), 4096):
            part = ids[s : s + 4096]
            want[i, s, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    at = defaultdict(int)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values()) <= 4096 and sorted(at) == list(range(len(at)))
    assert packing.pack(empty(spark), path).count() == 0


def test_column_generation():
    width, demand = np.array([30, 45, 60]), np.array([97.0, 610.0, 395.0])
    patterns, x, bound = packing.generate_columns(width, demand, 100)
    assert np.allclose(x @ patterns, demand) and (patterns @ width <= 100).all() and bound <= x.sum() + 1e-9
    assert abs(x.sum() - 730.5) < 40  # 610 in pairs of two 45s or one 45 and one 30; 60 leaves room for 30
    rng = np.random.default_rng(0)
    lengths = np.minimum(4095, np.exp(rng.normal(6, 1, 5000)).astype(int) + 1)
    bounds = packing.class_bounds()
    plan = packing.layout(np.bincount(np.searchsorted(bounds, lengths), minlength=len(bounds)), bounds)
    assert lengths.sum() / 4096 / plan.sequences > 0.97 and plan.sequences >= plan.bound - 1e-6


def test_line_dedup(spark, docs):
    got = linededup.dedup_lines(docs)
    assert got.columns[-2:] == ["n_lines", "n_dropped"] and "shard" in got.columns
    owner = {}
    for i, t, *_ in odd_docs():
        for x in (t or "").split("\n"):
            if len(k := x.strip(BLANK).translate(FOLD)) >= 10 and i is not None:
                owner[k] = min(owner.get(k, i), i)
    want = Counter()
    for i, t, *_ in odd_docs():
        lines = (t or "").split("\n")
        kept = [x for x in lines if owner.get(x.strip(BLANK).translate(FOLD), i) == i]
        want[i, None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()) == want
    assert linededup.dedup_lines(empty(spark)).count() == 0


def test_line_dedup_hot_shards(spark, docs, monkeypatch):
    want = Counter((r.doc_id, r.text) for r in linededup.dedup_lines(docs).collect())
    monkeypatch.setattr(linededup, "SHARD_KEYS", 20)
    monkeypatch.setattr(linededup, "HOT_LEAST", 5)
    monkeypatch.setattr(linededup, "HOT", 4)
    assert Counter((r.doc_id, r.text) for r in linededup.dedup_lines(docs).collect()) == want


@pytest.mark.parametrize("n", [0, 1, 2, 9, 5000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for _ in range(2))
    made = PerfectHash.build(a, b)
    assert sorted(made.slot(a, b).tolist()) == list(range(n))


CHAT = "conv_id long, turn long, role string, text string"


def test_chat(spark):
    full = [("user", "hi"), ("assistant", "hello <|im_end|>"), ("user", "bye"), (None, None)]
    rows = [(c, t, *x) for c, n in ((1, 1), (2, 2), (3, 4), (4, 4), (5, 3)) for t, x in enumerate(full[:n])]
    rows += [(6, 0, "user", "hi"), (6, 1, "user", "other"), (None, 0, "user", "lone"), (7, 0, "a", "tie"), (7, 0, "a", "tie"), (8, None, "a", "no turn")]
    got = {r.conv_id: r for r in chat.maximal_conversations(spark.createDataFrame(rows, CHAT).withColumn("n", F.lit(1)).withColumn("h1", F.lit(2))).collect()}
    assert set(got) == {3, 6, None, 7, 8} and got[3].n_copies == 2 and got[3].n_turns == 4
    assert got[3].rendered.startswith("<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello < |im_end|><|im_end|>\n")
    assert chat.maximal_conversations(spark.createDataFrame([], CHAT)).count() == 0


def test_source_targets():
    sizes = {"b": 10, "a": 100, None: 50, "c": 40}
    got = mixing.source_targets(sizes)
    assert sum(got.values()) == 200 and all(got[s] <= 3 * n for s, n in sizes.items()) and got["b"] == 30
    assert got["c"] / got["a"] == 3


def test_mixing(spark, docs):
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.size, r.taken)
    assert sorted(map(key, got), key=str) == sorted(map(key, again), key=str)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len((t or "").encode().split())) for i, t, *_ in odd_docs())
    assert all(r.taken <= 3 * r.size for r in got)
    assert mixing.mix(empty(spark)).count() == 0


def test_mixing_balance(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(1, 300), f"s{i % 5}" if i % 3 else "s0") for i in range(6000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=256).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - t) / t < 0.005 for s, t in target.items())


def test_flight_keeps_totals():
    rng = np.random.default_rng(3)
    prob, size = rng.random(2000), rng.integers(1, 500, 2000).astype(float)
    out = mixing.flight(prob, size, rng)
    left = (out > 0) & (out < 1)
    assert left.sum() <= 2 and math.isclose(out.sum(), prob.sum(), rel_tol=1e-6) and math.isclose(out @ size, prob @ size, rel_tol=1e-6)


@pytest.mark.parametrize("block, fan", [(256, 8), (16, 2)])
def test_vectors(spark, monkeypatch, block, fan):
    """Small blocks make a tree of several levels."""
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "FAN", fan)
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(6, 16))
    rows = []
    for i in range(700):
        v = centers[i % 6] + rng.normal(size=16) * (0.02 if i % 2 else 0.15)
        rows.append((i, [float(x) for x in np.float32(v)], i % 3 if i % 50 else None))
    rows += [(1000 + i, rows[7][1], 1) for i in range(30)] + [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [None, 1.0], 1), (2004, [], 1), (2005, [1.0, 0.0], 1), (2006, [2.0, 0.0], 1), (2007, [float("inf")] * 16, 1), (2007, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("dim", F.lit("x")).withColumn("row", F.lit("x"))
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df).collect())
    ok = [(k, i, np.array(v, float), g) for k, (i, v, g) in enumerate(rows) if v and g is not None and None not in v and np.isfinite(v).all() and any(v)]
    linked = [(a[0], b[0]) for a, b in itertools.combinations(ok, 2) if a[3] == b[3] and len(a[2]) == len(b[2]) and a[2] @ b[2] / np.linalg.norm(a[2]) / np.linalg.norm(b[2]) >= 0.98]
    roots, degree, least = brute_components(range(len(rows)), linked), Counter(x for p in linked for x in p), {}
    for k, r in enumerate(rows):
        least[roots[k]] = min(least.get(roots[k], r[0]), r[0])
    assert len(linked) > 1000
    assert got == Counter((r[0], degree[k], least[roots[k]], r[0] == least[roots[k]]) for k, r in enumerate(rows))
    assert vectors.near_vectors(empty(spark, "vec_id long, embedding array<float>, label int")).count() == 0
    named = df.where("vec_id < 200").withColumn("label", F.concat(F.lit("l"), "label"))
    assert {r.vec_id: r.n_links for r in vectors.near_vectors(named).collect()} == {r.vec_id: r.n_links for r in vectors.near_vectors(df.where("vec_id < 200")).collect()}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 41, 1000])
def test_sharding(spark, n):
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("x").alias("shard"))
    got = sharding.shards(df, ["doc_id"], 40).collect()
    again = sharding.shards(df.repartition(5), ["doc_id"], 40).collect()
    assert sorted(got) == sorted(again)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and sorted(r.doc_id for r in got) == list(range(n))
    sizes = [len(by[s]) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1


def test_sharding_of_odd_rows(spark, docs):
    rows = docs.select("doc_id", F.length("text").alias("size"))
    got = sharding.shards(rows, ["doc_id", "size"], 7).collect()
    assert len({(r.shard, r.slot) for r in got}) == len(got) == len(odd_docs())


def test_row_numbers(spark, docs):
    got = common.number_rows(docs.select("doc_id"), ["doc_id"], common.Scratch(spark, "t"), "no").orderBy("no").collect()
    assert [r.no for r in got] == list(range(len(odd_docs())))
    assert [r.doc_id for r in got] == sorted((i for i, *_ in odd_docs()), key=lambda i: (i is not None, i))


def test_hash_of_kept_text(spark):
    df = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    assert linededup.dedup_lines(df).select(F.sha2("text", 256)).first()[0] == hashlib.sha256(b"a\nb").hexdigest()
