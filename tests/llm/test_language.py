"""The sample that the languages are learnt from."""

import random

from deepsift.llm import langid


def test_many_languages_are_learnt_in_all_their_scripts(spark):
    """Of 20 languages with 400 texts, half of each in a second script, 120 texts each are the fit's share."""
    rng = random.Random(8)
    word = lambda first, n: "".join(chr(first + rng.randrange(26)) for _ in range(n))
    rows = []
    for g in range(20):
        scripts = [[word(97, 5) for _ in range(12)], [word(0x430, 5) for _ in range(12)]]
        rows += [(len(rows) + i, " ".join(rng.choice(scripts[i % 2]) for _ in range(25)), f"l{g:02}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(df)
    got = {r.doc_id: r for r in langid.predict_documents(df, model).collect()}
    right = [got[i].lang_pred == g and not got[i].rejected for i, _, g in rows]
    assert sum(right[1::2]) >= 0.98 * len(right) / 2 and sum(right[::2]) >= 0.98 * len(right) / 2


def test_fit_takes_texts_by_hash():
    rows = [(f"{'abcdefgh'[i % 8]} text number {i}", f"l{g}") for g in range(12) for i in range(400)]
    seen = []
    grams = langid.grams
    try:
        langid.grams = lambda t: seen.append(t) or grams(t)
        langid.fit(rows)
    finally:
        langid.grams = grams
    assert len(seen) == langid.FIT_ALL and len({t[0] for t in seen}) == 8
