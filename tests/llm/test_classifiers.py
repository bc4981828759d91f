import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.llm import language, toxicity
from kinweave.llm.common import held_out
from kinweave.llm.linear import Ftrl, WordMemo, lower_words, softmax, temperature

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["ör", "ßen", "üh", "acht"], "cc": ["ción", "ña", "ll", "que"]}


def _text(kind, rng, words=30):
    return " ".join("".join(rng.choices(SYLLABLES[kind], k=rng.randint(1, 3))) for _ in range(words))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    return [(i, _text(kind, rng), kind) for i, kind in enumerate(["aa", "bb", "cc"] * 80)]


SCHEMA = "doc_id long, text string, lang string, score string, lang_pred string, row string"


def test_language_accuracy_on_held_out_rows_and_defined_cases(spark, texts):
    df = spark.createDataFrame([(*r, "s", "l", "r") for r in texts], SCHEMA)
    model = language.train_on_kept_in(df)
    odd = [(1000, None), (1001, ""), (1002, "123 ... !"), (1003, "ka" * 50_000), (1004, "日本"), (1003, "ka" * 50_000), (None, "ción ña")]
    rows = df.unionByName(spark.createDataFrame([(i, t, None, "s", "l", "r") for i, t in odd], SCHEMA))
    out = language.identify(rows, model).withColumn("held", held_out(F.col("doc_id"))).collect()
    assert len(out) == len(texts) + len(odd) and set(out[0].asDict()) == {*df.columns, "held"}
    tested = [r for r in out if r.held and r.lang]
    assert len(tested) > 20 and sum(r.lang == r.lang_pred for r in tested) >= 0.95 * len(tested)
    by_id = {r.doc_id: r for r in out}
    for i in (1000, 1001, 1002):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert by_id[1003].lang_pred == "aa" and by_id[1004].lang_pred in SYLLABLES and 0 <= by_id[1004].score <= 1
    assert by_id[None].lang_pred == "cc"


def test_language_learns_nothing_from_nulls_or_held_out_rows(spark, texts):
    held = [(i, t, k) for i, t, k in texts]
    df = spark.createDataFrame([(*r, "s", "l", "r") for r in held], SCHEMA)
    base = language.train_on_kept_in(df)
    changed = df.withColumn("lang", F.when(held_out(F.col("doc_id")), "zz").otherwise(F.col("lang"))).withColumn("score", F.lit("other"))
    again = language.train_on_kept_in(changed)
    assert base.languages == again.languages == ("aa", "bb", "cc") and np.array_equal(base.weights, again.weights)
    nothing = language.train_on_kept_in(df.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in language.identify(df, nothing).collect()} == {("und", 0.0)}
    assert language.identify(df.limit(0), base).count() == 0


def test_word_ngrams_mark_ends_and_skip_what_is_no_letter():
    one, two, none, split = language.word_ngrams([b"ab", "añ".encode(), "—".encode(), "ab—ab".encode()])
    assert len(one) == 2 + 3 + 2 and len(two) == 7 and len(none) == 0
    assert sorted(split) == sorted([*one, *one])
    alone = language.word_ngrams([b"ab"])[0]
    assert np.array_equal(one, alone)


def test_ftrl_learns_sparsely_and_temperature_calibrates():
    zeros = []
    for l1 in (0.0, 6.0):
        rng = np.random.default_rng(0)
        model = Ftrl(50, 2, 0.5, 1.0, l1, 0.1)
        for _ in range(600):
            x = rng.integers(0, 2, 50).astype(float)
            x[1] = 1.0
            at = np.flatnonzero(x)
            model.learn(at, x[at], np.eye(2)[int(x[0] > 0)])
        w = model.weights()
        assert w[0, 1] > 1 and w[1, 1] < 0 and np.abs(w[2:]).max() < w[0, 1] / 5
        zeros.append((w[2:] == 0).mean())
    assert zeros[0] == 0 and zeros[1] > 0.3
    logits = np.tile([[4.0, 0.0]], (100, 1))
    targets = np.eye(2)[[0] * 75 + [1] * 25]
    heat = temperature(logits, targets)
    assert abs(softmax(logits / heat)[0, 0] - 0.75) < 0.02


def test_memo_is_bounded_and_its_results_are_not():
    small, large = (WordMemo(lambda words: [len(w) for w in words], limit) for limit in (2, 1000))
    for text in (["aa b cccc", "b"], ["dd", ""], ["aa b"]):
        words = [lower_words(t) for t in text]
        values = [[[m.held[s] for s in slots] for slots in m.slots(words)] for m in (small, large)]
        assert values[0] == values[1]
    assert len(small.index) <= 4


def _toxic_rows():
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        words = _text("aa" if i % 2 else "bb", rng, 60).split()
        bad = i % 5 == 0
        if bad:
            for k in rng.sample(range(60), 3):
                words[k] = rng.choice(["idiot", "moron", "scum"]) if i % 2 else "grumpf" + rng.choice(SYLLABLES["bb"])
        rows.append((i, " ".join(words)))
        labels.append((i, None if i % 17 == 0 else int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows_and_defined_cases(spark, docs):
    rows, labels = _toxic_rows()
    df, known = docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train_on_kept_in(df, known)
    odd = docs([(1000, None), (1001, ""), (1002, "clean " * 30_000), (1003, "you idiot moron scum"), (1003, "you idiot moron scum"), (None, "ka lo")])
    out = toxicity.score(df.unionByName(odd), model).withColumn("held", held_out(F.col("doc_id"))).collect()
    assert len(out) == len(rows) + 6
    truth = {i: i % 5 == 0 for i, _ in rows}
    tested = [r for r in out if r.held and r.doc_id in truth]
    assert sum((r.predicted == 1) == truth[r.doc_id] for r in tested) >= 0.95 * len(tested)
    by_id = {r.doc_id: r for r in out}
    assert by_id[1000].score == by_id[1001].score < 0.3 and by_id[1002].predicted == 0 and by_id[1003].predicted == 1
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)


def test_toxicity_ignores_held_out_labels_and_handles_missing_classes(spark, docs):
    rows, labels = _toxic_rows()
    df, known = docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    base = toxicity.train_on_kept_in(df, known)
    flipped = known.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.train_on_kept_in(df, flipped)
    assert np.array_equal(base.features, again.features) and np.array_equal(base.weights, again.weights)
    for keep, score in ((1, 1.0), (0, 0.0), (None, 0.0)):
        only = known.filter(F.col("toxic") == keep) if keep is not None else known.limit(0)
        got = {r.score for r in toxicity.score(df, toxicity.train_on_kept_in(df, only)).collect()}
        assert len(got) == 1 and abs(got.pop() - score) < 1e-9
    assert toxicity.score(df.limit(0), base).count() == 0


def test_label_model_finds_accuracies_and_correlated_voters():
    rng = np.random.default_rng(3)
    n = 6000
    truth = rng.random(n) < 0.3
    fire = lambda yes, no: rng.random(n) < np.where(truth, yes, no)
    good, weak = fire(0.8, 0.02), fire(0.4, 0.2)
    twin = np.where(rng.random(n) < 0.97, good, fire(0.8, 0.02))
    toxic = fire(0.9, 0.05)
    votes = np.stack([good, twin, weak, ~toxic, toxic], axis=1)
    model = toxicity.fit_label_model(votes, np.ones(n))
    assert any({0, 1} <= set(g) for g in model.groups)
    soft = model.posterior(votes)
    assert ((soft > 0.5) == truth).mean() > 0.93
    ratio = {g[0]: t[1, 1] / t[1, 0] for g, t in zip(model.groups, model.tables) if len(g) == 1}
    assert 2 in ratio and 1 < ratio[2] < 5


def test_more_languages_than_any_list_of_them(spark):
    texts = [(f"l{i:03}", f"{chr(0x4E00 + 7 * i)}{chr(0x4E01 + 7 * i)} " * 5 + f"common w{k}") for i in range(510) for k in range(2)]
    df = spark.createDataFrame([*texts, (None, "nobody"), ("l000", None)], "lang string, text string")
    model = language.train(df, per_language=2, epochs=2)
    assert len(model.languages) == 510
    found = language.identify(df.filter("lang in ('l000', 'l255', 'l509')"), model)
    assert all(r.lang_pred == r.lang or r.text is None for r in found.collect())


def test_language_sample_takes_different_texts(spark):
    word = lambda i: "".join(chr(97 + int(d)) for d in str(100 + i))
    rows = [("aa", f"alpha beta {word(i)}") for i in range(40)] + [("aa", "copied text")] * 3000 + [("bb", f"gamma {word(i)}") for i in range(5)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    languages, langs, grams = language._sample(df, 30, 60)
    assert languages == ["aa", "bb"] and (langs.count(0), langs.count(1)) == (30, 5) and len(grams) == 35
    shapes = {(g[0].tobytes(), g[1].tobytes()) for g in grams}
    assert len(shapes) == 35  # no text twice
    again = language._sample(df.repartition(5), 30, 60)
    assert {(g[0].tobytes(), g[1].tobytes()) for g in again[2]} == shapes


def test_toxicity_sample_is_bounded_and_exact(spark, monkeypatch):
    rows = [(1, f"you idiot scum {i % 40}") for i in range(3000)] + [(i, f"a calm text number {i}") for i in range(2, 400)] + [(2, "you moron trash"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    known = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), *[(i, 0) for i in range(3, 400)], (9999, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    seen = []
    mine = toxicity.mine_voters
    monkeypatch.setattr(toxicity, "mine_voters", lambda features, toxic, *a, **k: (seen.append((int(toxic.sum()), int((~toxic).sum()))), mine(features, toxic, *a, **k))[1])
    toxicity.train(df, known, max_toxic=25, max_clean=100)
    toxicity.train(df, known)
    assert seen == [(25, 100), (42, 399)]  # 40 + 2 different toxic texts, copies once; 398 calm ones and the second text of id 2


def test_sample_of_hashes_is_the_smallest(spark):
    from kinweave.llm.sampling import drawn_at, smallest_hashes

    keys = spark.range(5000).selectExpr("CAST(id % 3 AS int) AS c", "xxhash64(id % 900) AS h")
    got = {(r.c, r.h) for r in smallest_hashes(keys, "c", {0: 300, 1: 300, 2: 300}, {0: 20, 1: 1, 2: 1000}).collect()}
    want = set()
    for c, n in ((0, 20), (1, 1), (2, 1000)):
        rows = keys.filter(f"c = {c}").select("c", "h", drawn_at(F.col("h")).alias("at")).distinct().orderBy("at").limit(n).collect()
        want |= {(r.c, r.h) for r in rows}
    assert got == want and len(want) == 321
