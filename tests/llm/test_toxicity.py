import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnwood.llm.toxicity import BITS, FOLDS, HELD_OUT, Model, features, fit, judge, locate, loss_and_gradient, numbered, op8_toxicity_mil, score, sentences, survivors


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 7 == 0
        sents = [" ".join(rng.choice(words) for _ in range(6)) for _ in range(rng.randint(1, 30))]
        if toxic:
            sents[rng.randrange(len(sents))] += " " + rng.choice(["vilestuff", "vileword", "rotten"])
        rows.append((i, ". ".join(sents)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy_and_sentences(planted, spark):
    docs, labels = planted
    model = fit(docs, labels)
    got = {r.doc_id: r.score for r in score(docs, model).collect()}
    held = {r.doc_id: r.toxic for r in labels.where(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT).collect()}
    assert sum((got[i] >= 0.7) == bool(t) for i, t in held.items()) >= 0.98 * len(held)
    assert all(0 <= x <= 1 for x in got.values())
    unseen = spark.createDataFrame([(1, "Fine here. But VILEword! is bad\nword1 word2")], "doc_id long, text string")
    (r,) = locate(unseen, model).collect()
    assert "Fine here. But VILEword! is bad"[r.start : r.end] == "But VILEword"
    assert (fit(docs, labels).weights == model.weights).all()


def test_a_form_never_labelled_is_located(planted, spark):
    """Word beginnings carry what was learned to a form that no labelled document has."""
    docs, labels = planted
    model = fit(docs, labels)
    text = "Fine here. But VILEstuffing! is bad\nword1 word2"
    (r,) = locate(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
    assert text[r.start : r.end] == "But VILEstuffing"


def test_a_bounded_sample_is_trained_on(planted):
    docs, labels = planted
    few = fit(docs, labels, train_chars=20_000)
    assert 0 < np.count_nonzero(few.weights) or few.bias == -9.0
    assert fit(docs, labels, train_chars=1).bias == -9.0 and fit(docs, labels, train_docs=0).bias == -9.0


def test_noisy_or_and_gradient_against_brute_force():
    rng = random.Random(2)
    words = ["ab", "abc", "abcdefghij", "x!", "..", "é", "two"]
    bags = [(i, rng.randrange(2), [sorted({rng.choice(words) for _ in range(rng.randint(1, 4))}) for _ in range(rng.randint(0 if i else 1, 5))]) for i in range(12)]
    data = numbered(pa.table({"id": [b[0] for b in bags], "y": pa.array([b[1] for b in bags], pa.int32()), "sentences": pa.array([b[2] for b in bags], pa.list_(pa.list_(pa.string())))}))
    w = np.zeros(1 << BITS)
    for f in {f for x in words for f in features(x)}:
        w[f] = rng.uniform(-2, 2)
    bias = -0.7

    def loss(w, bias):
        total = 0.0
        for _, y, some in bags:
            none = 1.0
            for s in some:
                none *= 1 - 1 / (1 + math.exp(-(bias + sum(w[f] for x in s for f in features(x)))))
            total -= math.log(max(1 - none, 1e-12) if y else none)
        return total

    got, by_weight, by_bias = loss_and_gradient(w, bias, data)
    assert got == pytest.approx(loss(w, bias), rel=1e-6)
    for f in {f for x in words for f in features(x)}:
        up, down = w.copy(), w.copy()
        up[f] += 1e-5
        down[f] -= 1e-5
        assert by_weight[f] == pytest.approx((loss(up, bias) - loss(down, bias)) / 2e-5, abs=1e-4)
    assert by_bias == pytest.approx((loss(w, bias + 1e-5) - loss(w, bias - 1e-5)) / 2e-5, abs=1e-4)
    model = Model(bias, w.astype(np.float32))
    text = "ab abc. abcdefghij x! Two\n.."
    none = 1.0
    for s in sentences(text):
        none *= 1 - 1 / (1 + math.exp(-(bias + sum(model.weights[f] for x in s for f in features(x)))))
    assert model.score(text) == pytest.approx(1 - none, rel=1e-5)


def test_odd_rows(docs):
    weights = np.zeros(1 << BITS, np.float32)
    weights[features("bad")[0]] = 9.0
    model = Model(-6.0, weights)
    df = docs(None, "", " \n.!", "so bad", "so bad", "fine " * 50000, "BAD!!")
    got = [r.score for r in sorted(score(df, model).collect(), key=lambda r: r.doc_id)]
    assert got[:3] == [0, 0, 0] and got[3] == got[4] > 0.9 and got[5] < 0.1 and got[6] > 0.9
    assert sorted(r.doc_id for r in survivors(df, model).collect()) == [0, 1, 2, 5]
    assert survivors(df, model).columns == df.columns
    assert [(r.doc_id, r.spans) for r in judge(df, model).where("spans <> ''").collect()] == [(3, "0:6"), (4, "0:6"), (6, "0:3")]
    assert judge(df, model).columns == ["doc_id", "score", "spans"]
    assert score(docs(), model).collect() == [] and survivors(docs(), model).collect() == []


def test_no_labels(docs, spark):
    model = fit(docs("a b"), spark.createDataFrame([(0, None), (None, 1)], "doc_id long, toxic int"))
    assert not model.weights.any()


def test_query_on_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    got = op8_toxicity_mil(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.93 * len(got)


def test_every_labelled_row_counts_and_blocks_give_the_same_model(planted, spark, monkeypatch):
    from tarnwood.llm import toxicity

    docs, labels = planted
    whole = fit(docs, labels)
    monkeypatch.setattr(toxicity, "BLOCK_CHARS", 20_000)
    monkeypatch.setattr(toxicity, "STEPS", 200)
    apart = fit(docs, labels, driver_chars=0)
    assert apart.bias == pytest.approx(whole.bias, abs=1e-3) and np.abs(apart.weights - whole.weights).max() < 1e-3
    assert (fit(docs, labels, driver_chars=0).weights == apart.weights).all()


def test_rows_beyond_any_former_bound_are_learned_from(spark):
    """The word of the rows whose ids' hash comes last is learned, however many rows come before."""
    rows = spark.range(24_000 * 3 // 2).select(F.col("id").alias("doc_id"), F.row_number().over(__import__("pyspark").sql.Window.orderBy(F.xxhash64("id"), "id")).alias("k"))
    rows = rows.select("doc_id", F.when(F.col("k") > 34_000, "common vileword").otherwise("common word").alias("text"), (F.col("k") > 34_000).cast("int").alias("toxic")).cache()
    model = fit(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"))
    assert model.score("common vileword") > 0.9 and model.score("common word") < 0.1


def test_beginnings_are_numbered_once_and_no_more_tasks_than_cores_answer_a_step(planted, spark, monkeypatch):
    from tarnwood.llm import toxicity

    words = [f"beginning{i}" for i in range(500)]
    data = numbered(pa.table({"id": [1], "y": pa.array([1], pa.int32()), "sentences": pa.array([[words]], pa.list_(pa.list_(pa.string())))}))
    assert max(map(len, data)) <= 500 + 6 + 1  # six beginnings stand for all words
    docs, labels = planted
    seen, added = [], toxicity._added

    def spied(*args):
        seen.append(args[-3].getNumPartitions())
        return added(*args)

    monkeypatch.setattr(toxicity, "_added", spied)
    monkeypatch.setattr(toxicity, "BLOCK_CHARS", 2_000)
    monkeypatch.setattr(toxicity, "descend", lambda gradient: Model(*[g for g in gradient(np.zeros(1 << BITS), -5.0)][::-1]))
    got = fit(docs.repartition(16), labels, driver_chars=0)
    assert seen and max(seen) <= spark.sparkContext.defaultParallelism and got.weights.any()
