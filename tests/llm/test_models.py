"""The two classifiers: held-out accuracy, and gradients against differences."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docgrid.llm import averaging, quality, toxicity
from docgrid.llm.common import held_out, labelled_sample


@pytest.fixture(scope="module")
def larger(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def large(spark):
    """Ten thousand documents and their labels."""
    return [spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels")]


def rates(scored, labels, label, threshold):
    """(share of label 1 at or over the threshold, share of label 0) of held-out documents."""
    rows = scored.join(labels, "doc_id").where(held_out(F.col("doc_id"))).select("score", F.col(label).alias("y")).collect()
    return [np.mean([r.score >= threshold for r in rows if r.y == y]) for y in (1, 0)]


def test_quality_on_held_out_documents(large):
    """Good ones are kept, poor ones are not; keeping all would give 1 and 1."""
    kept, passed = rates(quality.score_quality(large[0].join(large[1], "doc_id", "left_semi"), quality.fit_quality(*large)), large[1], "quality", quality.THRESHOLD)
    print("quality: kept", kept, "passed", passed)
    assert kept > 0.97 and passed < 0.15


def test_toxicity_on_held_out_documents(large):
    """Toxic ones are found with few false alarms; calling all clean would give 0 and 0."""
    found, alarms = rates(toxicity.score_toxicity(large[0].join(large[1], "doc_id", "left_semi"), toxicity.fit_toxicity(*large)), large[1], "toxic", 0.5)
    print("toxicity: found", found, "alarms", alarms)
    assert found > 0.75 and alarms < 0.02


def bags(n, seed=0):
    rng = np.random.default_rng(seed)
    plain = [f"{a} {b} {c}." for a, b, c in rng.choice(["the", "house", "river", "green", "walks", "over"], (400, 3))]
    return [(k, " ".join(rng.choice(plain, 4)) + (" You are a vile gnarp." if k % 3 == 0 else ""), int(k % 3 == 0)) for k in range(n)]


def test_sentences_are_located(spark):
    rows = spark.createDataFrame(bags(300), "doc_id long, text string, toxic int")
    model = toxicity.fit_toxicity(rows.drop("toxic"), rows.drop("text"))
    text = "The green river walks. Such a gnarp it is! Over the house."
    assert [text[a:b] for a, b, _ in model.offending(text)] == ["Such a gnarp it is"]
    grown = "\u0130\u0130\u0130 start. " + text
    assert [grown[a:b] for a, b, _ in model.offending(grown)] == ["Such a gnarp it is"]
    assert model.score(text) > 0.5 > model.score("The green river walks. Over the house.")
    assert model.score("") == 0.0


def test_all_of_a_long_text_is_learnt_from(spark):
    """The one offending sentence of each toxic text lies anywhere in thousands of clean ones; likewise a bad stretch."""
    rng, rows = np.random.default_rng(3), []
    for k in range(60):
        clean = ["the river walks over the green house."] * 4000
        clean[int(rng.integers(0, 4000))] += " you are a vile gnarp."
        rows.append((k, " ".join(clean if k % 2 else clean[:1]), k % 2, 1))
    table = spark.createDataFrame([(i, t, y) for i, t, y, _ in rows], "doc_id long, text string, toxic int")
    model = toxicity.fit_toxicity(table, table)
    assert model.score("what a gnarp.") > model.score("the river walks.")
    packed = toxicity._packed(labelled_sample(table, table, "toxic", 60), toxicity.chosen_grams(labelled_sample(table, table, "toxic", 60), {0: 20, 1: 20}, 50))
    texts = {r[0]: r[1] for r in rows}
    assert sorted(len(r.sizes) // 4 for r in packed.collect()) == sorted(len(toxicity._sentences(texts[i])) for i in (r.doc_id for r in labelled_sample(table, table, "toxic", 60).collect()))


def test_labels_are_mixed_within_a_shard(spark):
    """Also where one label is rare, so that its rows reach further in the order that the sample is chosen by."""
    rows = spark.createDataFrame([(k, t, int(k % 20 != 0)) for k, t, _ in bags(4000) if k % 3 or k % 20 == 0], "doc_id long, text string, quality int")
    rows = rows.withColumn("text", F.when(F.col("quality") == 0, F.regexp_replace("text", "river|house", "zzqx")).otherwise(F.col("text")))
    net = quality.fit_quality(rows, rows, rows=160)
    scores = {y: [r.score for r in quality.score_quality(rows.where(f"quality = {y}").limit(60), net).collect()] for y in (0, 1)}
    assert np.mean(np.array(scores[1]) >= quality.THRESHOLD) > 0.95 and np.mean(np.array(scores[0]) >= quality.THRESHOLD) < 0.3
    runs = [[r.label for r in part] for part in averaging.dealt(labelled_sample(rows, rows, "quality", 160)).select("label").rdd.glom().collect()]
    assert all(len(set(x[: len(x) // 2])) == len(set(x[len(x) // 2 :])) == 2 for x in runs if len(x) >= 12)


def test_a_fit_is_the_same_whatever_the_layout(spark):
    rows = spark.createDataFrame(bags(200) + [(3, "another text of a repeated id", 0)], "doc_id long, text string, toxic int").withColumn("quality", F.col("toxic"))
    nets = [quality.fit_quality(t, rows, rounds=1).parameters for t in (rows, rows.repartition(7))]
    assert all(np.array_equal(nets[0][k], nets[1][k]) for k in nets[0])
    models = [toxicity.fit_toxicity(t, rows) for t in (rows, rows.repartition(7))]
    assert models[0].weights == models[1].weights and models[0].bias == models[1].bias


def test_labels_of_held_out_documents_are_never_read(larger, labels):
    sample = labelled_sample(larger, labels, "toxic", 200)
    assert sample.where(held_out(F.col("doc_id"))).count() == 0
    assert sample.count() <= 200


def test_rows_come_back_as_they_are(nasty, empty, larger, labels):
    net, model = quality.Network(quality.initial()), toxicity.Model({"<x>": 9.0}, -5.0)
    ids = sorted(str(r.doc_id) for r in nasty.collect())
    for scored in (quality.score_quality(nasty, net), toxicity.score_toxicity(nasty, model)):
        rows = scored.collect()
        assert sorted(str(r.doc_id) for r in rows) == ids and all(0 <= r.score <= 1 for r in rows)
    assert quality.score_quality(empty, net).count() == toxicity.score_toxicity(empty, model).count() == 0
    kept = quality.keep_quality(nasty, net, 0.0)
    assert kept.columns == nasty.columns and kept.count() == nasty.count()
    assert quality.keep_quality(nasty, net, 1.1).count() == quality.keep_quality(empty, net).count() == 0


def test_missing_labels(nasty, empty, labels, spark):
    none = labels.limit(0)
    one = spark.createDataFrame([(4, 1, 1), (None, 0, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    for table in (none, one):
        scores = [r.score for r in quality.score_quality(nasty, quality.fit_quality(nasty, table)).collect()]
        assert len(set(scores)) == 1
        assert toxicity.score_toxicity(nasty, toxicity.fit_toxicity(nasty, table)).count() == nasty.count()
    assert quality.score_quality(empty, quality.fit_quality(empty, none)).count() == 0


def test_chunks_cover_the_whole_text():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        data = bytes(k % 251 for k in range(n))  # zero bytes are bytes like others
        parts = quality.chunks(data)
        step = quality.CHUNK - quality.OVERLAP
        joined = [s for p in parts[:-1] for s in p[:step]] + [*parts[-1]]
        assert bytes(s for s in joined if s != quality.END) == data and set(joined[n:]) <= {quality.END}


def test_filters_by_pairs_are_the_filters():
    p = quality.initial(seed=2)
    data = np.random.default_rng(4).integers(0, quality.SYMBOLS, (3, quality.CHUNK)).astype(np.uint16)
    found = quality.Network(p).pooled(data)
    for f in range(quality.FILTERS):
        step = int(quality.DISTANCES[f])
        places = quality.CHUNK - (quality.WIDTH - 1) * step
        direct = sum(p["conv"][k, data[:, k * step : k * step + places], f] for k in range(quality.WIDTH)).max(axis=1)
        assert np.allclose(found[:, f], np.maximum(direct, 0), atol=1e-5)


def test_gradients_match_differences():
    rng = np.random.default_rng(5)
    p = {k: v.astype(float) for k, v in quality.initial(seed=3).items()}
    data = rng.integers(0, quality.SYMBOLS, (4, quality.CHUNK)).astype(np.uint16)
    starts, y, w = np.array([0, 3]), np.array([1.0, 0.0]), np.array([1.0, 2.0])

    def loss():
        found = quality.Network(p).combined(quality.Network(p).pooled(data), starts)
        return -(w * (y * np.log(found) + (1 - y) * np.log(1 - found))).mean()

    grads = quality.gradients(p, data, starts, y, w)
    for name in ("hidden", "out", "conv_bias"):
        value = p[name]
        for at in [tuple(rng.integers(0, s) for s in value.shape) for _ in range(4)]:
            old = value[at]
            value[at] = old + 1e-2
            up = loss()
            value[at] = old - 1e-2
            down = loss()
            value[at] = old
            assert abs((up - down) / 2e-2 - grads[name][at]) < 2e-3


def test_toxicity_gradients_match_differences():
    rng = np.random.default_rng(6)
    sizes = [np.array([2, 0, 3]), np.array([1]), np.zeros(0, int)]
    columns, y, w = [rng.integers(0, 4, s.sum()) for s in sizes], np.array([1, 0, 0]), np.array([0.7, 1.0, 2.0])
    now = {"weights": rng.standard_normal(4), "bias": np.array(-1.0)}

    def loss():
        model = [toxicity.noisy_or(np.array([now["weights"][c[a : a + n]].sum() for a, n in zip(np.cumsum([0, *s[:-1]]), s, strict=True)]) + now["bias"]) if len(s) else 0.0 for c, s in zip(columns, sizes, strict=True)]
        return np.mean([-v * np.log(p if t else 1 - p) for v, p, t in zip(w, model, y, strict=True)])

    grads = toxicity.gradients(now, columns, sizes, y, w)
    for k in range(4):
        up, down = ({"weights": now["weights"] + d * (np.arange(4) == k), "bias": now["bias"]} for d in (1e-5, -1e-5))
        old = now
        now = up
        high = loss()
        now = down
        low = loss()
        now = old
        assert abs((high - low) / 2e-5 - grads["weights"][k]) < 1e-4


def test_quality_scores_are_those_of_plain_loops():
    """Documents scored again symbol by symbol from the parameters."""
    import math

    p = quality.initial(0.4, seed=11)
    texts = ["", "short one", "A text, of more words. " * 40, "\u00e9\u4e16 beyond ascii " * 25]

    def plain(text):
        data, step, features = list(text.encode()), quality.CHUNK - quality.OVERLAP, []
        for k in range(max(1, -(-(len(data) - quality.OVERLAP) // step))):
            part = (data[k * step : k * step + quality.CHUNK] + [quality.END] * quality.CHUNK)[: quality.CHUNK]
            pooled = []
            for f in range(quality.FILTERS):
                apart = quality.STRIDE if f < quality.FAR else 1
                answers = [sum(float(p["conv"][w, part[at + w * apart], f]) for w in range(quality.WIDTH)) for at in range(quality.CHUNK - (quality.WIDTH - 1) * apart)]
                pooled.append(max(0.0, max(answers) + float(p["conv_bias"][f])))
            features.append([math.tanh(sum(x * float(p["hidden"][f, h]) for f, x in enumerate(pooled)) + float(p["hidden_bias"][h])) for h in range(quality.HIDDEN)])
        both = [sum(c) / len(c) for c in zip(*features, strict=True)] + [max(c) for c in zip(*features, strict=True)]
        return 1 / (1 + math.exp(-sum(x * float(w) for x, w in zip(both, p["out"], strict=True)) - float(p["out_bias"])))

    import pyarrow as pa

    assert quality.Network(p).scores(pa.array(texts)) == pytest.approx([plain(x) for x in texts], abs=1e-5)


def test_toxicity_scores_are_those_of_plain_loops():
    """Documents scored again sentence by sentence and gram by gram."""
    import math
    import re

    weights = {"<bad>": 3.0, "badl": 0.5, "adly>": -0.25, "<good>": -2.0, "orde": 1.5}
    model = toxicity.Model(weights, -2.5)

    def plain(text):
        clean = 1.0
        for sentence in re.split(r"[.!?\n]", text):
            found = set(re.findall(r"\w+", sentence.lower()))
            if found:
                odds = -2.5
                for word in found:
                    marked = f"<{word}>"
                    for gram in {marked} | {marked[i : i + n] for n in (4, 5) for i in range(len(marked) - n + 1)}:
                        odds += weights.get(gram, 0.0)
                clean *= 1 - 1 / (1 + math.exp(-odds))
        return 1 - clean

    for text in ("", "Good.", "bad bad BAD! good? badly ordered\nborder.", "a. b. c.", "Bad badly. " * 30):
        assert model.score(text) == pytest.approx(plain(text), abs=1e-9)
