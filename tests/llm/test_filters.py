"""The classifiers beside direct computations, and the filtering stages of the pipeline on odd rows."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from causeway.llm import quality, toxicity
from causeway.llm.common import held_out, table
from causeway.llm.features import statistics

SF = "/root/testdata/sf0.01"


def features_by_hand(text):
    out = Counter()
    for w in "".join(c.lower() if c.isascii() else c for c in text or "").split():
        w = w.strip(toxicity.AROUND)
        if w:
            out[xxhash.xxh3_64_intdigest(w) % toxicity.BUCKETS] += 1
            for n in toxicity.PREFIXES:
                if len(w) >= n:
                    out[xxhash.xxh3_64_intdigest(w[:n], seed=n) % toxicity.BUCKETS] += 1
    return out


def test_chosen_features_are_the_most_telling(spark):
    """Counted in Spark as by hand over the same documents."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    learned = docs.where(~held_out("doc_id", 4))
    texts = {r.doc_id: r.text for r in learned.collect()}
    toxic = {r.doc_id for r in labels.where("toxic = 1").where(~held_out("doc_id", 4)).collect()} & set(texts)
    in_p, in_u = Counter(), Counter()
    for i, t in texts.items():
        own = set(features_by_hand(t))
        in_u.update(own)
        if i in toxic:
            in_p.update(own)
    n_p, n_u, told = len(toxic), len(texts), []
    for f, k in in_p.items():
        if k >= toxicity.LEAST_DOCUMENTS:
            p, u = (k + 0.5) / (n_p + 1), (in_u[f] + 0.5) / (n_u + 1)
            z = np.log(p / (1 - p)) - np.log(u / (1 - u))
            z /= np.sqrt(1 / (k + 0.5) + 1 / (n_p - k + 0.5) + 1 / (in_u[f] + 0.5) + 1 / (n_u - in_u[f] + 0.5))
            if z >= toxicity.LEAST_CONTRAST:
                told.append((-z, f))
    model = toxicity.fit(docs, labels, 4)
    assert 0 < len(told) and sorted(f for _, f in sorted(told)[: toxicity.FEATURES]) == model.buckets.tolist()
    # A score is the logistic of the weighted counts and shares.
    text = max((t for i, t in texts.items() if i in toxic), key=len)
    counts, n = features_by_hand(text), len(text.split())
    logit, k = model.bias, len(model.buckets)
    for j, f in enumerate(model.buckets.tolist()):
        logit += np.log1p(counts[f]) * model.weights[j] + np.log1p(200 * counts[f] / n) * model.weights[k + j]
    assert model.scores(pa.array([text]))[0] == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-12)


def test_the_sample_is_bounded_in_rows(spark, monkeypatch):
    """One id on very many rows counts once, with the smallest of its texts."""
    rows = [(0, f"text {k}") for k in range(3000)] + [(i, f"awful words {i}") for i in range(1, 40)] + [(i, "fine words") for i in range(40, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(400)], "doc_id long, toxic int")
    seen = []
    train = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda p, u, *a, **k: seen.append((len(p), len(u))) or train(p, u, *a, **k))
    model = toxicity.fit(docs, labels, 4)
    learned = [r[0] for r in docs.select("doc_id").distinct().where(~held_out("doc_id", 4)).collect()]
    assert seen == [(sum(i < 40 for i in learned), len(learned))]
    assert len(model.buckets)


def test_discriminant_is_the_direct_density(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = docs.join(labels, "doc_id").where(~held_out("doc_id", 4)).where("quality in (0, 1)").select("text", "quality").collect()
    x, y = statistics(pa.array([r.text for r in rows])), np.array([r.quality for r in rows])
    pooled = sum(np.cov(x[y == c].T, bias=True) * (y == c).sum() for c in (0, 1)) / len(y)
    target = 0.95 * pooled + 0.05 * (np.diag(np.diag(pooled)) + 1e-6 * np.eye(len(pooled)))
    logs = []
    texts = docs.orderBy("doc_id").select("text").limit(200).toPandas().text
    z = statistics(pa.array(texts, pa.string()))
    for c in (0, 1):
        own = x[y == c]
        lean = max(0.1, len(pooled) / (len(pooled) + len(own)))
        cov = (1 - lean) * np.cov(own.T, bias=True) + lean * target
        d = z - own.mean(axis=0)
        logs.append(np.log(len(own) / len(y)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * (d @ np.linalg.inv(cov) * d).sum(axis=1))
    model = quality.learn(docs, labels, 4)
    assert np.allclose(model.scores(z), 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700))), atol=1e-7)


@pytest.mark.parametrize("stage, label", [("drop_toxic", "toxic"), ("drop_low_quality", "quality")])
def test_filters_judge_every_row_by_its_own_text(spark, stage, label):
    import corpus_pipeline

    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    classify, bad = (toxicity.classify, 1) if label == "toxic" else (quality.classify, 0)
    scored = classify(docs, labels)
    judged = {r.doc_id: r.predicted for r in scored.collect()}
    kept = getattr(corpus_pipeline, stage)(spark, docs, SF)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, p in judged.items() if p != bad}
    # The same texts under one id, and without any: each row for itself, extra columns as they are.
    shared = docs.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, 7)).withColumn("_kept", F.lit("clash")).withColumn("extra", F.map_from_arrays(F.array("lang"), F.array("n_chars")))
    model = toxicity.fit(docs, labels, 4) if label == "toxic" else quality.learn(docs, labels, 4)
    wanted = (lambda t: model.scores(t) < 0.3) if label == "toxic" else (lambda t: model.scores(statistics(t)) >= 0.7)
    from causeway.llm.common import kept_rows
    got = kept_rows(shared, wanted)
    assert got.columns == shared.columns and got.count() == sum(p != bad for p in judged.values())
    assert kept_rows(shared.where("false"), wanted).count() == 0


def test_cut_repeats_with_clashing_columns(spark):
    import corpus_pipeline

    passage = " ".join(f"w{i}" for i in range(20))
    rows = [(1, passage), (2, f"x {passage} y"), (2, f"x {passage} y"), (3, passage), (None, passage), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, len(t or ""), "c", "c", "c", "c") for i, t in rows], "doc_id long, text string, n_chars long, _kept string, _whole string, key string, row string")
    got = corpus_pipeline.cut_repeats(spark, docs, SF)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text, r.n_chars) for r in got.collect()) == Counter(
        [(1, passage, len(passage)), (2, "x y", 3), (2, "x y", 3), (None, passage, len(passage)), (4, None, 0), (5, "", 0)])
    assert corpus_pipeline.cut_repeats(spark, docs.where("false"), SF).collect() == []
