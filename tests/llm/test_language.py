import math
from collections import Counter

import numpy as np
import pyspark.sql.functions as F

from cartulary.llm import language as L

from .odd import odd


def test_grams_of_blocks_are_those_of_the_whole(monkeypatch):
    text = "Él niño, 12 ßetter!! " * 40
    whole = Counter(np.concatenate(list(L.grams(text))).tolist())
    monkeypatch.setattr(L, "BLOCK", 7)
    assert Counter(np.concatenate(list(L.grams(text))).tolist()) == whole
    assert sum(whole.values()) == sum(len(plain(text)) - n + 1 for n in L.ORDERS)
    assert len(set(whole)) <= len({plain(text)[i : i + n] for n in L.ORDERS for i in range(len(plain(text)))})


def plain(text):
    return " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "


def test_ftrl_learns_a_sparse_softmax():
    draw = np.random.default_rng(1)
    ftrl = L.Ftrl(40, 3, l1=3.0)
    for _ in range(3000):
        y = int(draw.integers(3))
        ftrl.learn(np.array([y, 3 + int(draw.integers(37))]), np.ones(2), y)
    w = ftrl.weights()
    assert all(w[y].argmax() == y for y in range(3)) and (w[3:] == 0).mean() > 0.3


def test_held_out_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("held", F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    found = L.identify(docs, docs.where("not held")).where("held").select("lang", "language.*", "n_chars").toPandas()
    long = found[found["n_chars"] > 100]
    assert len(long) > 20 and (long["lang"] == long["lang_pred"]).mean() > 0.97
    assert found["score"].between(0, 1).all()


def test_temperature_makes_scores_honest():
    draw = np.random.default_rng(2)
    rows = []
    for _ in range(4000):
        y = int(draw.integers(2))
        seen = y if draw.random() < 0.8 else 1 - y  # the feature is right four times in five
        rows.append(("ab"[y], np.array([seen], dtype=np.int32), np.array([1.0], dtype=np.float32)))
    model = L.fit(rows, np.ones(4))
    logits = (model.weights[0] + model.bias) / model.temperature
    assert abs(1 / (1 + math.exp(logits[1] - logits[0])) - 0.8) < 0.06


def test_odd_rows(spark):
    docs = odd(spark)
    rows = L.identify(docs, docs).select("text", "language.*").collect()
    assert len(rows) == docs.count()
    for r in rows:
        known = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not known) and 0 <= r["score"] <= 1
    assert L.identify(odd(spark, []), odd(spark, [])).count() == 0
    assert {r[0] for r in L.identify(docs, odd(spark, [])).select("language.lang_pred").collect()} == {"und"}
