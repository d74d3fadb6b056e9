"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: About so many labelled rows of each language are fitted: every row of the language when it has no more,
#: else those whose hash falls under the right share.  Counts (the IDF) cover all training rows.
PER_LANGUAGE = 800
BLOCK = 1 << 17  # letters taken at a time
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def grams(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of the text's character n-grams, block by block; nothing if it has no letter.

    Lower case; every run of other characters than letters is one space, and a space stands at both ends.
    Blocks overlap by the longest order less one, so no n-gram is lost or counted twice.
    """
    over = max(ORDERS) - 1
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    known = letters()[codes]
    if not known.any():
        return
    codes = np.concatenate([[32], np.where(known, codes, 32), [32]]).astype(np.uint32)
    space = codes == 32
    codes = codes[~(space & np.concatenate([[False], space[:-1]]))]
    for at in range(0, len(codes), BLOCK):
        part = codes[max(0, at - over) : at + BLOCK]
        new = at - max(0, at - over)
        run = np.zeros(len(part), dtype=np.uint32)
        for n in range(1, max(ORDERS) + 1):
            run = (run[:-1] if n > 1 else run) * np.uint32(0x9E3779B1) + part[n - 1 :] + np.uint32(n)
            if n in ORDERS:
                mixed = (run ^ (run >> np.uint32(15))) * np.uint32(0x85EBCA77)
                yield mixed[max(0, new - n + 1) :] >> np.uint32(16)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and the share of its n-grams that fall into each."""
    found = list(grams(text))
    if not found:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.float32)
    buckets, n = np.unique(np.concatenate(found), return_counts=True)
    return buckets.astype(np.int32), (n / n.sum()).astype(np.float32)


@dataclass
class Model:
    """``weights`` (buckets x languages) hold the IDF already; logits are their mean over a text's n-grams
    plus ``bias``, over ``temperature``."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        total, n = np.zeros(len(self.languages)), 0
        for part in grams(text or "") if self.languages else ():
            total += self.weights[part].sum(axis=0, dtype=np.float64)
            n += len(part)
        if not n:
            return UNKNOWN, 0.0
        logits = (total / n + self.bias) / self.temperature
        p = np.exp(logits - logits.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())


class Ftrl:
    """Follow the regularised leader with an elastic net, for a softmax over sparse rows."""

    def __init__(self, n: int, k: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.001):
        self.z, self.g2 = np.zeros((n, k)), np.zeros((n, k))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, g2 = self.z[at], self.g2[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(g2)) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        logits = x @ w
        p = np.exp(logits - logits.max())
        p /= p.sum()
        p[y] -= 1
        g = x[:, None] * p
        more = self.g2[at] + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(self.g2[at])) / self.alpha * w
        self.g2[at] = more


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray, epochs: int = 4) -> Model:
    """A model from ``(language, buckets, shares)`` rows; every fifth row is kept to set the temperature."""
    languages = sorted({r[0] for r in rows})
    if not languages:
        return Model([], np.zeros((len(idf), 0), dtype=np.float32), np.zeros(0), 1.0)
    place = {x: i for i, x in enumerate(languages)}
    scale = 10.0  # a text's features sum to about this
    made = [
        (np.append(b, len(idf)), np.append(scale * s * idf[b], 1.0), place[lang]) for lang, b, s in rows if len(b)
    ]
    kept = made[::5] if len(made) >= 50 else made
    learned = [m for i, m in enumerate(made) if i % 5] if len(made) >= 50 else made
    ftrl = Ftrl(len(idf) + 1, len(languages))
    order = np.random.default_rng(5)
    for _ in range(epochs):
        for i in order.permutation(len(learned)):
            ftrl.learn(*learned[i])
    w = ftrl.weights()
    logits = np.array([x @ w[at] for at, x, _ in kept]).reshape(-1, len(languages))
    right = np.array([y for *_, y in kept], dtype=np.int64)

    def loss(t: float) -> float:
        z = logits / t
        top = z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z - top).sum(axis=1)) + top[:, 0] - z[np.arange(len(z)), right]).mean())

    tried = np.geomspace(0.05, 20, 121)
    best = min(tried, key=loss) if len(kept) else 1.0
    return Model(languages, (scale * idf[:, None] * w[:-1]).astype(np.float32), w[-1].copy(), float(best))


def train(rows: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """A model from all rows with a language: document frequencies from every row, weights from about
    ``per_language`` rows of each language, chosen by a hash of id and text.  To the driver come one count per
    bucket and language, and the sample's n-gram counts."""
    rows = rows.where(F.col(lang).isNotNull()).select(
        F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(lang).cast("string").alias("lang")
    )

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, seen, n = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=bool), 0
        for batch in batches:
            for t in batch["text"]:
                for part in grams(t):
                    seen[part] = True
                df += seen
                seen[:] = False
                n += 1
        at = np.flatnonzero(df)
        yield pd.DataFrame({"bucket": np.append(at, -1), "df": np.append(df[at], n)})

    found = rows.select("text").mapInPandas(frequencies, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df"))
    df, n = np.zeros(BUCKETS), 0
    for bucket, count in found.toPandas().itertuples(index=False):
        if bucket < 0:
            n = count
        else:
            df[bucket] = count
    idf = np.log((1 + n) / (1 + df))

    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return fit([], idf)
    share = F.element_at(F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, per_language / v)]), F.col("lang"))
    drawn = F.pmod(F.xxhash64("id", "text", F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))

    @F.pandas_udf("struct<at: array<int>, share: array<float>>")
    def features(texts: pd.Series) -> pd.DataFrame:
        made = [counts(t) for t in texts]
        return pd.DataFrame({"at": [m[0] for m in made], "share": [m[1] for m in made]})

    sample = rows.where(drawn < share).withColumn("drawn", drawn).select("id", "lang", "drawn", features("text").alias("f"))
    got = sorted(sample.select("drawn", "id", "lang", "f.at", "f.share").collect(), key=lambda r: (r[0], str(r[1])))
    return fit([(r["lang"], np.asarray(r["at"], np.int32), np.asarray(r["share"])) for r in got], idf)


def predict(model: Model, text: Column, spark) -> Column:
    """``struct<lang_pred, score>`` for a text column; a null text or one without letters is ``und``, score 0."""
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def each(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([held.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    return each(text)


def identify(docs: DataFrame, training: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with a column ``language: struct<lang_pred, score>``, from a model of ``training``.

    Predictions use the text alone.  score is the calibrated probability of the language named.  Texts that
    are null, empty or without letters are ``und`` with score 0; so are all texts when no training row has a
    language.  Very long texts are read whole, block by block.  Repeated rows get equal results.
    """
    model = train(training, id, text, lang)
    return docs.withColumn("language", predict(model, F.col(text), docs.sparkSession))
