"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofact.llm.chunks import groups

#: Letters stay, A-Z in lower case; other ASCII characters part words.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 or 48 <= b <= 57 else 32 for b in range(256))


#: Characters of the texts whose features are held at once.
CHARS = 1_000_000


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the labelled rows that the model is fitted on, half of each label; everything is scored."""

    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 1.0
    epochs: int = 6
    sample: int = 10_000


@dataclass(frozen=True)
class Model:
    """Weights that L1 left, by feature, and the intercept; small enough to go to every task."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits)
        out[self.features] = self.weights
        return out


def features(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words, pairs of neighbours and pairs with one word between, of all texts: (text number, feature)."""
    plain = pa.array([t.encode().translate(WORDS) for t in texts], pa.large_binary()).view(pa.large_string())
    parts = pc.ascii_split_whitespace(plain)
    coded = parts.values.dictionary_encode()
    h = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_numpy(zero_copy_only=False)], dtype=np.uint64)[coded.indices.to_numpy()]
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(parts.offsets.to_numpy()))
    docs, hashed = [doc], [h]
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        same = doc[:-gap] == doc[gap:]
        docs.append(doc[:-gap][same])
        hashed.append(((h[:-gap] ^ np.uint64(salt)) * np.uint64(0xFF51AFD7ED558CCD) + h[gap:])[same] * np.uint64(0xD6E8FEB86659FD93))
    return np.concatenate(docs), (np.concatenate(hashed) >> np.uint64(64 - bits)).astype(np.int64)


def fit_ftrl(rows: list[np.ndarray], labels: np.ndarray, s: Settings, seed: int = 7) -> Model:
    """FTRL-proximal over rows of distinct features: each coordinate has its own learning rate, and L1 keeps it at zero
    until its gradients add up to more than the penalty."""
    n, z = np.zeros((1 << s.bits) + 1), np.zeros((1 << s.bits) + 1)
    bias = 1 << s.bits
    l1 = np.full((1 << s.bits) + 1, s.l1)
    l1[bias] = 0.0

    def weights(x: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[x]) <= l1[x], 0.0, -(z[x] - np.sign(z[x]) * l1[x]) / ((s.beta + np.sqrt(n[x])) / s.alpha + s.l2))

    order = np.random.default_rng(seed)
    for _ in range(s.epochs):
        for i in order.permutation(len(rows)):
            x = np.append(rows[i], bias)
            w = weights(x)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[i]
            z[x] += g - (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / s.alpha * w
            n[x] += g * g
    w = weights(np.arange(bias + 1))
    kept = np.flatnonzero(w[:bias])
    return Model(kept, w[kept], float(w[bias]), s.bits)


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """docs(doc_id, text), labels(doc_id, label 0 or 1) -> a model of P(label = 1).

    At most s.sample labelled rows are fitted on, chosen by hash of the id, half of each label; the intercept is then
    set back to the labels' shares among all labelled rows. Ids with contradicting labels count as label 1. The sample
    is bounded, so its ids are broadcast and one task fits; only weights come to the driver. Null labels and ids are
    left out. Without rows of both labels the score is the share of label 1 (a half if there are no labels).
    """
    spark = docs.sparkSession
    marked = labels.where("doc_id is not null and label in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("label").cast("int").alias("label"))
    shares = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(shares) < 2:
        p = 0.5 if not shares else 0.99 if 1 in shares else 0.01
        return Model(np.array([], dtype=np.int64), np.array([]), float(np.log(p / (1 - p))), s.bits)
    halves = [marked.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample // 2) for k in (0, 1)]
    sample = F.broadcast(halves[0].union(halves[1]))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sample, "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label").distinct()
    rows = texts.mapInArrow(lambda it: _rows(it, s.bits), "doc_id long, label int, x array<int>")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "label"])
        m = fit_ftrl(list(pdf["x"]), pdf["label"].to_numpy(), s)
        return pd.DataFrame({"feature": [-1, *m.features], "weight": [m.bias, *m.weights]})

    got = rows.groupBy(F.lit(0).alias("g")).applyInPandas(fit, "feature long, weight double").toPandas()
    if got.empty:
        return Model(np.array([], dtype=np.int64), np.array([]), float(np.log(shares[1] / shares[0])), s.bits)
    seen = {k: min(v, s.sample // 2) for k, v in shares.items()}
    bias = got.loc[got["feature"] < 0, "weight"].sum() + np.log(shares[1] / shares[0]) - np.log(seen[1] / seen[0])
    got = got[got["feature"] >= 0]
    return Model(got["feature"].to_numpy(), got["weight"].to_numpy(), float(bias), s.bits)


def _rows(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, label) -> doc_id, label and the text's distinct features, a sorted list of 2^bits at most."""
    for b in batches:
        at = 0
        for ids, texts in groups(iter([b.select(["doc_id", "text"])]), CHARS):
            doc, x = features(texts, bits)
            key = np.unique(doc.astype(np.int64) << bits | x)
            cut = np.searchsorted(key, np.arange(1, len(texts)) << bits)
            out = [k & (1 << bits) - 1 for k in np.split(key, cut)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), b.column(2).slice(at, len(ids)), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "label", "x"])
            at += len(ids)


def score_texts(texts: list[str], weights: np.ndarray, m: Model) -> np.ndarray:
    """P(label = 1) of each text; a feature counts once in a text."""
    doc, x = features(texts, m.bits)
    hit = np.flatnonzero(weights[x])
    key = np.unique(doc[hit].astype(np.int64) << m.bits | x[hit])
    total = m.bias + np.bincount(key >> m.bits, weights=weights[key & (1 << m.bits) - 1], minlength=len(texts))
    return 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))


def scored(m: Model) -> Column:
    """A column expression that scores the column text; null and empty texts get the intercept's score."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights = m.dense()
        for b in batches:
            # Texts stay in Arrow's memory until their turn comes.
            rows = pa.RecordBatch.from_arrays([pa.nulls(len(b), pa.int64()), b], names=["doc_id", "text"])
            for _, texts in groups(iter([rows]), CHARS):
                yield pa.array(score_texts(texts, weights, m), pa.float64())

    return score(F.col("text"))


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.3, s: Settings = Settings()) -> DataFrame:
    """docs(doc_id, text), labels(doc_id, toxic) -> doc_id, held_out, score, predicted for every row of docs.

    Labels of rows for which ``held_out`` (an expression on doc_id) holds are never read. Null and empty texts, null and
    repeated ids are scored as rows of their own; the score is a function of the text alone. An empty table gives no rows.
    """
    given = labels.where(~held_out).select("doc_id", F.col("toxic").alias("label"))
    m = train(docs, given, s)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), scored(m).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
