"""Toxicity by FTRL-proximal logistic regression, and op6_toxicity.

Features are hashed words, word pairs and triples, pairs with one or two words skipped, and
the beginnings of words (so that an inflected form is known by its stem), present or not. Shards of a bounded labelled sample are learned side by side, each with a
learning rate a coordinate and L1 sparsity; the shards' weights are averaged into a sparse
vector whose length the hash space bounds, and that is broadcast to score all texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewright.llm.common import Words, bounded_sample, chunks, free_name, map_text, table

GRAMS = ((0,), (0, 1), (0, 1, 2), (0, 2), (0, 3))
STEMS = (4, 5, 6)


@dataclass(frozen=True)
class FtrlParams:
    """``sample_rows`` bounds the labelled rows that are learned from, dealt to one shard for
    each ``shard_rows``; ``bits`` bounds the weights. A weight that less than a quarter of
    the shards have learned is dropped."""

    sample_rows: int = 40_000
    shard_rows: int = 5_000
    epochs: int = 2
    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 1.0
    threshold: float = 0.3


def features(items: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) for every gram of the texts, repeats included."""
    words = Words(items)
    made = [words.grams(*gaps) for gaps in GRAMS] + [words.stems(size) for size in STEMS]
    docs = np.concatenate([d for d, _ in made])
    return docs, (np.concatenate([h for _, h in made]) >> np.uint64(64 - bits)).astype(np.int64)


def present(items: list[bytes], bits: int) -> list[np.ndarray]:
    """The distinct features of each text."""
    out: list[np.ndarray] = []
    for start, end in chunks(items):
        docs, values = features(items[start:end], bits)
        keys = np.unique(docs.astype(np.int64) << bits | values)
        out += np.split(keys & ((1 << bits) - 1), np.searchsorted(keys >> bits, np.arange(1, end - start)))
    return out


class Ftrl:
    """FTRL-proximal; the last coordinate is the bias, which L1 leaves alone."""

    def __init__(self, params: FtrlParams):
        self.p = params
        self.z, self.n = np.zeros((1 << params.bits) + 1), np.zeros((1 << params.bits) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        p, z, n = self.p, self.z[at], self.n[at]
        l1 = np.full(len(z), p.l1)
        l1[-1] = 0.0
        w = -(z - np.sign(z) * l1) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.p.alpha * w
        self.n[at] = n + g * g


def fit(labelled: DataFrame, n_rows: int, params: FtrlParams = FtrlParams()) -> list[tuple[int, float]]:
    """Sparse weights from about ``n_rows`` rows (text, label 0/1, order long).
    Rows without a label are passed over. Without rows of both classes there is nothing to
    tell apart: no weights, so a score of 0.5 for every text. The last coordinate, 2**bits,
    is the bias."""
    shards = -(-n_rows // params.shard_rows) or 1
    rows = labelled.filter(F.col("label").isin(0, 1)).select(
        F.pmod(F.xxhash64("order"), F.lit(shards)).alias("shard"),
        "order",
        F.col("label").cast("int").alias("label"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("bytes"),
    )

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "label", "bytes"])
        found = present([bytes(x) for x in pdf["bytes"]], params.bits)
        labels = pdf["label"].tolist()
        model = Ftrl(params)
        for epoch in range(params.epochs):
            for i in np.random.default_rng(epoch).permutation(len(labels)):
                model.learn(found[i], labels[i])
        w = model.weights(slice(None))
        at = np.flatnonzero(w)
        seen = np.unique(labels)  # -1 and -2 tell of rows of class 0 and 1
        return pd.DataFrame({"at": np.concatenate([at, -1 - seen]), "w": np.concatenate([w[at], np.ones(len(seen))])})

    learned = rows.groupBy("shard").applyInPandas(learn, "at long, w double")
    # one row a coordinate of the hash space at most
    mean = learned.groupBy("at").agg(F.sum("w").alias("w"), F.count("*").alias("shards"))
    rows = [(r["at"], r["w"], r["shards"]) for r in mean.collect()]
    got = [r for r in rows if r[0] >= 0]
    if len(rows) - len(got) < 2:
        return []
    most = max((n for _, _, n in got), default=1)
    return sorted((at, w / most) for at, w, n in got if n > most / 4)


def score(
    docs: DataFrame, weights: list[tuple[int, float]], params: FtrlParams = FtrlParams(), text: str = "text",
    name: str = "score", keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` with a column ``name``, double from 0 to 1: likelier toxic if higher. A text
    without words (null, empty) has the score of the bias alone. Every occurrence of a
    feature in the whole text is seen, and counts once."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    bits = params.bits

    def make():
        dense = np.zeros((1 << bits) + 1)
        for at, w in shared.value:
            dense[at] = w
        used = dense[:-1] != 0

        def work(items):
            out = np.full(len(items), dense[-1])
            for start, end in chunks(items):
                docs, values = features(items[start:end], bits)
                hit = used[values]
                keys = np.unique(docs[hit].astype(np.int64) << bits | values[hit])
                np.add.at(out, start + (keys >> bits), dense[keys & ((1 << bits) - 1)])
            return [(1.0 / (1.0 + np.exp(-np.clip(out, -35, 35)))).tolist()]

        return work

    return map_text(docs, make, [T.StructField(name, T.DoubleType())], text, keep)


def labelled_ids(labels: DataFrame, bound: int) -> DataFrame:
    """(order, label) of at most ``bound`` ids, those held out left out: crc32 of the id,
    modulo 4, is 2. An id with several labels takes the largest; null labels don't count."""
    known = labels.filter(
        F.col("toxic").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2)
    )
    return bounded_sample(known.groupBy(F.col("doc_id").alias("order")).agg(F.max("toxic").alias("label")), bound, "order")


def train(docs: DataFrame, labels: DataFrame, params: FtrlParams = FtrlParams()) -> list[tuple[int, float]]:
    """Weights from the documents of the sampled labels; the sample bounds the broadcast."""
    chosen = labelled_ids(labels, params.sample_rows)
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("order"))
    return fit(labelled.select("text", "label", "order"), chosen.count(), params)


def toxic(name: str, weights: list[tuple[int, float]], threshold: float, params: FtrlParams = FtrlParams()) -> Column:
    """Whether the score in column ``name`` tells of toxicity: ``threshold`` or more, and
    more than the bias alone gives, so that a text of which nothing is known never does."""
    bias = dict(weights).get(1 << params.bits, 0.0)
    alone = float(1.0 / (1.0 + np.exp(-np.clip(bias, -35, 35))))
    return (F.col(name) >= threshold) & (F.col(name) > alone + 1e-9)


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, params: FtrlParams = FtrlParams()) -> DataFrame:
    """``docs``, all columns, without the rows whose score is ``threshold`` or more and
    above that of a text without known features. All rows stay where nothing was learned:
    labels that are empty, null, held out, of one class or of no id of ``docs``, or so few
    that no feature has a weight."""
    name = free_name(docs, "toxic_score")
    weights = train(docs, labels, params)
    scored = score(docs, weights, params, name=name)
    return scored.filter(~toxic(name, weights, threshold, params)).select(*docs.columns)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = FtrlParams()
    docs = table(spark, sf_dir, "documents")
    weights = train(docs, table(spark, sf_dir, "labels"), params)
    return score(docs, weights, params, keep=["doc_id"]).select(
        "doc_id",
        (F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)), F.lit(-1)) == 2).alias("held_out"),
        "score",
        (F.col("score") >= params.threshold).cast("int").alias("predicted"),
    )


QUERIES = {"op6_toxicity": op6_toxicity}
SQL: dict[str, str] = {}
