"""Quality by importance resampling, and op1_importance_resample.

Hashed n-grams give two generative models: one of target text (labelled good), one of all
raw text. A document's log importance is the log ratio of its probabilities under the two;
the sample is the top k of log importance plus Gumbel noise, which is a draw without
replacement in proportion to importance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewright.llm.common import Words, bounded_sample, chunks, map_text, table, texts
from notewright.session import materialize

GRAMS = ((0,), (0, 1))


@dataclass(frozen=True)
class ResampleParams:
    """``keep`` is the share of rows to draw; ``target_rows`` bounds the labelled rows that
    the target model is made of; ``bits`` bounds both models."""

    keep: float = 0.8
    target_rows: int = 50_000
    bits: int = 14
    seed: int = 7


def grams(items: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    words = Words(items, signs=True)
    made = [words.grams(*gaps) for gaps in GRAMS]
    return (
        np.concatenate([d for d, _ in made]),
        (np.concatenate([h for _, h in made]) >> np.uint64(64 - bits)).astype(np.int64),
    )


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def target_ids(labels: DataFrame, params: ResampleParams) -> DataFrame:
    """Ids of good rows, those held out (crc32 of the id, modulo 4, is 2) left out."""
    good = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return bounded_sample(good.select(F.col("doc_id").alias("target_id")).distinct(), params.target_rows, "target_id")


def counts(docs: DataFrame, targets: DataFrame, params: ResampleParams) -> tuple[np.ndarray, np.ndarray]:
    """How often each bucket occurs in target rows and in all rows. Each task sums up its
    rows before anything is shuffled; 2**bits rows at most come to the driver."""
    size = 1 << params.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((2, size), np.int64)
        for batch in batches:
            items, target = texts(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            for start, end in chunks(items):
                docs, buckets = grams(items[start:end], params.bits)
                both[1] += np.bincount(buckets, minlength=size)
                both[0] += np.bincount(buckets[target[start:end][docs]], minlength=size)
        at = np.flatnonzero(both[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(both[0][at]), pa.array(both[1][at])], names=["at", "target", "raw"])

    # bounded by target_rows
    slim = docs.select("doc_id", "text")
    marked = slim.join(F.broadcast(targets), slim["doc_id"] == targets["target_id"], "left")
    rows = marked.select(F.col("text").cast("binary"), F.col("target_id").isNotNull().alias("target"))
    sums = rows.mapInArrow(run, "at long, target long, raw long").groupBy("at").agg(F.sum("target").alias("t"), F.sum("raw").alias("r"))
    out = np.zeros((2, size))
    for row in sums.collect():
        out[:, row["at"]] = row["t"], row["r"]
    return out[0], out[1]


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Per bucket, with one count added to each; no target text gives ratios of one."""
    if not target.sum():
        return np.zeros(len(target))
    return np.log((target + 1) / (target + 1).sum()) - np.log((raw + 1) / (raw + 1).sum())


def kth_largest(rows: DataFrame, key: str, k: int, bins: int = 4096) -> float | None:
    """The k-th largest value of ``key``, found by histograms of ever narrower ranges, of
    ``bins`` rows each; None without rows."""
    ends = rows.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    lo, hi, left = ends["lo"], ends["hi"], k
    while lo is not None and lo < hi:
        width = (hi - lo) / bins
        bucket = F.least(F.floor((F.col(key) - lo) / width), F.lit(bins - 1)) if width > 0 else F.lit(0)
        counted = (
            rows.filter(F.col(key).between(lo, hi)).groupBy(bucket.alias("at"))
            .agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"))
        )
        for row in sorted(counted.collect(), key=lambda r: -r["hi"]):
            if left <= row["n"]:
                break
            left -= row["n"]
        if (row["lo"], row["hi"]) == (lo, hi):  # no width left to tell them apart
            break
        lo, hi = row["lo"], row["hi"]
    return lo


def resample(docs: DataFrame, labels: DataFrame, params: ResampleParams = ResampleParams()) -> DataFrame:
    """One row a document row: doc_id, held_out, n_grams, log_weight, score (0 to 1: the log
    ratio for each root of n grams, squashed), gumbel_key, kept. Of N rows the
    ceil(keep * N) with the largest keys are kept, and any that tie with the last. Noise is
    drawn from the id and the text, so repeated rows tie. A text without words has a log
    weight of 0; without good labels all have."""
    target, raw = counts(docs, target_ids(labels, params), params)
    ratio = docs.sparkSession.sparkContext.broadcast(log_ratio(target, raw))

    def make():
        weights = ratio.value

        def work(items):
            n, total = np.zeros(len(items), np.int64), np.zeros(len(items))
            for start, end in chunks(items):
                owner, buckets = grams(items[start:end], params.bits)
                n[start:end] = np.bincount(owner, minlength=end - start)
                total[start:end] = np.bincount(owner, weights[buckets], minlength=end - start)
            return n.tolist(), total.tolist()

        return work

    fields = [T.StructField("n_grams", T.LongType()), T.StructField("log_weight", T.DoubleType())]
    noise = F.xxhash64(F.lit(params.seed), F.col("doc_id"), F.col("text"))
    uniform = (F.shiftrightunsigned(noise, 11).cast("double") + 0.5) * F.lit(2.0**-53)
    drawn = docs.select("doc_id", "text", (-F.log(-F.log(uniform))).alias("noise"))
    scored = map_text(drawn, make, fields, keep=["doc_id", "noise"])
    rows = materialize(
        scored.select("doc_id", "n_grams", "log_weight", (F.col("log_weight") + F.col("noise")).alias("gumbel_key")), "importance"
    )
    last = kth_largest(rows, "gumbel_key", int(np.ceil(params.keep * rows.count())))
    squashed = 1 / (1 + F.exp(-F.col("log_weight") / F.sqrt(F.greatest("n_grams", F.lit(1)))))
    return rows.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_grams",
        "log_weight",
        squashed.alias("score"),
        "gumbel_key",
        (F.col("gumbel_key") >= F.lit(last)).alias("kept"),
    )


def op1_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op1_importance_resample": op1_importance_resample}
SQL: dict[str, str] = {}
