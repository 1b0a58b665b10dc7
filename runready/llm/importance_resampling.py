"""Quality selection by importance resampling over hashed n-grams.

Two bag-of-n-grams models over ``BUCKETS`` hashed word unigrams and bigrams are counted on whole texts:
one on the target rows, one on all rows.  A document's log weight is the log ratio of the two models: the sum over all
its n-grams (``full_weight`` can temper it for long texts; that is off by default).  Adding Gumbel noise to the log weights and taking the k greatest samples k documents
without replacement in proportion to their weights.  The noise is a hash of the id, so a rerun or a
repeated task gives the same sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runready.functions.joins import broadcast_if_small
from runready.llm.tables import ascii_words, stored, worker_cache

BUCKETS = 1 << 16
SMOOTHING = 10.0             # expected counts added on both sides: a bucket must be met often to say much
BINS = 4096
CACHED_WORDS = 300_000

_PAIR = np.uint64(0x9E3779B97F4A7C15)


class NgramHasher:
    """Buckets of all unigrams and bigrams of a text, A-Z lowered."""

    def __init__(self) -> None:
        self.words: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = ascii_words(text) if text else []
        if len(self.words) > CACHED_WORDS:
            self.words = {}
        known = self.words
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        two = (h[:-1] * _PAIR) ^ h[1:]
        two = (two ^ (two >> np.uint64(31))) * _PAIR
        return (np.concatenate([h, two]) >> np.uint64(48)).astype(np.int64)


def ngram_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts per bucket over all rows of ``docs(text, is_target)`` and over the target rows.

    A row per partition and bucket is shuffled; the driver gets one per bucket.
    """
    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets_of = worker_cache("ngrams", NgramHasher)
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for part in parts:
            for text, is_target in zip(part["text"], part["is_target"], strict=True):
                n = np.bincount(buckets_of(text), minlength=BUCKETS)
                raw += n
                if is_target:
                    target += n
        at = np.flatnonzero(raw)
        yield pd.DataFrame({"bucket": at, "raw": raw[at], "target": target[at]})

    got = (docs.where("text is not null").select("text", "is_target")
           .mapInPandas(count, "bucket int, raw long, target long")
           .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect())
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in got:
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    return raw, target


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of target over raw probability per bucket, both shrunk to the raw model by ``SMOOTHING`` counts
    (all 0 without a target)."""
    expected = raw * (target.sum() / max(raw.sum(), 1.0))
    return np.log((target + SMOOTHING) / (expected + SMOOTHING))


def log_weight(buckets: np.ndarray, ratios: np.ndarray, full_weight: int | None = None) -> float:
    """The sum of the log ratios; with ``full_weight`` that of a text of more n-grams is scaled down to so many."""
    total = float(ratios[buckets].sum()) if len(buckets) else 0.0
    return total if full_weight is None or len(buckets) <= full_weight else total * full_weight / len(buckets)


def kth_greatest(values: DataFrame, column: str, k: int) -> float | None:
    """The k-th greatest of ``column``, from histograms ever finer around it (None: k is 0 or no row).

    Every round is one aggregate of ``BINS`` rows; nothing is sorted or gathered.
    """
    if k <= 0:
        return None
    lo, hi, n = values.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n:
        return None
    k = min(k, n)
    while lo < hi:
        inside = values.where((F.col(column) >= F.lit(lo)) & (F.col(column) <= F.lit(hi)))
        place = F.floor((F.col(column) - F.lit(lo)) / F.lit(hi - lo) * F.lit(BINS)).alias("bin")
        bins = inside.groupBy(place).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"))
        for b in sorted(bins.collect(), key=lambda b: -b.bin):
            if k <= b.n:
                lo, hi = b.lo, b.hi
                break
            k -= b.n
    return lo


def resample(docs: DataFrame, targets: DataFrame, share: float | None = None, seed: int = 1,
             labelled: DataFrame | None = None, full_weight: int | None = None) -> DataFrame:
    """``doc_id, log_weight, gumbel_key, kept`` for every row of ``docs(doc_id, text)``.

    ``targets(doc_id)`` names the rows of the target model (repeated ids count once, null ids
    never).  k is ``share`` of all rows, rounded up; with ``share`` None it is the share of ``labelled(doc_id)`` ids
    that are targets.  Null and empty texts have log weight 0; rows with equal keys are kept or left together;
    rows with a null id share one noise value.  Without any target all log weights are 0.  Other columns are not read.
    ``full_weight``: see ``log_weight``.
    """
    wanted = targets.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    wanted = stored(wanted.withColumn("is_target", F.lit(True)), "targets")
    if share is None:
        every = labelled.where("doc_id is not null").select("doc_id").distinct().count() if labelled is not None else 0
        share = wanted.count() / every if every else 0.0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    raw, target = ngram_counts(rows.join(broadcast_if_small(wanted), "doc_id", "left")
                               .select("text", F.coalesce("is_target", F.lit(False)).alias("is_target")))
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(raw, target))      # BUCKETS doubles

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets_of = worker_cache("ngrams", NgramHasher)
        for batch in batches:
            found = [log_weight(buckets_of(t), ratios.value, full_weight) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())],
                                             names=["doc_id", "log_weight"])

    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    keyed = stored(rows.mapInArrow(score, "doc_id long, log_weight double")
                   .withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform))), "gumbel")
    cut = kth_greatest(keyed, "gumbel_key", int(np.ceil(share * keyed.count())))
    return keyed.withColumn("kept", F.lit(False) if cut is None else F.col("gumbel_key") >= F.lit(cut))


__all__ = ["resample", "ngram_counts", "log_ratios", "log_weight", "kth_greatest", "NgramHasher"]
