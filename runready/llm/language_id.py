"""Language ID: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text is the average of the embeddings of its words' character n-grams (1 to 4, with word
boundaries) and whole words, hashed into ``BUCKETS`` rows; a linear softmax scores the languages.
Embeddings and weights are trained by plain stochastic gradient descent in numpy, on at most
``MAX_PER_LANG`` different labelled texts of each language (chosen by a hash of the text, whole
texts; copies count once) and on short word spans drawn from them, so that one-line texts are in distribution too.
A fifth of the sample is kept out of training: it sets the softmax temperature and the rejection
threshold.

As average and softmax input are linear, the trained model folds into one score vector per bucket;
a worker scores a word once and keeps the scores of up to ``CACHED_WORDS`` words.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from runready.functions.joins import broadcast_if_small
from runready.llm.tables import stored, worker_cache

BUCKETS = 1 << 14
DIM = 16
MAX_PER_LANG = 500           # documents of each language that training reads
SPANS = 6                    # short spans drawn from each of them
EPOCHS = 4
RATE = 0.5
CALIBRATION_PART = 5         # one document in five calibrates
MAX_REJECTED = 0.001         # share of right answers that rejection may cost on the calibration part
MAX_THRESHOLD = 0.5
CACHED_WORDS = 400_000
PIECE = 50_000
UNDETERMINED = "und"

_LETTERS = re.compile(r"[^\W\d_]+")


def letter_runs(text: str | None) -> list[str]:
    """Lower-cased runs of letters; empty where the text has no letter."""
    runs = _LETTERS.findall(text.lower()) if text else []
    return runs if any(c.isalpha() for r in runs for c in r) else []


def subwords(word: str) -> list[int]:
    """Buckets of a word's character n-grams (1 to 4) and of the word itself."""
    w = f"<{word}>"
    grams = [w[i:i + n] for n in (1, 2, 3, 4) for i in range(len(w) - n + 1)]
    return [zlib.crc32(g.encode()) % BUCKETS for g in [*grams[1:len(w) - 1], *grams[len(w):], w]]


def bag(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of ``words`` and their shares."""
    ids, n = np.unique(np.array([b for w in words for b in subwords(w)], np.int32), return_counts=True)
    return ids, (n / n.sum()).astype(np.float32)


@dataclass
class LanguageModel:
    langs: list[str]
    scores: np.ndarray          # per bucket and language: embedding times softmax weights
    bias: np.ndarray
    letters: frozenset[str]     # letters seen in training
    temperature: float = 1.0
    threshold: float = 0.0      # a lower score is rejected
    key: str = field(default_factory=lambda: uuid4().hex)

    def words(self, words: list[str]) -> np.ndarray:
        """Per word: summed scores of its subwords, their number, its letters and its known letters."""
        ids = [subwords(w) for w in words]
        n = np.array([len(i) for i in ids])
        sums = np.add.reduceat(self.scores[np.concatenate(ids)], np.cumsum(n) - n, axis=0)
        letters = self.letters
        return np.column_stack([sums, n, [len(w) for w in words], [sum(c in letters for c in w) for w in words]])

    def finish(self, total: np.ndarray) -> tuple[int, float]:
        """Best language and its calibrated score from the sum of ``words`` over a text."""
        n = len(self.langs)
        z = (total[:n] / total[n] + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())                      # ties: the first language in order
        return best, float(p[best] * total[n + 2] / total[n + 1])


class WordScores:
    """Scores of the words that a worker has met, for one model."""

    def __init__(self, model: LanguageModel):
        self.model, self.known, self.table = model, {}, np.zeros((1024, len(model.langs) + 3))

    def total(self, words: list[str]) -> np.ndarray:
        known = self.known
        new = [w for w in set(words) if w not in known]
        if len(known) + len(new) > CACHED_WORDS:
            known = self.known = {}
            new = list(set(words))
        if len(known) + len(new) > len(self.table):
            more = np.zeros((len(self.table) + len(new), self.table.shape[1]))
            self.table = np.vstack([self.table, more])
        if new:
            at = len(known)
            self.table[at:at + len(new)] = self.model.words(new)
            known.update(zip(new, range(at, at + len(new)), strict=True))
        at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        # in pieces: bounds the memory of very long texts
        return sum(self.table[at[k:k + PIECE]].sum(0) for k in range(0, len(at), PIECE))


def _examples(texts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in texts:
        out = []
        for lang, text, key in zip(part["lang"], part["text"], part["key"], strict=True):
            words = letter_runs(text)
            if not words:
                continue
            rng = np.random.default_rng(key % (1 << 32))
            spans = [words]
            for _ in range(SPANS):
                a, n = int(rng.integers(len(words))), int(rng.integers(1, 9))
                spans.append(words[a:a + n])
            letters = "".join(sorted({c for w in words for c in w}))
            for k, span in enumerate(spans):
                ids, share = bag(span)
                out.append((lang, key, k, letters if k == 0 else "", ids.tobytes(), share.tobytes()))
        yield pd.DataFrame(out, columns=["lang", "key", "span", "letters", "ids", "share"])


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's first row of each ``lang`` and ``key``."""
    seen: set = set()
    for batch in batches:
        at = []
        for k, row in enumerate(zip(batch.column("lang").to_pylist(), batch.column("key").to_pylist(), strict=True)):
            if row not in seen:
                seen.add(row)
                at.append(k)
        if at:
            yield batch.take(pa.array(at, pa.int64()))


def sampled(labelled: DataFrame) -> DataFrame:
    """``lang, text, key`` of the ``MAX_PER_LANG`` different texts of each language with the smallest hashes."""
    rows = labelled.where("text is not null and lang is not null").select(
        F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"),
        F.xxhash64("text").alias("key"))
    # Spark takes each partition's MAX_PER_LANG first: as many rows per language and partition reach one task
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("key", F.lit(1 << 20)), "key"))
    chosen = stored(rows.select("lang", "key").distinct().withColumn("rank", rank)
                    .where(F.col("rank") <= MAX_PER_LANG).select("lang", "key"), "sampled-texts")
    # of a text with many copies, every task sends one
    found = rows.join(broadcast_if_small(chosen), ["lang", "key"]).select("lang", "text", "key")
    return found.mapInArrow(_first_of_each, "lang string, text string, key long").dropDuplicates(["lang", "key"])


def train(labelled: DataFrame, seed: int = 7) -> LanguageModel:
    """Fit a model to ``labelled(text, lang)``; rows without a text, a lang or a letter teach nothing.

    Where no row is left the model has no language and finds every text undetermined.
    """
    sample = sampled(labelled).mapInPandas(_examples, "lang string, key long, span int, letters string, "
                                                      "ids binary, share binary")
    got = sorted(sample.collect(), key=lambda r: (r.key, r.lang, r.span))
    if not got:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), frozenset())
    langs = sorted({r.lang for r in got})
    data = [(langs.index(r.lang), np.frombuffer(r.ids, np.int32), np.frombuffer(r.share, np.float32),
             (r.key // 1024) % CALIBRATION_PART == 0) for r in got]
    fit, held = [d for d in data if not d[3]] or data, [d for d in data if d[3]] or data

    rng = np.random.default_rng(seed)
    emb = (rng.standard_normal((BUCKETS, DIM)) / DIM).astype(np.float32)
    weights, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for k in rng.permutation(len(fit)):
            lang, ids, share, _ = fit[k]
            rows_ = emb[ids]
            h = share @ rows_
            z = h @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[lang] -= 1                            # gradient of the log loss
            back = weights @ p
            weights -= rate * np.outer(h, p)
            bias -= 0.1 * rate * p
            # the step of a bucket is its share's, scaled up as shares of long texts are small
            emb[ids] = rows_ - (rate * len(ids) ** 0.5) * np.outer(share, back)
    model = LanguageModel(langs, emb @ weights, bias, frozenset("".join(r.letters for r in got)))
    _calibrate(model, held)
    return model


def _calibrate(model: LanguageModel, held: list) -> None:
    """Set the temperature of least log loss, then the threshold that keeps the right answers."""
    z = np.array([share @ model.scores[ids] + model.bias for _, ids, share, _ in held])
    truth = np.array([lang for lang, *_ in held])

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), truth]).mean())

    model.temperature = float(min(np.geomspace(0.05, 20, 61), key=loss))
    s = z / model.temperature
    p = np.exp(s - s.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    right = np.sort(p.max(1)[p.argmax(1) == truth])
    at = right[int(MAX_REJECTED * len(right))] if len(right) else 0.0
    model.threshold = float(min(at, MAX_THRESHOLD))


def predict(docs: DataFrame, model: LanguageModel, *carried: str) -> DataFrame:
    """``carried`` columns of ``docs`` with ``lang_pred``, ``score`` and ``rejected``.

    A null text or one without letters gives ``und``, score 0, rejected.  Only ``text`` is read
    besides the carried columns; the whole text is scored; repeated rows get equal answers.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)      # a few MB at most: BUCKETS x languages

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = worker_cache(model.key, lambda: WordScores(model))
        for batch in batches:
            best, value = [], []
            for text in batch.column(0).to_pylist():
                words = letter_runs(text)
                if not words or not model.langs:
                    best.append(UNDETERMINED)
                    value.append(0.0)
                    continue
                lang, s = model.finish(scorer.total(words))
                best.append(model.langs[lang])
                value.append(min(1.0, max(0.0, s)))
            rejected = [s < model.threshold or b == UNDETERMINED for b, s in zip(best, value, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(best, pa.string()), pa.array(value, pa.float64()),
                 pa.array(rejected, pa.bool_())],
                names=[*carried, "lang_pred", "score", "rejected"])

    read = docs.select(F.col("text").cast("string").alias("_text"), *[F.col(f"`{c}`") for c in carried])
    schema = T.StructType([*read.schema.fields[1:], T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return read.mapInArrow(score, schema)


__all__ = ["train", "predict", "letter_runs", "LanguageModel", "UNDETERMINED"]
