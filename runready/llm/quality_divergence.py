"""Quality rules by distribution divergence.

Each document has two histograms: its characters by class (``CLASSES``) and its words over the
languages' common words (one more bin holds all other words).  Each language has a reference
for both: the sums over the documents of that language that pass the base rules.  A document's
divergence is its least Jensen-Shannon distance (base 2, 0 to 1) to a reference.  It fails
where the class distance exceeds ``MAX_CLASS_DISTANCE`` or the word distance ``MAX_WORD_DISTANCE``;
a histogram is judged only from ``MIN_CHARS`` characters or ``MIN_WORDS`` words on, as short texts
are far from any reference by chance.

Base rules: under 10 words, or over 20 % of the words in 5-word windows that repeat.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runready.llm.tables import stored

MIN_BASE_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
MIN_CHARS = 200
MIN_WORDS = 40
MAX_CLASS_DISTANCE = 0.25
MAX_WORD_DISTANCE = 0.5
COMMON_WORDS = 64            # of each language
HELD_WORDS = 500_000         # counts that a task adds up before it sends them on
HELD_CHARS = 32_000_000      # and characters it reads at most for them
SENT_WORDS = 50_000          # counts in a batch

CLASSES = ["lower", "upper", "other letter", "digit", "space", "line end", "sentence mark", "symbol"]
_SYMBOLS = "[#*$%&|<>]"
_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
_SENTENCE = ".,;:!?'\"()-’‘“”«»¿¡–—"
_WORD = re.compile(f"[^{_SPACE}]+")


def _char_class(code: int) -> int:
    c = chr(code)
    kind = unicodedata.category(c)
    if c == "\n":
        return 5
    if c in _SPACE or kind[0] == "Z":
        return 4
    if c in _SENTENCE:
        return 6
    return {"Ll": 0, "Lu": 1}.get(kind, {"L": 2, "M": 2, "N": 3}.get(kind[0], 7))


_TABLE: np.ndarray | None = None


def class_counts(text: str) -> np.ndarray:
    """Characters of ``text`` by class (code points beyond the basic plane count as symbols)."""
    global _TABLE
    if _TABLE is None:
        _TABLE = np.fromiter((_char_class(c) for c in range(65536)), np.int8, 65536)
        _TABLE[65535] = 7
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(_TABLE[np.minimum(codes, 65535)], minlength=len(CLASSES))


def repeated_words(words: list[str]) -> int:
    """Words that lie in a ``WINDOW``-word window found twice or more in ``words``."""
    windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    covered = upto = 0
    for k, w in enumerate(windows):
        if seen[w] > 1:
            covered += k + WINDOW - max(k, upto)
            upto = k + WINDOW
    return covered


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    return len(lines) - len(set(lines))


def base_counts(text: str, words: list[str]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    return (len(words), len(text) - sum(map(text.count, _SPACE)), sum(map(text.count, _SYMBOLS)),
            duplicate_lines(text), repeated_words(words))


def fails_base(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_BASE_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def js_distance(counts: np.ndarray, reference: np.ndarray) -> float:
    """Jensen-Shannon distance, base 2, of two histograms (1 where one is empty)."""
    if not counts.sum() or not reference.sum():
        return 1.0
    p, q = counts / counts.sum(), reference / reference.sum()
    m = (p + q) / 2

    def kl(a: np.ndarray) -> float:
        at = a > 0
        return float((a[at] * np.log2(a[at] / m[at])).sum())

    return max(0.0, (kl(p) + kl(q)) / 2) ** 0.5


def common_words(docs: DataFrame) -> list[str]:
    """The ``COMMON_WORDS`` most frequent lower-cased words of each language, in order.

    Every occurrence counts: a task sends its counts on when it holds many, and at its end.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, c in seen.items():
                words, n = list(c), list(c.values())
                for k in range(0, len(words), SENT_WORDS):
                    part = pa.array(words[k:k + SENT_WORDS], pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(part), pa.string()), part, pa.array(n[k:k + SENT_WORDS], pa.int64())],
                        names=["lang", "word", "n"])
            seen.clear()

        chars = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(_WORD.findall(text.lower()))
                chars += len(text)
                if chars > HELD_CHARS or sum(map(len, seen.values())) > HELD_WORDS:
                    yield from rows()
                    chars = 0
        yield from rows()

    counts = (docs.where("text is not null and lang is not null")
              .select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
              .mapInArrow(count, "lang string, word string, n long")
              .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    # Spark takes each partition's COMMON_WORDS first: as many rows per language and partition reach one task
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= COMMON_WORDS)
    return sorted({r.word for r in top.select("word").distinct().collect()})


def histograms(docs: DataFrame, common: list[str]) -> DataFrame:
    """Base counts and both histograms of every document, from its whole text."""
    at = {w: k for k, w in enumerate(common)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                words = _WORD.findall(text)
                base = base_counts(text, words)
                hits = Counter(filter(at.__contains__, _WORD.findall(text.lower())))
                rows.append((*base, fails_base(base[0], base[4]), class_counts(text).tolist(),
                             [at[w] for w in hits], list(hits.values())))
            new = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), *new], names=_COLUMNS)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                       F.col("text").cast("string").alias("text")).mapInArrow(count, _SCHEMA)


_COLUMNS = ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "base_failed", "classes", "words", "hits"]
_TYPES = [*[pa.int64()] * 5, pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
_SCHEMA = ("doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
           "n_repeat_words long, base_failed boolean, classes array<long>, words array<int>, hits array<long>")


def _dense(words, hits, n_words: int, size: int) -> np.ndarray:
    """Common-word histogram with the bin of all other words at its end."""
    h = np.zeros(size + 1)
    if len(words):
        h[np.asarray(words, np.int64)] = hits
    h[size] = max(0, n_words - h[:size].sum())
    return h


def references(measured: DataFrame, size: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Class and common-word histogram of each language, over its documents that pass the base rules.

    One row per partition and language is shuffled.
    """
    width = len(CLASSES) + size + 1

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for part in parts:
            for r in part.itertuples(index=False):
                s = sums.setdefault(r.lang, np.zeros(width))
                s += [*r.classes, *_dense(r.words, r.hits, r.n_words, size)]
        yield pd.DataFrame([(lang, k, int(n)) for lang, s in sums.items() for k, n in enumerate(s) if n],
                           columns=["lang", "bin", "n"])

    rows = (measured.where("not base_failed and lang is not null")
            .select("lang", "n_words", "classes", "words", "hits")
            .mapInPandas(add, "lang string, bin int, n long")
            .groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect())       # languages x bins
    out: dict[str, np.ndarray] = {}
    for r in rows:
        out.setdefault(r.lang, np.zeros(width))[r.bin] = r.n
    return {lang: (s[:len(CLASSES)], s[len(CLASSES):]) for lang, s in sorted(out.items())}


def judge(classes: np.ndarray, words: np.ndarray, refs: dict) -> tuple[float, float, bool]:
    """Least class and word distance to a language, and whether the document passes."""
    by_class = min((js_distance(classes, c) for c, _ in refs.values()), default=0.0)
    by_word = min((js_distance(words, w) for _, w in refs.values()), default=0.0)
    bad = (classes.sum() >= MIN_CHARS and by_class > MAX_CLASS_DISTANCE
           or words.sum() >= MIN_WORDS and by_word > MAX_WORD_DISTANCE)
    return by_class, by_word, not bad


def quality_rules(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text, lang)``: base counts, distances, ``base_failed`` and ``kept``.

    A null or empty text has no words and fails the base rules; repeated rows and ids give a row
    each; a null ``lang`` feeds no reference but is judged like any other; without a reference
    (an empty table, no lang at all) the base rules decide alone.  Other columns are not read.
    """
    spark = docs.sparkSession
    common = common_words(docs)
    measured = stored(histograms(docs, common), "quality")
    size = len(common)
    refs = spark.sparkContext.broadcast(references(measured, size))     # languages x bins

    def verdict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.select(["classes", "words", "hits", "n_words"]).to_pydict()
            found = [judge(np.asarray(c, float), _dense(w, h, n, size), refs.value) for c, w, h, n in zip(
                part["classes"], part["words"], part["hits"], part["n_words"], strict=True)]
            failed = batch.column("base_failed").to_pylist()
            kept = [f[2] and not b for f, b in zip(found, failed, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, names), pa.array([f[0] for f in found], pa.float64()),
                 pa.array([f[1] for f in found], pa.float64()), pa.array(kept, pa.bool_())],
                names=[*names, "class_distance", "word_distance", "kept"])

    names = [c for c in _COLUMNS if c not in ("lang", "classes", "words", "hits")]
    return measured.mapInArrow(
        verdict, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                 "n_repeat_words long, base_failed boolean, class_distance double, word_distance double, kept boolean")


__all__ = ["quality_rules", "common_words", "histograms", "references", "judge", "js_distance", "base_counts"]
