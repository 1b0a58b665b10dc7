"""Benchmark decontamination with spaced seeds.

Tokens are lower-cased words without outer punctuation.  A text is contaminated by an item where some
``WINDOW`` tokens in a row (a shorter item: all its tokens) line up with as many of the item and at
most ``SUBSTITUTED`` of them differ (a shorter item: none).

A seed hashes the six tokens that its mask keeps and ignores those between.  For any two
substituted tokens in a window one of ``MASKS`` fits beside them, so hash hits reach every such overlap
(checked in the tests for all placements); for each hit the texts are laid over each other and the overlap is
verified token by token.

Items are few beside the corpus.  While they hold at most ``MAX_BROADCAST_TOKENS`` tokens their
seeds go to every task, and the corpus is neither shuffled nor expanded; beyond that, the seed hashes of
both sides are joined.  Both ways return the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runready.llm.tables import stored, worker_cache

MASKS = [(0, 1, 2, 3, 6, 8), (0, 1, 5, 7, 8, 9), (0, 2, 3, 5, 6, 9), (0, 1, 2, 4, 5, 6)]
WINDOW = 13
SUBSTITUTED = 2
MIN_ITEM = 5                 # an item of fewer tokens says too little to be found again
MAX_BROADCAST_TOKENS = 1_000_000
CACHED_WORDS = 300_000
CHUNK = 128                  # documents hashed at once

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                     0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3,
                     0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x2545F4914F6CDD1D, 0xFF51AFD7ED558CCD], np.uint64)


class TokenHasher:
    """64-bit hashes of a text's tokens; words without a letter or digit are no tokens."""

    def __init__(self) -> None:
        self.words: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.lower().split() if text else []
        if len(self.words) > CACHED_WORDS:
            self.words = {}
        known = self.words
        for w in set(words):
            if w not in known:
                a, z = 0, len(w)
                while a < z and not w[a].isalnum():
                    a += 1
                while z > a and not w[z - 1].isalnum():
                    z -= 1
                known[w] = xxhash.xxh3_64_intdigest(w[a:z]) | 1 if a < z else 0
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        return h[h != 0]


def masks_for(lengths: list[int]) -> list[tuple[int, ...]]:
    """The fixed masks, and one that keeps every token for each length of a short item."""
    return MASKS + [tuple(range(n)) for n in sorted({n for n in lengths if MIN_ITEM <= n < WINDOW})]


def seeds(tokens: np.ndarray, mask: tuple[int, ...], number: int) -> np.ndarray:
    """Hash of the kept tokens at every position where the mask fits."""
    size = len(tokens) - mask[-1]
    if size <= 0:
        return np.empty(0, np.uint64)
    h = np.full(size, number + 1, np.uint64)
    for factor, at in zip(_FACTORS, mask, strict=False):
        h += tokens[at:at + size] * factor
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def item_seeds(tokens: np.ndarray, masks: list[tuple[int, ...]]) -> Iterator[tuple[int, np.ndarray]]:
    """Masks that apply to an item, with its seeds: the fixed ones, or for a short item its own."""
    n = len(tokens)
    for number, mask in enumerate(masks):
        if number < len(MASKS) if n >= WINDOW else len(mask) == n and number >= len(MASKS):
            yield number, seeds(tokens, mask, number)


def overlap(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int] | None:
    """Equal tokens in the qualifying windows with the item laid at ``shift`` over the document, and
    the document position where the first such window begins; None without such a window."""
    a, z = max(0, shift), min(len(doc), shift + len(item))
    n = min(WINDOW, len(item))
    if z - a < n:
        return None
    same = doc[a:z] == item[a - shift:z - shift]
    run = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(run[n:] - run[:-n] >= n - (SUBSTITUTED if len(item) >= WINDOW else 0))
    if not len(good):
        return None
    inside = np.zeros(len(same) + 1, np.int64)
    np.add.at(inside, good, 1)
    np.add.at(inside, good + n, -1)
    return int(same[np.cumsum(inside[:-1]) > 0].sum()), int(a + good[0])


def best_overlaps(doc: np.ndarray, hits: set[tuple[int, int]], items: list[np.ndarray]) -> dict[int, tuple[int, int]]:
    """For each item with a verified overlap: most equal tokens, then the earliest position."""
    best: dict[int, tuple[int, int]] = {}
    for item, shift in hits:
        found = overlap(doc, items[item], shift)
        if found and (item not in best or (-found[0], found[1]) < (-best[item][0], best[item][1])):
            best[item] = found
    return best


class SeedIndex:
    """Seeds of all items, sorted, behind a bitmap of their upper bits."""

    def __init__(self, items: list[np.ndarray]):
        self.items, self.masks = items, masks_for([len(t) for t in items])
        found = [(s, k, np.arange(len(s))) for k, t in enumerate(items) for _, s in item_seeds(t, self.masks)]
        keys = np.concatenate([f[0] for f in found]) if found else np.empty(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.item = np.concatenate([np.full(len(s), k) for s, k, _ in found])[order] if found else keys
        self.at = np.concatenate([f[2] for f in found])[order] if found else keys
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.keys >> np.uint64(44)] = True

    def hits(self, tokens: np.ndarray, mask: int) -> Iterator[tuple[int, int, int]]:
        """Position, item and position in the item of every seed hit of one mask."""
        h = seeds(tokens, self.masks[mask], mask)
        where = np.flatnonzero(self.bits[h >> np.uint64(44)])
        lo, hi = (np.searchsorted(self.keys, h[where], side) for side in ("left", "right"))
        for p, a, z in zip(where[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
            for k in range(a, z):
                yield p, int(self.item[k]), int(self.at[k])


_OUT = "doc_id long, item_id long, matched long, item_tokens long, first_token long"
_OUT_COLUMNS = ["doc_id", "item_id", "matched", "item_tokens", "first_token"]


def _by_broadcast(docs: DataFrame, ids: list[int], index: SeedIndex) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((ids, index))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, index = shared.value
        tokens_of = worker_cache("tokens", TokenHasher)
        for part in parts:
            rows = []
            for at in range(0, len(part), CHUNK):
                docs_ = part["doc_id"].iloc[at:at + CHUNK].tolist()
                each = [tokens_of(t) for t in part["text"].iloc[at:at + CHUNK]]
                ends = np.cumsum([len(t) for t in each])
                joined, hits = np.concatenate(each), {}
                for number, mask in enumerate(index.masks):
                    for p, item, q in index.hits(joined, number):
                        d = int(np.searchsorted(ends, p, "right"))
                        if p + mask[-1] < ends[d]:                  # not over the end of the document
                            hits.setdefault(d, set()).add((item, p - q - int(ends[d] - len(each[d]))))
                for d, found in hits.items():
                    for item, (matched, first) in best_overlaps(each[d], found, index.items).items():
                        rows.append((docs_[d], ids[item], matched, len(index.items[item]), first))
            yield pd.DataFrame(rows, columns=_OUT_COLUMNS)

    return docs.mapInPandas(run, _OUT)


def _by_join(docs: DataFrame, items: DataFrame, lengths: list[int]) -> DataFrame:
    """Hashes of both sides joined, hits gathered to (document, item, shift), then verified."""
    masks = masks_for(lengths)

    def rows_of(parts: Iterator[pd.DataFrame], of_items: bool) -> Iterator[pd.DataFrame]:
        tokens_of = worker_cache("tokens", TokenHasher)
        for part in parts:
            for key, text in zip(part.iloc[:, 0], part["text"], strict=True):
                t = tokens_of(text)
                for number, h in item_seeds(t, masks) if of_items else ((k, seeds(t, m, k)) for k, m in enumerate(masks)):
                    yield pd.DataFrame({"hash": h.view(np.int64), "key": key, "at": np.arange(len(h))})

    schema = "hash long, key long, at long"
    left = docs.mapInPandas(lambda p: rows_of(p, False), schema)
    right = items.mapInPandas(lambda p: rows_of(p, True), schema).distinct()
    hits = (left.join(right.select("hash", F.col("key").alias("item_id"), F.col("at").alias("q")), "hash")
            .select(F.col("key").alias("doc_id"), "item_id", (F.col("at") - F.col("q")).alias("shift")).distinct())

    def verify(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens_of = worker_cache("tokens", TokenHasher)
        for part in parts:
            rows = []
            for r in part.itertuples(index=False):
                item = tokens_of(r.item_text)
                found = overlap(tokens_of(r.text), item, r.shift)
                if found:
                    rows.append((r.doc_id, r.item_id, found[0], len(item), found[1]))
            yield pd.DataFrame(rows, columns=_OUT_COLUMNS)

    checked = (stored(hits, "seed-hits").join(docs, "doc_id")
               .join(items.withColumnRenamed("text", "item_text"), "item_id")
               .select("doc_id", "item_id", "shift", "text", "item_text").mapInPandas(verify, _OUT))
    best = F.max(F.struct("matched", -F.col("first_token")))
    return (checked.groupBy("doc_id", "item_id", "item_tokens").agg(best.alias("best"))
            .select("doc_id", "item_id", F.col("best.matched").alias("matched"), "item_tokens",
                    (-F.col("best.col2")).alias("first_token")))


def contaminated(docs: DataFrame, benchmark: DataFrame, max_broadcast_tokens: int = MAX_BROADCAST_TOKENS) -> DataFrame:
    """One row per document and benchmark item that it contains.

    Reads ``docs(doc_id, text)`` and ``benchmark(item_id, text)``, both keyed by their id; other columns are
    not read.  Rows with a null id or text match nothing; items under ``MIN_ITEM`` tokens are not looked
    for.  Returns ``doc_id, item_id``, ``matched`` (equal tokens in the qualifying windows
    of the best alignment), ``item_tokens``, ``first_token`` (where they begin in the document) and
    ``coverage`` (matched by item tokens).
    """
    def narrow(df: DataFrame, key: str) -> DataFrame:
        return (df.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text"))
                .where(F.col(key).isNotNull() & F.col("text").isNotNull()))

    docs, items = narrow(docs, "doc_id"), narrow(benchmark, "item_id")

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens_of = worker_cache("tokens", TokenHasher)
        for part in parts:
            yield pd.DataFrame({"item_id": part["item_id"], "n": [len(tokens_of(t)) for t in part["text"]]})

    counted = stored(items.mapInPandas(count, "item_id long, n long").where(F.col("n") >= MIN_ITEM), "item-tokens")
    total = counted.agg(F.sum("n")).first()[0] or 0
    used = items.join(counted.select("item_id"), "item_id", "left_semi")
    if total <= max_broadcast_tokens:
        tokens_of = worker_cache("tokens", TokenHasher)
        got = sorted((r.item_id, r.text) for r in used.collect())        # at most max_broadcast_tokens tokens
        found = _by_broadcast(docs, [i for i, _ in got], SeedIndex([tokens_of(t) for _, t in got]))
    else:
        lengths = [r.n for r in counted.where(F.col("n") < WINDOW).select("n").distinct().collect()]
        found = _by_join(docs, used, lengths)
    return found.withColumn("coverage", F.col("matched") / F.col("item_tokens"))


__all__ = ["contaminated", "TokenHasher", "MASKS", "WINDOW", "SUBSTITUTED", "overlap"]
