"""Ranked lexical search with the Best Position Algorithm.

1. Index.  Every document is split into terms and lies in one shard of bounded size.  The stored index has one row for a shard, with
   its documents in ascending id and their lengths, and one for each of its terms, with the documents that hold it and their
   counts.  The numbers of documents and terms (N, L) and the document frequency of each query term are sums over these rows.
2. Impact lists.  With these, a shard turns a query term's postings into a list by descending impact; it also keeps
   them by document, with the position of each in the list.
3. Best positions.  For a query, the lists of its terms are read from the top, a few more entries at a time.  Each document
   met is looked up in all the query's lists by direct access, which completes its score and marks its position in every list.
   A list's best position is the last one up to which all have been seen, by either access.  A document not met yet stands
   behind the best position of each list that holds it, so the impacts there add up to more than it can score; reading stops when this sum
   lies strictly below the k-th score, so that ties with it are never cut.  The best positions reach at least as far as
   what was read, so this stops no later than a threshold from the last entries read.
4. The k best of the shards (a task passes on its k-th score so far to its next shard) are ranked by exact
   score, equal scores by ascending id.

Of a shard only the terms that some query has are read.  Shards and queries meet in blocks (``blocks.block_stream``); neither
is collected.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runready.llm.blocks import QUERY, block_stream
from runready.llm.tables import stored

SHARD_TERMS = 4_000_000      # occurrences after which a shard is closed; one document is never cut
SHARD_DOCS = 16_384
TERM_ROWS = 20_000           # terms of a shard written at once
FIRST_READ = 64              # entries read of each list at first; each further read is twice as long
NO_ID = 2 ** 63 - 1          # sorts documents without an id last

# Terms are runs of ASCII letters and digits and of all bytes of non-ASCII code points; only A-Z are lowered.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TERM_BYTES).split() if text else []


# ---- index ---------------------------------------------------------------------------

# part 0: the shard's documents (``docs``: ids, ``numbers``: lengths); part 1: a term's documents (places in the shard) and their counts
INDEX = "shard long, part int, term binary, n long, n_terms long, docs binary, numbers binary"
_ARROW = pa.schema([("shard", pa.int64()), ("part", pa.int32()), ("term", pa.binary()), ("n", pa.int64()), ("n_terms", pa.int64()),
                    ("docs", pa.binary()), ("numbers", pa.binary())])


def _slices(numbers: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """``numbers`` cut into binary values of ``sizes`` numbers each."""
    ends = np.concatenate([[0], np.cumsum(sizes)]) * 4
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype("<i4")), pa.py_buffer(numbers.astype("<i4"))])


def _shard_rows(shard: int, ids: list, lengths: list[int], words: list[np.ndarray], vocabulary: list[bytes]) -> Iterator[pa.RecordBatch]:
    key = np.array([NO_ID if i is None else i for i in ids], np.int64)
    order = np.argsort(key, kind="stable")                       # documents in ascending id
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    n = np.array(lengths, np.int64)
    yield pa.RecordBatch.from_pylist([{
        "shard": shard, "part": 0, "n": int((n > 0).sum()), "n_terms": int(n.sum()),
        "docs": key[order].tobytes(), "numbers": n[order].tobytes()}], schema=_ARROW)
    # one number for (term, document); equal ones are counted
    pairs = np.concatenate(words).astype(np.int64)
    pairs *= len(ids)
    pairs += np.repeat(rank, n)
    pairs, tfs = np.unique(pairs, return_counts=True)
    terms, docs = pairs // len(ids), pairs % len(ids)
    edges = np.searchsorted(terms, np.arange(0, len(vocabulary) + TERM_ROWS, TERM_ROWS))
    for k, (a, z) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        some = vocabulary[k * TERM_ROWS:(k + 1) * TERM_ROWS]
        if some:
            dfs = np.bincount(terms[a:z] - k * TERM_ROWS, minlength=len(some))
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * len(some), pa.int64()), pa.array([1] * len(some), pa.int32()), pa.array(some, pa.binary()),
                 pa.array(dfs, pa.int64()), pa.nulls(len(some), pa.int64()), _slices(docs[a:z], dfs), _slices(tfs[a:z], dfs)], schema=_ARROW)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents as a stored index (``INDEX``); those without a term are in their shard but in no list."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, part, ids, lengths, words, held = 0, 0, [], [], [], 0
        vocabulary: dict[bytes, int] = defaultdict(count().__next__)
        for batch in batches:
            for doc, text, part in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                found = terms_of(text.as_py())
                if ids and (held + len(found) > SHARD_TERMS or len(ids) >= SHARD_DOCS):
                    yield from _shard_rows((part << 24) + number, ids, lengths, words, list(vocabulary))
                    number, ids, lengths, words, held = number + 1, [], [], [], 0
                    vocabulary = defaultdict(count().__next__)
                ids.append(doc)
                lengths.append(len(found))
                words.append(np.fromiter(map(vocabulary.__getitem__, found), np.int32, len(found)))
                held += len(found)
        if ids:
            yield from _shard_rows((part << 24) + number, ids, lengths, words, list(vocabulary))

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"),
                       F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"), F.spark_partition_id().alias("part"))
    return stored(rows.mapInArrow(run, INDEX), "index")


# ---- queries -------------------------------------------------------------------------

def query_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item, item_id, term, times``: the distinct terms of each different (id, text) row."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for item, item_id, text in zip(part["item"], part["item_id"].astype("Int64"), part["text"], strict=True):
                terms, times = np.unique(np.array(terms_of(text), object), return_counts=True) if text else ((), ())
                out += [(item, item_id, t, int(n)) for t, n in zip(terms, times, strict=True)]
            yield pd.DataFrame(out, columns=["item", "item_id", "term", "times"]).astype({"item_id": "Int64"})

    own = (items.select(F.col(f"`{id_col}`").cast("long").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
           .where("text is not null").distinct()
           .select(F.concat_ws(":", F.col("item_id"), F.sha2("text", 256)).alias("item"), "item_id", F.col("text").cast("binary").alias("text")))
    return own.mapInPandas(run, "item string, item_id long, term binary, times long")


def weighted_queries(terms: DataFrame, postings: DataFrame, n_docs: int) -> DataFrame:
    """``item, item_id, query_terms``: each query's terms with weight times repeats; those in no document, or of weight 0,
    are left out.  ``postings``: the index rows of query terms."""
    df = postings.groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    return (terms.join(df.select("term", weight.alias("weight")), "term").where("weight > 0").groupBy("item", "item_id")
            .agg(F.collect_list(F.struct("term", (F.col("weight") * F.col("times")).alias("factor"))).alias("query_terms")))


# ---- search --------------------------------------------------------------------------

class ImpactList:
    """A term's postings in a shard: by document, and their positions by descending impact."""

    def __init__(self, docs: np.ndarray, impacts: np.ndarray):
        self.docs, self.impacts = docs, impacts                  # ascending documents
        self.order = np.argsort(-impacts, kind="stable")         # position -> posting
        self.position = np.empty(len(docs), np.int64)
        self.position[self.order] = np.arange(len(docs))


def best_position_search(lists: list[tuple[ImpactList, int]], n_docs: int, k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``k`` best documents of the lists (with their factors), their scores, and how many entries were met.

    Ordered by score, then document; only scores above 0.  ``floor`` is a score that ``k`` documents elsewhere have
    already: reading also stops when no document left can reach it.
    """
    score = np.zeros(n_docs, np.int64)
    met = np.zeros(n_docs, bool)
    seen = [np.zeros(len(x.docs) + 1, bool) for x, _ in lists]   # the last entry is never seen
    best = [0] * len(lists)
    read, step, entries = 0, FIRST_READ, 0
    while lists:
        now = np.zeros(n_docs, bool)
        for x, _ in lists:                                       # sorted access
            some = x.docs[x.order[read:read + step]]
            entries += len(some)
            now[some] = True
        read, step = read + step, step * 2
        fresh = np.flatnonzero(now & ~met)
        met[fresh] = True
        threshold = 0
        for n, (x, factor) in enumerate(lists):
            at = np.searchsorted(x.docs, fresh)                  # direct access
            at[at == len(x.docs)] = 0
            hit = x.docs[at] == fresh
            at = at[hit]
            score[fresh[hit]] += factor * x.impacts[at]
            seen[n][x.position[at]] = True
            best[n] += int(np.argmin(seen[n][best[n]:]))
            if best[n] < len(x.docs):
                threshold += factor * int(x.impacts[x.order[best[n] - 1]])
        if not threshold or floor > threshold:
            break
        if np.count_nonzero(met) >= k and np.partition(score[met], -k)[-k] > threshold:
            break
    found = np.flatnonzero(score)
    found = found[np.lexsort((found, -score[found]))[:k]]
    return found, score[found], entries


class Shard:
    """Impact lists of one shard, made when a query asks for a term."""

    def __init__(self, ids: bytes, lengths: bytes, n_docs: int, n_terms: int):
        self.ids = np.frombuffer(ids, np.int64)
        self.norm = 12 * (100 - 25 + (25 * np.frombuffer(lengths, np.int64) * n_docs) // n_terms)
        self.postings: dict[bytes, tuple[bytes, bytes]] = {}
        self.lists: dict[bytes, ImpactList] = {}

    def list_of(self, term: bytes) -> ImpactList | None:
        if term not in self.lists:
            if term not in self.postings:
                return None
            docs, tf = (np.frombuffer(x, "<i4").astype(np.int64) for x in self.postings.pop(term))
            self.lists[term] = ImpactList(docs, (1_000_000_000 * tf) // (1000 * tf + self.norm[docs]))
        return self.lists[term]


def _search(stream: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shard, queries = None, None, []                     # queries: item, its id, its terms, its k best so far

        def searched() -> None:
            for _, _, terms, mine in queries if shard else ():
                lists = [(x, factor) for term, factor in terms if (x := shard.list_of(term)) is not None]
                docs, scores, _ = best_position_search(lists, len(shard.ids), k, mine[-1][0] if len(mine) == k else 0)
                mine += zip(scores.tolist(), shard.ids[docs].tolist(), strict=True)
                mine.sort(key=lambda r: (-r[0], r[1]))
                del mine[k:]

        def results() -> pa.RecordBatch:
            rows = [(item, item_id, None if doc == NO_ID else doc, s) for item, item_id, _, mine in queries for s, doc in mine]
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 4, types, strict=True)],
                                              names=["item", "item_id", "doc_id", "score"])

        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names}
            for n, (at, kind, part) in enumerate(zip(*(columns[c].to_pylist() for c in ("key", "kind", "part")), strict=True)):
                value = lambda c, n=n: columns[c][n].as_py()
                if at != key or kind != QUERY and part == 0:
                    searched()
                    shard = None
                if at != key:
                    yield results()
                    key, queries = at, []
                if kind == QUERY:
                    queries.append((value("item"), value("item_id"), [(t["term"], t["factor"]) for t in value("query_terms")], []))
                elif part == 0:
                    shard = Shard(value("docs"), value("numbers"), n_docs, n_terms)
                else:
                    shard.postings[value("term")] = (value("docs"), value("numbers"))
        searched()
        yield results()

    return stream.mapInArrow(run, "item string, item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents of greatest score above 0 for each item.

    Equal scores are ranked by ascending id, documents without an id last.  A null or empty text has no term: such a document is
    in no result, such an item has none.  Rows of ``docs`` that share an id are documents of their own;
    equal rows of ``items`` count once, different texts with one ``item_id`` are ranked each for itself.  An empty table gives no row.
    Other columns are not read.
    """
    index = build_index(docs)
    total = index.where("part = 0").agg(F.sum("n").alias("docs"), F.sum("n_terms").alias("terms"), F.count("*").alias("shards")).first()
    n_docs, n_terms = total["docs"] or 0, max(1, total["terms"] or 0)
    terms = stored(query_terms(items), "query-terms")
    # the rows of query terms; the vocabulary is broadcast only if its measured size allows it (AQE)
    postings = index.where("part = 1").join(terms.select("term").distinct(), "term", "left_semi")
    queries = stored(weighted_queries(terms, postings, n_docs), "queries")
    rows = (index.where("part = 0").select(*index.columns).unionByName(postings)
            .select(F.xxhash64("shard").alias("block"), "part", "term", "docs", "numbers"))
    stream = block_stream(rows, queries.withColumn("query", F.xxhash64("item")), total["shards"], queries.count())
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return (_search(stream, n_docs, n_terms, k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("item_id", "rank", "doc_id", "score"))


__all__ = ["search", "build_index", "best_position_search", "ImpactList", "terms_of"]
