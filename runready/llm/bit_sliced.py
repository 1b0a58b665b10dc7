"""Exact top-k by inner product over a bit-sliced index.

Components are whole numbers, floor(scale * x).  The index deals all rows into blocks of about ``BLOCK`` rows.  In a block,
each attribute is taken from its least value on and quantised to its ``SLICES`` leading bits; bit i of an attribute over all
rows of the block is one bitmap, a slice.

The score of a query q is a sum of q_d times attribute d.  Its approximation is added up with bitmap arithmetic: slice i of
attribute d enters the sum at weight 2^(i + j) for each bit j of |q_d| (of a negative q_d with all bits
turned over, which changes the sum by a constant), and full adders turn three bitmaps of a weight into one of it and one of the
next, until one slice a weight is left.  From the most significant slice downward, the rows are halved until
the k-th best approximation is known.  The bits that quantising left out add between -N and P to a score, both
known from |q|; so every row whose approximation comes within N + P of the k-th best is looked at exactly, and no
other row can be among the k best.  The best of all blocks are ranked by exact score.

Each block of rows meets each block of queries once (``blocks.block_stream``) and yields at most k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runready.llm.blocks import QUERY, block_stream
from runready.llm.tables import stored

BLOCK = 16_384               # rows of a block of vectors with up to 256 components
QUERY_BLOCK = 64
QUERY_BLOCKS_A_ROUND = 16
NO_ID = 2 ** 63 - 1          # sorts rows without an id last
SLICES = 5                   # leading bits kept of each attribute
LARGEST = 2 ** 62            # sums beyond are an error, as any overflow of a long


def packed(bits: np.ndarray) -> np.ndarray:
    """Booleans (rows, ...) as bitmaps of 64-bit words (..., words)."""
    rows = bits.shape[0]
    words = -(-rows // 64)
    out = np.zeros((words * 8, *bits.shape[1:]), np.uint8)
    small = np.packbits(bits, axis=0, bitorder="little")
    out[:len(small)] = small
    return np.ascontiguousarray(np.moveaxis(out, 0, -1)).view(np.uint64)


def rows_of(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


class SlicedBlock:
    """The slices of one block's attributes, with the whole numbers for exact scores."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.n = len(x)
        self.reach = np.abs(x).max(0).astype(np.float64) if self.n else np.zeros(x.shape[1])
        y = x - x.min(0) if self.n else x
        width = np.array([int(v).bit_length() for v in (y.max(0) if self.n else [])], np.int64)
        self.drop = np.maximum(width - SLICES, 0)               # bits left out of each attribute
        high = (y >> self.drop).astype(np.uint8)
        self.kept = width - self.drop
        self.slices = np.stack([packed(((high >> i) & 1).astype(bool)) for i in range(SLICES)])
        self.every = packed(np.ones((self.n, 1), bool))[0]
        self.turned = self.slices ^ np.where((np.arange(SLICES)[:, None] < self.kept)[..., None], self.every, np.uint64(0))

    def sums(self, q: np.ndarray) -> list[np.ndarray]:
        """Slices of the approximate score, the least significant first."""
        weight = np.abs(q) << self.drop
        use = np.where((q < 0)[None, :, None], self.turned, self.slices)
        at, exists = np.arange(SLICES)[:, None], np.arange(SLICES)[:, None] < self.kept
        top = int(weight.max()).bit_length() + SLICES if len(weight) else 0
        out, carried, level = [], [], 0
        while level < top or carried:
            bit = level - at                                     # the bit of the weight that puts slice i here
            here = exists & (bit >= 0) & (((weight >> np.maximum(bit, 0)) & 1) == 1)
            maps = np.concatenate([use[here], *carried]) if carried else use[here]
            carried = []
            while len(maps) > 1:
                third = len(maps) // 3
                if third:
                    a, b, c = maps[:third], maps[third:2 * third], maps[2 * third:3 * third]
                    odd = a ^ b
                    carried.append((a & b) | (odd & c))
                    maps = np.concatenate([odd ^ c, maps[3 * third:]])
                else:
                    carried.append(maps[:1] & maps[1:2])
                    maps = maps[:1] ^ maps[1:2]
            out.append(maps[0] if len(maps) else np.zeros_like(self.every))
            level += 1
        return out

    def fits(self, q: np.ndarray) -> bool:
        """Whether every sum on the way to a score fits a long, for certain."""
        return float((np.abs(q) * (self.reach + 1) * 2.0 ** SLICES).sum()) < LARGEST

    def best(self, q: np.ndarray, k: int, own: int) -> np.ndarray:
        """Rows that hold the k best of this block for ``q`` (row ``own`` left out; -1: none), and few others."""
        alive = self.every.copy()
        if own >= 0:
            alive[own // 64] &= ~(np.uint64(1) << np.uint64(own % 64))
        if self.n - (own >= 0) <= k:
            return rows_of(alive)
        sums = self.sums(q)
        # the k-th best approximation, from the most significant slice downward
        kth, left, tied = 0, k, alive
        for level in range(len(sums) - 1, -1, -1):
            with_bit = tied & sums[level]
            n = int(np.bitwise_count(with_bit).sum())
            if n >= left:
                tied, kth = with_bit, kth | (1 << level)
            else:
                tied, left = tied & ~sums[level], left - n
        slack = sum(int(a) * ((1 << int(s)) - 1) for a, s in zip(np.abs(q), self.drop, strict=True))
        least = max(0, kth - slack)
        # rows whose approximation is at least that number: above it at some bit, equal in all higher ones
        above, equal = np.zeros_like(alive), alive
        for level in range(len(sums) - 1, -1, -1):
            if least >> level & 1:
                equal = equal & sums[level]
            else:
                above |= equal & sums[level]
                equal = equal & ~sums[level]
        return rows_of(above | equal)


def _numbers(flat: np.ndarray, scale: int) -> np.ndarray:
    x = np.floor(flat.astype(np.float64) * scale)
    if len(x) and np.abs(x).max() >= 2 ** 62:
        raise OverflowError("a component does not fit a long")
    return x.astype(np.int64)


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes that hold all of them, after one that tells how many."""
    size = next(s for s in (1, 2, 4, 8) if not x.size or (-(1 << (8 * s - 1)) <= x.min() and x.max() < 1 << (8 * s - 1)))
    return bytes([size]) + x.astype(f"<i{size}").tobytes()


def _unpack(data: bytes, rows: int, dims: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).astype(np.int64).reshape(rows, dims)


BLOCK_SCHEMA = "block long, dims long, ids array<long>, is_query array<boolean>, vectors binary"


def build_blocks(vectors: DataFrame, scale: int, is_query: Column, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """All vectors that take part, as stored blocks (one row each), and the number of blocks."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("is_query"),
                          v.alias("v")).where(finite)
    seen = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims")).first()
    size = max(64, min(BLOCK, BLOCK * 256 // max(1, seen["dims"] or 1)))
    n_blocks = max(1, ceil(seen["n"] / size))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in parts if b.num_rows]
        if not batches:
            return
        part = pa.Table.from_batches(batches)
        lists = part["v"].combine_chunks()
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
        dims = int(lengths.max())
        x = np.zeros((len(part), dims), np.int64)                # a shorter vector ends in zeros
        x[np.arange(dims) < lengths[:, None]] = _numbers(lists.flatten().to_numpy(zero_copy_only=False), scale)
        yield pa.RecordBatch.from_pylist([{
            "block": part["part"][0].as_py(), "dims": dims, "ids": part["id"].to_pylist(),
            "is_query": part["is_query"].to_pylist(), "vectors": _pack(x)}],
            schema=pa.schema([("block", pa.int64()), ("dims", pa.int64()), ("ids", pa.list_(pa.int64())),
                              ("is_query", pa.list_(pa.bool_())), ("vectors", pa.binary())]))

    dealt = rows.repartition(n_blocks).withColumn("part", F.spark_partition_id())
    return stored(dealt.mapInArrow(run, BLOCK_SCHEMA), "blocks"), n_blocks


def query_blocks(blocks: DataFrame) -> DataFrame:
    """The queries of all blocks: ``owner, qdims, at, qids, queries`` in rows of at most ``QUERY_BLOCK`` queries."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                at = np.flatnonzero(np.asarray(row.is_query, bool))
                x = _unpack(row.vectors, len(row.ids), row.dims)
                ids = np.asarray(row.ids)
                out = []
                for k in range(0, len(at), QUERY_BLOCK):
                    some = at[k:k + QUERY_BLOCK]
                    out.append((row.block, row.dims, some.tolist(), ids[some].tolist(), _pack(x[some])))
                if out:
                    yield pd.DataFrame(out, columns=["owner", "qdims", "at", "qids", "queries"])

    return blocks.mapInPandas(run, "owner long, qdims long, at array<long>, qids array<long>, queries binary")


def _block_best(stream: DataFrame, k: int) -> DataFrame:
    """The k best rows of each block for each of its queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, queries = None, []
        for batch in batches:
            for n in range(batch.num_rows):
                row = {c: batch.column(c)[n].as_py() for c in ("key", "kind")}
                if row["key"] != key:
                    key, queries = row["key"], []
                row |= {c: batch.column(c)[n].as_py() for c in batch.schema.names}
                if row["kind"] == QUERY:
                    queries.append((row["owner"], row["at"], row["qids"], _unpack(row["queries"], len(row["at"]), row["qdims"])))
                    continue
                block = SlicedBlock(_unpack(row["vectors"], len(row["ids"]), row["dims"]))
                order = np.array([NO_ID if i is None else i for i in row["ids"]], np.int64)
                for owner, at, ids, x in queries:
                    x = np.pad(x, ((0, 0), (0, max(0, row["dims"] - x.shape[1]))))[:, :row["dims"]]
                    out = []
                    for q, place, query in zip(x, at, ids, strict=True):
                        if not block.fits(q):
                            raise OverflowError(f"a score of query {query} may not fit a long")
                        found = block.best(q, k, place if owner == row["block"] else -1)
                        score = block.x[found] @ q
                        top = np.lexsort((order[found], -score))[:k]
                        out += [(owner, place, query, row["ids"][found[t]], int(score[t])) for t in top]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else
                                                     [pa.array([], pa.int64())] * 5, names=["owner", "at", "query_id", "vec_id", "score"])

    return stream.mapInArrow(run, "owner long, at long, query_id long, vec_id long, score long")


def top_inner_products(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id",
                       vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that ``is_query`` marks, the ``k`` other rows of greatest inner product.

    Components are floor(scale * x) in doubles.  Vectors that are null or hold a null or non-finite component
    take no part, neither as queries nor as candidates.  Of equal scores the smaller id comes first, rows
    without an id last.  A row is left out of its own result alone: another row with the same id, or the same vector, is a candidate.
    Each of several rows with one id is a query of its own (its ranks start anew).  A shorter vector counts
    as followed by zeros.  An empty table, or one without queries, gives no row; a score that may not fit a long is an
    error.  Other columns are not read.
    """
    blocks, n_blocks = build_blocks(vectors, scale, is_query, id_col, vector_col)
    queries = stored(query_blocks(blocks), "query-blocks")
    stream = block_stream(blocks.select("block", F.lit(0).alias("part"), "dims", "ids", "vectors"),
                          queries.withColumn("query", F.xxhash64("owner", F.element_at("at", 1))),
                          n_blocks, queries.count(), QUERY_BLOCKS_A_ROUND)
    best = Window.partitionBy("owner", "at").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return (_block_best(stream, k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


__all__ = ["top_inner_products", "build_blocks", "query_blocks", "SlicedBlock", "packed", "rows_of"]
