"""A stated query set against all rows, block by block.

Rows lie in blocks (one or more table rows each), queries in table rows of theirs.  Every block meets every query once: both
are dealt to ``groups x rounds`` keys, so that neither side has to fit one machine and a key holds a bounded
number of each.  There is no join: the rows of a key follow each other in one stream, its queries first and then
its blocks one after another, so a task holds the queries of a round and a single block.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS_A_GROUP = 8            # blocks of rows with one key
QUERIES_A_ROUND = 512         # rows of the query table that meet them in one task

QUERY, BLOCK = 0, 1           # kinds of rows in the stream


def block_stream(blocks: DataFrame, queries: DataFrame, n_blocks: int, n_queries: int,
                 queries_a_round: int = QUERIES_A_ROUND) -> DataFrame:
    """Rows of ``blocks(block, part, ...)`` and ``queries(query, ...)`` in partitions sorted by ``key, kind, block, part``.

    ``block`` and ``query`` are numbers that spread well, as hashes do.  The other columns must have names of their own; each is
    null in rows of the other kind.  Where there are few blocks, as many rounds are made as keep the cores busy: a block
    is then sent once a round.
    """
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    groups = max(1, ceil(n_blocks / BLOCKS_A_GROUP), min(n_blocks, 2 * cores))
    rounds = max(1, ceil(n_queries / queries_a_round), min(n_queries, ceil(2 * cores / groups)))
    every_round = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rounds - 1).cast("long")))
    every_group = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
    left = (blocks.withColumn("round", every_round)
            .withColumn("key", F.pmod("block", F.lit(groups)) * rounds + F.col("round")).drop("round"))
    right = (queries.withColumn("group", every_group)
             .withColumn("key", F.col("group") * rounds + F.pmod("query", F.lit(rounds))).drop("group", "query"))
    both = left.withColumn("kind", F.lit(BLOCK)).unionByName(right.withColumn("kind", F.lit(QUERY)), allowMissingColumns=True)
    # by number, so that small tables with much work to each byte are not put together into a few tasks
    keys = groups * rounds
    return both.repartition(min(3 * keys, keys + 256), "key").sortWithinPartitions("key", "kind", "block", "part")


__all__ = ["block_stream", "QUERY", "BLOCK"]
