"""Temperature mixing of sources, with DataFrame functions alone.

Source weights are the token shares raised to an exponent and normalised: 1 keeps the
natural shares, 0 makes them equal, above 1 sharpens them.  The exponent is found by bisection: the greatest that
reaches a target entropy, and the greatest that keeps every source within a repetition limit
(a source's share of the budget by its tokens).  ``LEVELS`` halvings are made per Spark job, by trying all
their middle points at once on the per-source sums.

A weight becomes documents by block permutation.  In every epoch a source's documents have a new
pseudo-random order (a keyed hash of the id) that is cut into ``BLOCKS`` blocks.  A source's
token budget takes whole epochs, then documents of one more epoch in its order while the tokens before them
fall short of the rest.  That last cut is found by block sums, level by level, so no
source, however large, is ever sorted or summed in order by one task; then each row's number of copies follows
from its own hash and its source's cut, without a join by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runready.llm.tables import WORD, shielded, stored

BLOCKS = 1 << 12             # blocks a permutation is cut into, at each of two levels
HASH_BITS = 60
LEVELS = 5                   # halvings per job
JOBS = 8                     # 40 halvings of [0, MAX_EXPONENT]
MAX_EXPONENT = 8.0


def word_count(text: Column) -> Column:
    """Words of a whole text (null: 0), as the token measure."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """60-bit place of a document in its source's order of ``epoch``; equal ids share it (a null id is '')."""
    text = F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_tokens(docs: DataFrame) -> DataFrame:
    """``source, tokens`` over ``docs(source, n_tokens)`` (a null source is one of its own)."""
    return docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))


def _bisect(shares: DataFrame, top: float, reached: Column, measures: list[Column]) -> float:
    """Greatest exponent in [0, ``top``] at which ``reached`` holds, if it holds at 0; else 0.

    ``measures`` are aggregates over the sources' ``w`` (share ** exponent) and ``tokens`` at one exponent, and
    ``reached`` a condition on them that fails for good as the exponent grows.
    """
    lo, hi, parts = 0.0, top, 1 << LEVELS
    for _ in range(JOBS):
        step = (hi - lo) / parts
        tried = (shares.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(parts))))
                 .withColumn("w", F.pow("share", F.lit(lo) + F.col("k") * F.lit(step))))
        best = (tried.groupBy("k").agg(*measures).where(reached).agg(F.max("k")).first()[0]) or 0
        lo, hi = lo + best * step, lo + min(best + 1, parts) * step
        if lo >= top:
            break
    return lo


def mixing_weights(sources: DataFrame, budget: int | None, target_entropy: float | None = None,
                   max_repetition: float | None = None) -> DataFrame:
    """``source, tokens, weight, source_budget`` for ``sources(source, tokens)``.

    ``target_entropy`` is a share (0 to 1) of the entropy of equal weights; natural weights
    above it are sharpened to it (exponent up to ``MAX_EXPONENT``).  ``max_repetition`` flattens no further than
    that limit allows, and not at all where natural weights already exceed it.  With both, the
    greater exponent holds.  With ``budget`` None the budget is the least that gives every
    source one epoch at least.  Sources without tokens get nothing.  Weights are rounded to nine places.
    """
    if target_entropy is None and max_repetition is None:
        raise ValueError("give a target entropy or a repetition limit")
    some = sources.where("tokens > 0")
    total = some.agg(F.sum("tokens"), F.count("*")).first()
    if not total[0]:
        return some.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("source_budget"))
    shares = some.withColumn("share", F.col("tokens") / F.lit(total[0]))
    exponent = 0.0
    if target_entropy is not None:
        # ln(sum w) - sum(w ln w) / sum w: the entropy of w / sum w
        entropy = (F.log(F.sum("w")) - F.sum(F.col("w") * F.log("w")) / F.sum("w")).alias("entropy")
        target = F.lit(float(target_entropy)) * F.log(F.lit(float(total[1])))
        exponent = _bisect(shares, MAX_EXPONENT, F.col("entropy") >= target - 1e-12, [entropy])
    if max_repetition is not None:
        if budget is None:                  # the largest w / tokens against the least
            most = (F.max(F.col("w") / F.col("tokens")) / F.min(F.col("w") / F.col("tokens")))
        else:
            most = F.max(F.col("w") / F.col("tokens")) * F.lit(float(budget)) / F.sum("w")
        # repetition falls as the exponent grows to 1: the last exponent over the limit
        over = _bisect(shares, 1.0, F.col("most") > float(max_repetition) + 1e-12, [most.alias("most")])
        exponent = max(exponent, over)
    w = shares.withColumn("w", F.pow("share", F.lit(exponent)))
    sums = w.agg(F.sum("w").alias("all"), F.max(F.col("tokens") / F.col("w")).alias("reach")).first()
    weighted = w.withColumn("weight", F.round(F.col("w") / F.lit(sums["all"]), 9))
    amount = float(budget) if budget is not None else sums["reach"] * sums["all"]
    given = F.round(F.col("weight") * F.lit(amount)).cast("long")
    if budget is None:                      # rounding must not cost a source its one epoch
        given = F.greatest(given, F.col("tokens"))
    return weighted.select("source", "tokens", "weight", given.alias("source_budget"))


def epoch_cuts(docs: DataFrame, weights: DataFrame, seed: int) -> DataFrame:
    """``source, epochs, cut``: whole epochs, and the last order key taken of one more (null: none).

    ``docs(doc_id, source, n_tokens)``; a document of that epoch is taken while the tokens of the
    keys before its own fall short of the budget left.
    """
    plan = weights.where("source_budget > 0").select(
        "source", F.expr("source_budget div tokens").alias("epochs"),
        (F.col("source_budget") % F.col("tokens")).alias("rest"))
    keyed = (docs.join(plan.where("rest > 0"), docs["source"].eqNullSafe(plan["source"]))
             .select(plan["source"], "epochs", "rest", "n_tokens",
                     order_key(seed, F.col("epochs"), F.col("doc_id")).alias("key")))
    width = HASH_BITS
    open_ = keyed                           # rows of the block that holds the cut, of every source
    for _ in range(2):
        width -= 12
        block = F.shiftright("key", width)
        sums = (open_.groupBy("source", block.alias("block"))
                .agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest")))
        # at most BLOCKS rows a source
        before = F.sum("n").over(Window.partitionBy("source").orderBy("block")
                                 .rowsBetween(Window.unboundedPreceding, -1))
        last = (sums.withColumn("before", F.coalesce(before, F.lit(0))).where("before < rest")
                .groupBy("source").agg(F.max("block").alias("block"),
                                       F.max_by("before", "block").alias("before")))
        last = last.select(F.col("source").alias("s"), F.col("block").alias("b"), "before")
        open_ = stored(open_.join(last, open_["source"].eqNullSafe(F.col("s")) & (block == F.col("b")))
                       .select("source", "epochs", (F.col("rest") - F.col("before")).alias("rest"), "n_tokens", "key"),
                       "mix-block")
    # the cut block is 1 / BLOCKS ** 2 of a source; equal keys are taken together
    ties = open_.groupBy("source", "rest", "key").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1))
    cut = (ties.withColumn("before", F.coalesce(before, F.lit(0))).where("before < rest")
           .groupBy("source").agg(F.max("key").alias("cut")).withColumnRenamed("source", "s"))
    return plan.join(cut, plan["source"].eqNullSafe(F.col("s")), "left").select("source", "epochs", "cut")


def mix(docs: DataFrame, budget: int | None = None, target_entropy: float | None = None,
        max_repetition: float | None = None, seed: int = 1) -> DataFrame:
    """``docs`` mixed to target weights: a row for each copy taken, with all columns of ``docs`` (but those
    named like one of the following) and ``mix_tokens``, ``mix_weight``, ``mix_epoch`` (from 0), ``mix_block`` (of the epoch's order) and ``mix_key``.

    Read each source in the order of (mix_epoch, mix_key).  A null source is a source like any other; a null
    or empty text counts no token and is taken where its key comes before the cut; rows with
    equal ids share their place.  A source without tokens yields nothing, an empty table
    an empty result.  ``budget`` is in words; see ``mixing_weights`` for the rest.
    """
    narrow = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                                word_count(F.col("text").cast("string")).alias("n_tokens")), "mix-sizes")
    weights = stored(mixing_weights(source_tokens(narrow), budget, target_entropy, max_repetition), "mix-weights")
    cuts = epoch_cuts(narrow, weights, seed)
    # one row per source
    per_source = stored(weights.join(cuts.withColumnRenamed("source", "s"), weights["source"].eqNullSafe(F.col("s")))
                        .select(F.col("source").alias("mix_source"), F.col("weight").alias("mix_weight"),
                                F.col("epochs").alias("mix_epochs"), F.col("cut").alias("mix_cut")), "mix-cuts")
    doc_id = F.col("doc_id").cast("long")
    partial = F.col("mix_cut").isNotNull() & (order_key(seed, F.col("mix_epochs"), doc_id) <= F.col("mix_cut"))
    copies = F.col("mix_epochs") + F.when(partial, 1).otherwise(0)
    key = order_key(seed, F.col("mix_epoch"), doc_id)
    rows, restored = shielded(docs, "doc_id", "text", "source")
    new = ["mix_tokens", "mix_weight", "mix_epoch", "mix_block", "mix_key"]
    return (rows.join(per_source, F.col("source").cast("string").eqNullSafe(F.col("mix_source")))
            .withColumn("mix_copies", copies).where("mix_copies > 0")
            .withColumn("mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("mix_copies") - 1)))
            .withColumn("mix_key", key)
            .withColumn("mix_block", F.shiftright("mix_key", HASH_BITS - 12))
            .withColumn("mix_tokens", word_count(F.col("text").cast("string")))
            .select(*[c for c, name in zip(restored, docs.columns, strict=True) if name not in new], *new))


__all__ = ["mix", "mixing_weights", "epoch_cuts", "source_tokens", "order_key", "word_count"]
