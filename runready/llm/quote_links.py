"""Quotation linking: reply-ordered conversations without quotes, with DataFrame functions alone.

1. A message is cut into passages: lines that follow each other at one quote level (the number of
   ``>`` marks before the text; 0 is the author's own).  A passage yields units to match by: its paragraphs
   and its lines, normalised (lower case, runs of anything but letters and digits become one space) and hashed.
2. Units that authors wrote themselves are reduced to the first turn of the conversation that has them: one row
   per (conversation, hash), so that a line which many messages share, or quote, joins with one row.
3. A quoted unit is linked to that turn if it is an earlier one.  A message replies to the turn with
   the most quoted characters at its lowest linked quote level (ties: the later turn).
4. Replies are followed to the first message of their thread by pointer doubling: rounds grow with the
   logarithm of the depth, and no conversation is gathered in one task.

Reading a conversation in the order of (thread_root, turn) gives its threads one after the other, in
reply order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runready.llm.tables import stored

QUOTE = r"^(?:[ \t]*>)+[ \t]?"
# a line that announces the quote after it, up to the passage mark
ATTRIBUTION = r"(?:\n|(?<=\x1F))[^\n\x1E\x1F]*\b(?:wrote|writes|said)[ \t]*:[ \t]*\n*(?=\x1E[1-9])"
MAX_ROUNDS = 64              # doubles the depth followed each time


def _marks(line: Column) -> Column:
    """Quote level of a line."""
    prefix = F.regexp_extract(line, r"^((?:[ \t]*>)*)", 1)
    return F.length(prefix) - F.length(F.replace(prefix, F.lit(">")))


def passages(text: Column) -> Column:
    """``array<struct<level, text>>`` of a message: runs of lines at one quote level, without the marks."""
    clean = F.translate(F.regexp_replace(text, r"\r\n?", "\n"), "\x1e\x1f", "  ")
    lines = F.split(clean, "\n", -1)
    pairs = F.arrays_zip(lines.alias("line"),
                         F.concat(F.array(F.lit(None).cast("string")), F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))))
                         .alias("before"))
    body = lambda p: F.regexp_replace(p["line"], QUOTE, "")
    new = lambda p: p["before"].isNull() | (_marks(p["line"]) != _marks(p["before"]))
    marked = F.array_join(F.transform(pairs, lambda p: F.when(
        new(p), F.concat(F.lit("\x1e"), _marks(p["line"]).cast("string"), F.lit("\x1f"), body(p)))
        .otherwise(F.concat(F.lit("\n"), body(p)))), "")
    marked = F.regexp_replace(marked, ATTRIBUTION, "")
    return F.transform(F.filter(F.split(marked, "\x1e"), lambda x: x != ""), lambda x: F.struct(
        F.substring_index(x, "\x1f", 1).cast("int").alias("level"), F.substring_index(x, "\x1f", -1).alias("text")))


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def units(text: Column) -> Column:
    """Distinct normalised paragraphs and lines of a passage, without empty ones."""
    parts = F.concat(F.split(text, r"\n[ \t]*\n"), F.split(text, "\n"))
    return F.filter(F.array_distinct(F.transform(parts, normalised)), lambda u: u != "")


def reply_links(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, reply_to, level, quoted_chars``: a row per message whose quotes were found."""
    cut = messages.where("conv_id is not null and turn is not null and text is not null")
    rows = (cut.select("conv_id", "turn", F.explode(passages(F.col("text"))).alias("p"))
            .select("conv_id", "turn", F.col("p.level").alias("level"), F.explode(units(F.col("p.text"))).alias("unit"))
            .select("conv_id", "turn", "level", F.xxhash64("unit").alias("hash"), F.length("unit").alias("chars")))
    quoted = rows.where("level > 0")
    own = rows.where("level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))
    # a conversation without a quote needs no origins
    own = stored(own.join(quoted.select("conv_id").distinct(), "conv_id", "left_semi"), "origins")
    votes = (quoted.join(own, ["conv_id", "hash"]).where("origin < turn")
             .groupBy("conv_id", "turn", "level", "origin").agg(F.sum("chars").alias("chars")))
    best = F.max(F.struct((-F.col("level")).alias("up"), "chars", "origin")).alias("b")
    return votes.groupBy("conv_id", "turn").agg(best).select(
        "conv_id", "turn", F.col("b.origin").alias("reply_to"), (-F.col("b.up")).alias("level"),
        F.col("b.chars").alias("quoted_chars"))


def _followed(links: DataFrame) -> DataFrame:
    """``conv_id, turn, reply_to, thread_root, depth`` by pointer doubling over ``reply_to``."""
    now = stored(links.select("conv_id", "turn", "reply_to", F.col("reply_to").alias("up"), F.lit(1).alias("depth")), "up")
    for _ in range(MAX_ROUNDS):
        above = now.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"))
        step = now.join(above, ["conv_id", "up"], "left")
        if not step.where("further is not null").limit(1).count():
            return now.withColumnRenamed("up", "thread_root")
        now = stored(step.select("conv_id", "turn", "reply_to", F.coalesce("further", "up").alias("up"),
                                 (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "up")
    raise RuntimeError(f"replies deeper than 2 ** {MAX_ROUNDS}")


def conversations(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, reply_to, thread_root, depth`` for every row of
    ``messages(conv_id, turn, role, text)``.

    ``text`` is the author's own: quotes and the lines that announce them are gone, blank lines at its ends too.
    A message that quotes nothing known has no ``reply_to`` and is its own ``thread_root`` at depth 0.
    A null text stays null; rows with a null conversation or turn stay and are linked to nothing; rows with the same
    conversation and turn are read as one message for linking and each keep their text.  Other columns are not read.
    """
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                           F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    followed = stored(_followed(reply_links(rows)), "threads")
    own = F.array_join(F.transform(F.filter(passages(F.col("text")), lambda p: p["level"] == 0), lambda p: p["text"]), "\n")
    return (rows.join(followed, ["conv_id", "turn"], "left")
            .select("conv_id", "turn", "role", F.regexp_replace(own, r"^(?:[ \t]*\n)+|(?:\n[ \t]*)+$", "").alias("text"),
                    "reply_to", F.coalesce("thread_root", "turn").alias("thread_root"),
                    F.coalesce("depth", F.lit(0)).alias("depth")))


__all__ = ["conversations", "reply_links", "passages", "units", "normalised"]
