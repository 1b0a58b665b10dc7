"""Fill-in-middle transformation with cuts found by a Fenwick tree over text blocks.

A text is a run of units, matched left to right: code points, or the matches of a pattern (the text between two
matches belongs to the unit before it, what stands before the first one to the first).  Its UTF-8 bytes lie in fixed
blocks of ``BLOCK`` bytes; a Fenwick tree over the blocks holds how many units and how many code points start in each.
To cut before unit k, a binary-lifting descent finds the block in which that unit starts and the units and code points
before the block, and only this block is looked at byte by byte.

Cuts and forms follow the sha256 of ``seed:doc_id``, so they depend on nothing but the row: the job is one map
over the documents, without a shuffle, and repeats itself after a lost executor.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1024
CODE_POINT = None                                   # the unit of ``transform`` unless a pattern is given
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"     # fixed sentinels


def code_point_starts(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 ``data`` start a code point: all but the continuation bytes."""
    return (data & 0xC0) != 0x80


class CutIndex:
    """Finds the byte at which unit k of a text starts, and the code points before it."""

    def __init__(self, text: bytes, unit: re.Pattern[bytes] | None = CODE_POINT):
        data = np.frombuffer(text, np.uint8)
        points = code_point_starts(data)
        if unit is CODE_POINT:
            starts = points
        else:
            starts = np.zeros(len(data), bool)
            starts[[m.start() for m in unit.finditer(text) if m.end() > m.start()]] = True
        self.data, self.starts = data, starts
        edges = np.arange(0, len(data), BLOCK)
        counts = np.stack([np.add.reduceat(x, edges, dtype=np.int64) if len(edges) else np.empty(0, np.int64)
                           for x in (starts, points)], axis=1)
        self.blocks = len(edges)
        self.units, self.points = (int(x) for x in counts.sum(0))
        # node i of the tree holds the sums of blocks i - (i & -i) + 1 .. i
        before = np.zeros((self.blocks + 1, 2), np.int64)
        np.cumsum(counts, axis=0, out=before[1:])
        node = np.arange(self.blocks + 1)
        self.tree = before - before[node - (node & -node)]

    def cut(self, k: int) -> tuple[int, int]:
        """``(byte, code points before it)`` of the start of unit ``k``; of the end of the text where k is the number
        of units, and of the start of the text for unit 0."""
        if k <= 0:
            return 0, 0
        if k >= self.units:
            return len(self.data), self.points
        at, units, points = 0, 0, 0
        step = 1 << (self.blocks.bit_length() - 1)
        while step:
            if at + step <= self.blocks and units + self.tree[at + step, 0] <= k:
                at += step
                units += int(self.tree[at, 0])
                points += int(self.tree[at, 1])
            step >>= 1
        low = at * BLOCK
        start = low + int(np.flatnonzero(self.starts[low:low + BLOCK])[k - units])
        return start, points + int(np.count_nonzero(code_point_starts(self.data[low:start])))


def arranged(prefix: bytes, middle: bytes, suffix: bytes, form: str) -> bytes:
    if form == "psm":
        return PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    return SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle


def restored(output: bytes, form: str) -> bytes:
    """The text of an output: sentinels stand in no transformed text, so each is found once."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    mid, end = output.index(second), output.index(MIDDLE)
    one, two, middle = output[len(first):mid], output[mid + len(second):end], output[end + len(MIDDLE):]
    return one + middle + two if form == "psm" else two + middle + one


def choose(key: str, units: int, plain: bool, rate: int, spm: int) -> tuple[str, int, int]:
    """``(form, first cut, second cut)`` from the first four 32-bit groups of the key's sha256."""
    digest = hashlib.sha256(key.encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(digest[k:k + 4], "big") for k in range(0, 16, 4))
    a, b = sorted((h1 % (units + 1), h2 % (units + 1)))
    if plain or h3 % 100 >= rate:
        return "plain", a, b
    return ("spm" if h4 % 100 < spm else "psm"), a, b


def transform(docs: DataFrame, seed: int = 1, rate: int = 90, spm: int = 20, unit: str | None = CODE_POINT,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output, restored`` of every row of ``docs``.

    ``n`` counts units: code points, or matches of the pattern ``unit`` (over UTF-8 bytes; empty matches do not
    count).  ``rate`` per cent of the texts are transformed, ``spm`` per cent of these with the suffix first.  A text that is
    null, empty or has no unit, or that contains a sentinel, stays plain: ``output`` is the text, and ``prefix_chars`` and ``middle_chars``
    are null.  Rows with the same id are cut by the same hashes, a null id hashes as the empty string; all rows are
    kept and other columns are not read.  ``output`` and ``restored`` are the whole texts.
    """
    pattern = None if unit is None else re.compile(unit.encode(), re.DOTALL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = (text.as_py() or b"")
                index = CutIndex(text, pattern)
                plain = not index.units or PREFIX in text or SUFFIX in text or MIDDLE in text
                key = f"{seed}:{'' if doc is None else doc}"
                form, a, b = choose(key, index.units, plain, rate, spm)
                if form == "plain":
                    rows.append((doc, index.units, form, None, None, text, text))
                    continue
                (first, before), (second, upto) = index.cut(a), index.cut(b)
                output = arranged(text[:first], text[first:second], text[second:], form)
                rows.append((doc, index.units, form, before, upto - before, output, restored(output, form)))
            types = (batch.schema.types[0], pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            columns = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                             names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary, restored binary"
    return rows.mapInArrow(run, schema).withColumns({
        "output": F.col("output").cast("string"), "restored": F.col("restored").cast("string")})


def digests(out: DataFrame) -> DataFrame:
    """The transformed rows with the sha256 of ``output`` and ``restored`` (UTF-8) in place of the texts."""
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                      F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                      F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))


__all__ = ["transform", "digests", "CutIndex", "arranged", "restored", "choose"]
