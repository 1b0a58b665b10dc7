"""Token-ID output: Parquet files of encoded documents that can be read selectively.

Documents are dealt into ascending ranges of ``doc_id``, one range per file.  A file holds
``shard`` (the range), ``doc_id``, ``shard_start`` (ids of the shard's earlier documents),
``n_tokens`` and ``ids`` (a list of 32-bit ids, end id included):

* the integer columns are delta-encoded (Parquet v2 pages, dictionary off);
* ``ids`` is dictionary-encoded, as a vocabulary is small beside the ids it encodes;
* row groups are bounded by ``ROW_GROUP_BYTES`` and pages by ``PAGE_BYTES`` and ``PAGE_ROWS``;
  Parquet's column and offset indexes come with each page, so a filter on ``doc_id`` reads only
  the pages it hits, and the offsets of all documents can be read without reading any id.

White space never joins two tokens of a word-level vocabulary: the encoding of a text is the
concatenation of those of its words.  So the words of some ``SLICE_BYTES`` of text are looked up by
distinct word, and laid out by their numbers (tested against whole texts).  Where a tokenizer cuts
words as ``CUTS`` says, those of printable ASCII and Latin-1 letters are cut here and only their pieces
go to the library's model, many in a call; all other words and tokenizers go through the whole of it.
Each worker keeps the ids of up to ``CACHED_PIECES`` pieces and such words, which changes no result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runready.llm.tables import worker_cache
from runready.session import shared_path

ROW_GROUP_BYTES = 32 * 1024 * 1024
PAGE_BYTES = 256 * 1024
PAGE_ROWS = 2_000
CACHED_PIECES = 700_000
CALL_KEYS = 5_000
SLICE_BYTES = 8 * 1024 * 1024
BATCH_ROWS = 256

WRITER = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.size": str(PAGE_BYTES),
    "parquet.page.row.count.limit": str(PAGE_ROWS),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#shard": "false",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#shard_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}

# The cutting of words that ``WordEncoder`` knows, as a tokenizer file states it: NFC and lower case, then these pieces, then
# bytes as characters.  Printable ASCII and the letters of Latin-1 are their own NFC and have lower case of one letter each.
CUTS = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None, "truncation": None, "padding": None,
}
PLAIN = "^[!-~À-ÖØ-öø-ÿ]*$"
PIECES = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|\n|'(?:s|t|re|ve|m|ll|d)|[^a-z0-9ß-öø-ÿ\n]+")     # of words in lines

FILE_SCHEMA = "shard int, doc_id long, shard_start long, n_tokens long, ids array<int>"


class WordEncoder:
    """Encodes texts word by word."""

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = WhitespaceSplit()
        with open(tokenizer_path, encoding="utf-8") as f:
            said = json.load(f)
        added = said.get("added_tokens") or []
        self.added = [t["content"] for t in added]          # these are found before words are cut
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.as_bytes = {k: as_bytes.pre_tokenize_str(chr(k))[0][0] for k in range(0xC0, 0x100)}
        # the last token of a piece, and no other, ends with the suffix; every byte has a token, so none is left out
        model, vocab = said["model"], self.tokenizer.get_vocab(with_added_tokens=False)
        suffix = model.get("end_of_word_suffix")
        self.cuts = (all(said.get(part) == CUTS[part] for part in CUTS) and not any(t["normalized"] for t in added)
                     and model.get("type") == "BPE" and bool(suffix)
                     and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges"))
                     and all(c in vocab and c + suffix in vocab for c in ByteLevel.alphabet()))
        self.last = np.zeros(max(vocab.values(), default=0) + 1, bool)
        if self.cuts:
            self.last[[k for token, k in vocab.items() if token.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        """Empties the table of ids, whose number 0 has none and stands for a line's end."""
        self.pieces: dict[str, int] = {}
        self.parts, self.counts = [np.zeros(0, "<u4")], [np.zeros(1, np.int64)]
        self.ids, self.starts, self.lengths = self.parts[0], self.counts[0], self.counts[0]

    def encode(self, text: str | bytes) -> bytes:
        """Little-endian unsigned 32-bit ids of one text."""
        return self.encode_all(pa.array([text if isinstance(text, str) else text.decode()], pa.string()))[0].tobytes()

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one text after another, and the number of ids of each (null: none)."""
        # splits at the six ASCII white-space characters only: the tokenizer keeps some that str.split() drops
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = split.flatten().dictionary_encode()
        if not len(words):
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        at = words.indices.to_numpy()
        table, starts, lengths = self._words(words.dictionary)
        ids, ends = _laid(table, starts[at], lengths[at])
        bounds = split.offsets.to_numpy()
        return ids, np.diff(np.concatenate([[0], ends])[bounds - bounds[0]])

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words, where each word's start and how many they are."""
        plain = np.zeros(len(words), bool)
        if self.cuts:
            plain = pc.match_substring_regex(words, PLAIN).to_numpy(zero_copy_only=False)
            for token in self.added:
                plain = plain & ~pc.match_substring(words, token).to_numpy(zero_copy_only=False)
        starts, lengths = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        ids = np.zeros(0, "<u4")
        if plain.any():
            kept = words.filter(pa.array(plain))
            lines = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept), "\n")[0].as_py()
            numbers = self._numbers(PIECES.findall(lines.lower()))
            ids, ends = _laid(self.ids, self.starts[numbers], self.lengths[numbers])
            line_ends = np.append(np.flatnonzero(numbers == 0), len(numbers))
            word_ends = np.concatenate([[0], ends])[line_ends]
            lengths[plain] = np.diff(word_ends, prepend=0)
            starts[plain] = word_ends - lengths[plain]
        if not plain.all():
            # a space before a whole word tells it from a piece
            numbers = self._numbers([" " + word for word in words.filter(pa.array(~plain)).to_pylist()])
            whole, ends = _laid(self.ids, self.starts[numbers], self.lengths[numbers])
            lengths[~plain] = self.lengths[numbers]
            starts[~plain] = len(ids) + ends - lengths[~plain]
            ids = np.concatenate([ids, whole])
        return ids, starts, lengths

    def _numbers(self, keys: list[str]) -> np.ndarray:
        """Numbers of pieces and whole words in the table, learnt where they are new; 0 for a line's end."""
        distinct = set(keys)
        distinct.discard("\n")
        new = distinct.difference(self.pieces)
        if len(self.pieces) + len(new) > CACHED_PIECES:
            self._forget()
            new = distinct
        whole, cut = [key for key in new if key[0] == " "], [key for key in new if key[0] != " "]
        for at in range(0, len(whole), CALL_KEYS):
            self._learn_whole(whole[at:at + CALL_KEYS])
        for at in range(0, len(cut), CALL_KEYS):
            self._learn_cut(cut[at:at + CALL_KEYS])
        if new:
            self.ids, lengths = np.concatenate(self.parts), np.concatenate(self.counts)
            self.parts, self.counts = [self.ids], [lengths]
            self.starts, self.lengths = np.cumsum(lengths) - lengths, lengths
        return np.fromiter(map(self.pieces.get, keys, repeat(0)), np.int64, len(keys))

    def _learn_whole(self, keys: list[str]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast([key[1:] for key in keys], add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        self._learn(keys, np.fromiter(chain.from_iterable(found), "<u4", int(lengths.sum())), lengths)

    def _learn_cut(self, keys: list[str]) -> None:
        chars = [key if key.isascii() else key.translate(self.as_bytes) for key in keys]
        # only this call gives ids without offsets and tokens
        ids = np.array(self.bare.encode_batch_fast([" ".join(chars)], add_special_tokens=False)[0].ids, "<u4")
        self._learn(keys, ids, np.diff(np.flatnonzero(self.last[ids]), prepend=-1))

    def _learn(self, keys: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        first = len(self.pieces) + 1
        self.pieces.update(zip(keys, range(first, first + len(lengths)), strict=True))
        self.parts.append(ids)
        self.counts.append(lengths)


def _laid(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``ids`` with these starts and lengths, one after another, and where each ends."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return ids[np.repeat(starts - ends + lengths, lengths) + np.arange(total)], ends


def _encoder(path: str) -> WordEncoder:
    def make() -> WordEncoder:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"     # Spark runs one task per core already
        return WordEncoder(path)
    return worker_cache(path, make)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2) -> None:
    """Encode every whole text of ``docs`` and write the token files to ``path``.

    ``tokenizer_path`` names a ``tokenizers`` JSON file that splits words at white space and is
    present on every executor.  A null text counts as empty (it yields the end id alone); null ids
    come first; rows with the same id are ordered by text, and equal rows are all kept.  Other
    columns are not read.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer_path)
        start = 0
        for whole in batches:
            sizes = pc.fill_null(pc.binary_length(whole.column("text")), 0).to_numpy().astype(np.int64)
            cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // SLICE_BYTES, prepend=-1))
            for at, until in zip(cuts, [*cuts[1:], whole.num_rows], strict=True):
                batch = whole.slice(at, until - at)
                ids, n = enc.encode_all(batch.column("text"))
                ids = np.insert(ids, np.cumsum(n), end_id)
                n = n + 1
                ends = np.cumsum(n)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.view("<i4")))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("shard"), batch.column("doc_id"), pa.array(start + ends - n), pa.array(n), lists],
                    names=["shard", "doc_id", "shard_start", "n_tokens", "ids"])
                start += int(ends[-1])

    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
     .repartitionByRange(F.col("doc_id").asc_nulls_first())
     .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
     .withColumn("shard", F.spark_partition_id())
     .mapInArrow(encode, FILE_SCHEMA)
     .write.options(**WRITER).parquet(path))


def token_offsets(spark: SparkSession, path: str) -> DataFrame:
    """``shard, shard_base``: ids in all earlier shards, from the count column alone.

    One row per file, so the ordered window over it holds as many rows as there are files.
    """
    from pyspark.sql.window import Window
    sizes = spark.read.schema(FILE_SCHEMA).parquet(path).groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_base"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The token files: ``doc_id, start, n_tokens, ids`` (``start``: ids of all documents before it)."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    return files.join(token_offsets(spark, path), "shard").select(
        "doc_id", (F.col("shard_base") + F.col("shard_start")).alias("start"), "n_tokens", "ids")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files at ``path``."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            offsets = ids.offsets.to_numpy()
            values = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<i4")).cast("B")
            crc = [zlib.crc32(values[4 * a:4 * z]) for a, z in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("shard"), b.column("doc_id"), b.column("shard_start"), b.column("n_tokens"),
                 pa.array(crc, pa.int64())],
                names=["shard", "doc_id", "shard_start", "n_tokens", "ids_crc32"])

    digests = spark.read.schema(FILE_SCHEMA).parquet(path).mapInArrow(
        digest, "shard int, doc_id long, shard_start long, n_tokens long, ids_crc32 long")
    return digests.join(token_offsets(spark, path), "shard").select(
        "doc_id", (F.col("shard_base") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")


def tokenize_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and return their digests, read from the files."""
    spark = docs.sparkSession
    # ids of one read batch are held at once: keep batches of long documents small
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(BATCH_ROWS))
    path = shared_path(spark, "tokens")
    write_tokens(docs, path, tokenizer_path, end_id)
    return token_digests(spark, path)


__all__ = ["write_tokens", "read_tokens", "token_offsets", "token_digests", "tokenize_documents", "WordEncoder"]
