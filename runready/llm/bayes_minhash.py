"""MinHash near-duplicate groups with sequential Bayesian verification.

1. A document's set is its distinct ``shingle``-word shingles, as 64-bit hashes (fewer words: the
   whole sequence is the one member; no word: empty, linked with nothing).  One pass over the texts
   yields set size, a 128-bit hash of the set, ``BANDS`` band keys of ``ROWS`` minima and the signature.
   Documents with the same set form a class; only its smallest id goes on.
2. Classes that share a band key are candidates.  First each one meets its bucket's leaders (its
   smallest id and the least under two hashes): as many pairs as bucket rows, however large a bucket is.
3. A pair's signatures are compared ``BATCH`` minima at a time.  With a uniform prior, m matches of n
   give the similarity the posterior Beta(m + 1, n - m + 1); the pair goes as soon as the
   probability that its similarity reaches the threshold falls under ``MISS``.
   The others are verified exactly on the full sets, leader by leader: a text is sent once for each of its leaders, a leader's
   once for each ``STAR`` of its candidates.
4. The links join classes to components.  Only buckets with members of several components hold pairs
   that can still change the answer: those across components.  Such a bucket is cut into chunks, and every two
   chunks meet in a cell of bounded size.  A cell compares signatures as in 3, each pair in the first band it shares alone;
   what the test keeps is verified on the full sets of the members concerned, and a pair whose members have come together
   by then is passed over.  No pair is ever a row: a cell gives out the links that joined something, fewer than its members.
   (A bucket of many members that are no copies of each other is still compared in full, in proportion to the square
   of its size, spread over its cells.)
5. Components of all links give the result.

A pair at similarity s is no candidate with probability (1 - s^ROWS)^BANDS: 5e-6 at 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runready.functions.joins import broadcast_if_small
from runready.llm.components import connected_components
from runready.llm.tables import ascii_words, stored, worker_cache

BANDS, ROWS = 40, 6
HASHES = BANDS * ROWS
BATCH = 48                   # minima compared before each look at the posterior
MISS = 1e-7                  # chance of dropping a true link at one look
LEADERS = 3
CACHED_WORDS = 300_000
CHUNK = 512                  # shingles hashed at once: bounds the memory of very long texts
CELL = 4096                  # members of one chunk of a bucket, about
CELL_SHINGLES = 2_000_000    # and their shingles: bounds the text that a task holds
STAR = 1024                  # candidates verified together with one leader

_rng = np.random.default_rng(20240229)
_MULT = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_BAND = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class ShingleHasher:
    """Sorted distinct shingle hashes of a text; keeps the hashes of words it has met."""

    def __init__(self, shingle: int):
        self.shingle, self.words = shingle, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = ascii_words(text) if text else []
        if not words:
            return np.empty(0, np.uint64)
        if len(self.words) > CACHED_WORDS:
            self.words = {}
        known = self.words
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.shingle, len(words))
        size = len(words) - n + 1
        s = np.full(size, n, np.uint64)
        for k in range(n):
            s = _mix(s * np.uint64(31) + h[k:k + size])
        return np.unique(s)


def signature(members: np.ndarray) -> np.ndarray:
    """``HASHES`` minima of the members' 32-bit hashes."""
    x = (members >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), CHUNK):
        np.minimum(least, (x[at:at + CHUNK, None] * _MULT + _ADD).min(0), out=least)
    return least


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, different between bands."""
    s = _BAND.copy()
    for column in sig.reshape(BANDS, ROWS).T:
        s = _mix(s * np.uint64(31) + column)
    return s.view(np.int64)


def least_matches(threshold: float) -> list[int]:
    """For each look (``BATCH``, 2 ``BATCH``, ... minima) the fewest matches that keep a pair.

    P(similarity >= t | m of n) under the posterior Beta(m + 1, n - m + 1) is
    P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, -1
        while total < MISS:
            m += 1
            total += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def _sketch(docs: DataFrame, shingle: int) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = worker_cache(("shingles", shingle), lambda: ShingleHasher(shingle))
        for part in parts:
            for at in range(0, len(part), 512):
                rows = []
                some = part.iloc[at:at + 512]
                for doc, own, text in zip(some["doc_id"], some["id"].astype("Int64"), some["text"], strict=True):
                    s = shingles(text)
                    if not len(s):
                        rows.append((doc, own, 0, None, None, None, None))
                        continue
                    sig, digest = signature(s), xxhash.xxh3_128_digest(s.tobytes())
                    high, low = np.frombuffer(digest, ">i8")
                    rows.append((doc, own, len(s), int(high), int(low), band_keys(sig).tolist(), sig.tobytes()))
                out = pd.DataFrame(rows, columns=["doc_id", "id", "n_shingles", "high", "low", "bands", "sig"])
                yield out.astype({"id": "Int64", "high": "Int64", "low": "Int64"})

    return docs.select("doc_id", "id", "text").mapInPandas(
        run, "doc_id long, id long, n_shingles long, high long, low long, bands array<long>, sig binary")


def row_key() -> Column:
    """What tells rows apart here: a hash of id and text, so that rows that share an id, or have none, are rows of their own."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _unpruned(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """Pairs that the sequential test keeps.  ``sketches(doc_id, sig)``: one row per class."""
    sig = sketches.select("doc_id", "sig")
    looks = least_matches(threshold)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if not len(part):
                continue
            left = np.frombuffer(b"".join(part["sig_a"]), np.uint32).reshape(len(part), HASHES)
            right = np.frombuffer(b"".join(part["sig_b"]), np.uint32).reshape(len(part), HASHES)
            alive, matches = np.arange(len(part)), np.zeros(len(part), np.int64)
            for look, least in enumerate(looks):
                cols = slice(look * BATCH, (look + 1) * BATCH)
                matches[alive] += (left[alive, cols] == right[alive, cols]).sum(1)
                alive = alive[matches[alive] >= least]
            yield part[["a", "b"]].iloc[alive]

    return (pairs.join(sig.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a")), "a")
            .join(sig.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b")), "b")
            .select("a", "b", "sig_a", "sig_b").mapInPandas(run, "a long, b long"))


def _stars(pairs: DataFrame) -> DataFrame:
    """``pairs(a, b)`` as cells around each ``b`` (see ``_cell_links``): a member has one row, the centre one in each cell."""
    cells = F.ceil(F.count("*") / STAR).cast("int")
    dealt = (pairs.join(pairs.groupBy("b").agg(cells.alias("cells")), "b")
             .select(F.col("b").alias("bucket"), F.pmod(F.xxhash64("a"), F.col("cells")).cast("int").alias("i"), "a"))
    centres = dealt.select("bucket", "i").distinct()
    return (dealt.select("bucket", "i", F.col("a").alias("doc_id"), F.array("bucket").alias("others"))
            .unionByName(centres.select("bucket", "i", F.col("bucket").alias("doc_id"), F.array().cast("array<long>").alias("others")))
            .withColumns({"j": F.lit(0), "label": F.col("doc_id")}))


def _cells(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """``members(bucket, doc_id, ...)`` in the cells of their buckets: one row for each cell ``(bucket, i, j)`` of a member.

    ``sizes(bucket, n, shingles)``.  A bucket within ``CELL`` and ``CELL_SHINGLES`` is one cell; a larger one has a cell for
    each two of its chunks.
    """
    chunks = F.greatest(F.ceil(F.col("n") / CELL), F.ceil(F.col("shingles") / CELL_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("doc_id", "bucket"), F.col("chunks")).cast("int")
    dealt = (members.join(sizes.select("bucket", chunks.alias("chunks")), "bucket").withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))))
    return dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("chunks", "other")


def _runs(parts: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of each key of sorted frames, as one frame."""
    held: list[pd.DataFrame] = []
    for part in parts:
        if not len(part):
            continue
        new = (part[key] != part[key].shift()).any(axis=1).to_numpy()
        new[0] = not held or any(held[-1][k].iloc[-1] != part[k].iloc[0] for k in key)
        edges = np.append(np.flatnonzero(new), len(part))
        if len(edges) == 1:                                       # all of it goes on with the last key
            held.append(part)
            continue
        if edges[0]:
            held.append(part.iloc[:edges[0]])
        if held:
            yield pd.concat(held) if len(held) > 1 else held[0]
        for a, z in zip(edges[:-2], edges[1:-1], strict=True):
            yield part.iloc[a:z]
        held = [part.iloc[edges[-2]:]]
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _cell_candidates(cells: DataFrame, threshold: float) -> DataFrame:
    """``bucket, i, j, doc_id, label, others``: for each member of a cell the smaller ids that the sequential test keeps with it.

    Every member of such a pair has a row; members without a pair have none.
    """
    looks = least_matches(threshold)

    def kept(group: pd.DataFrame) -> list[tuple[int, int]]:
        ids, label, n = (group[c].to_numpy() for c in ("doc_id", "label", "n_shingles"))
        band, own, i, j = group["band"].iloc[0], group["own"].to_numpy(), group["i"].iloc[0], group["j"].iloc[0]
        sig = np.frombuffer(b"".join(group["sig"]), np.uint32).reshape(len(group), HASHES)
        out = []
        for a in range(1, len(group)):
            b = np.arange(a)
            ok = (label[b] != label[a]) & (np.minimum(n[b], n[a]) >= threshold * np.maximum(n[b], n[a]))
            if i != j:
                ok &= own[b] != own[a]                            # pairs of one chunk have a cell of their own
            b, matches = b[ok], 0
            for look, least in enumerate(looks):
                if not len(b):
                    break
                cols = slice(look * BATCH, (look + 1) * BATCH)
                matches = matches + (sig[b, cols] == sig[a, cols]).sum(1)
                stay = matches >= least
                b, matches = b[stay], matches[stay]
            if len(b):
                shared = (sig[b].reshape(len(b), BANDS, ROWS) == sig[a].reshape(BANDS, ROWS)).all(2)
                out += [(a, int(x)) for x in b[shared.argmax(1) == band]]
        return out

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _runs(parts, ["bucket", "i", "j"]):
            pairs = kept(group)
            if not pairs:
                continue
            ids, others = group["doc_id"].to_numpy(), {}
            for a, b in pairs:
                high, low = max(ids[a], ids[b]), min(ids[a], ids[b])
                others.setdefault(high, []).append(low)
                others.setdefault(low, [])
            rows = group[["bucket", "i", "j", "doc_id", "label"]][group["doc_id"].isin(others.keys())]
            yield rows.assign(others=[others[x] for x in rows["doc_id"]])

    return cells.mapInPandas(run, "bucket long, i int, j int, doc_id long, label long, others array<long>")


def _cell_links(candidates: DataFrame, docs: DataFrame, shingle: int, threshold: float, parts: int) -> DataFrame:
    """Links of the cells that join members (or their components) not joined yet, verified on the full sets."""
    percent = round(threshold * 100)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = worker_cache(("shingles", shingle), lambda: ShingleHasher(shingle))
        for group in _runs(frames, ["bucket", "i", "j"]):
            texts, sets, held = dict(zip(group["doc_id"], group["text"], strict=True)), {}, 0

            def members(d):
                nonlocal held
                if d not in sets:
                    if held > 2 * CELL_SHINGLES:
                        sets.clear()
                        held = 0
                    sets[d] = shingles(texts[d])
                    held += len(sets[d])
                return sets[d]

            label = dict(zip(group["doc_id"], group["label"], strict=True))
            up: dict = {}

            def top(x, up=up):
                while up.setdefault(x, x) != x:
                    up[x] = x = up[up[x]]
                return x

            links = []
            for a, others in zip(group["doc_id"], group["others"], strict=True):
                for b in others:
                    one, two = top(label[a]), top(label[b])
                    if one == two:
                        continue
                    x, y = members(a), members(b)
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        up[one] = two
                        links.append((a, b))
            if links:
                yield pd.DataFrame(links, columns=["a", "b"])

    # only the texts concerned are shuffled, where their ids fit the broadcast budget
    concerned = broadcast_if_small(candidates.select("doc_id").distinct())
    texts = docs.select("doc_id", "text").join(concerned, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return (candidates.join(texts, "doc_id").repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
            .select("bucket", "i", "j", "doc_id", "label", "others", "text").mapInPandas(run, "a long, b long"))


def near_duplicate_groups(docs: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """``row_key, doc_id, n_shingles, component, component_id, first`` for every row of ``docs(doc_id, text)``.

    Documents are linked where the Jaccard similarity of their sets is ``threshold`` (whole per cents)
    or more; ``component`` names the rows reachable over links, ``component_id`` is their smallest id (null if none has one) and
    ``first`` the ``row_key`` of a row with that id.  Null, empty and word-less texts have ``n_shingles`` 0 and stand alone.
    Rows that share an id, or have none, are compared each for itself; rows equal in id and text have
    one ``row_key``.  Other columns are not read.
    """
    docs = docs.select(row_key().alias("doc_id"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    sketches = stored(_sketch(docs, shingle), "sketches")
    full = sketches.where("n_shingles > 0")
    copies = stored(full.groupBy("high", "low").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n"))
                    .where("n > 1").drop("n"), "copies")
    members = stored(sketches.select("doc_id", "id", "n_shingles", "high", "low").join(copies, ["high", "low"], "left")
                     .select("doc_id", "id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id")), "members")
    # one sketch per class: those without copies, and one row of each group of copies
    copied = broadcast_if_small(copies)
    alone = full.join(copied, ["high", "low"], "left_anti").select("doc_id", "n_shingles", "bands", "sig")
    leads = full.join(copied, ["high", "low"]).where("doc_id = class_id").select("doc_id", "n_shingles", "bands", "sig")
    classes = alone.unionByName(leads.dropDuplicates(["doc_id"]))
    rows = classes.select("doc_id", "n_shingles", F.posexplode("bands").alias("place", "band"))
    leaders = F.array(F.min("doc_id"), *[F.min_by("doc_id", F.xxhash64("doc_id", F.lit(k))) for k in range(1, LEADERS)])
    buckets = stored(rows.groupBy("band").agg(F.array_distinct(leaders).alias("leaders"), F.count("*").alias("n"))
                     .where("n > 1").drop("n"), "buckets")
    rows = stored(rows.join(buckets, "band"), "bucket-rows")         # rows of buckets with company only

    met = (rows.select("doc_id", F.explode("leaders").alias("leader")).where("doc_id <> leader")
           .select(F.greatest("doc_id", "leader").alias("a"), F.least("doc_id", "leader").alias("b")).distinct())
    involved = stored(classes.join(rows.select("doc_id").distinct(), "doc_id", "left_semi")
                      .select("doc_id", "n_shingles", "sig"), "involved")
    spark = docs.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    stars = stored(_stars(stored(_unpruned(met, involved, threshold), "pairs")), "stars")
    links = stored(_cell_links(stars, docs, shingle, threshold, parts), "links")
    labels = connected_components(links)

    # buckets that still span components: pairs across them, in cells of bounded size
    labelled = (rows.select(F.col("band").alias("bucket"), F.col("place").alias("band"), "doc_id", "n_shingles")
                .join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
                .select("bucket", "band", "doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("label")))
    labelled = stored(labelled, "labelled")
    mixed = stored(labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"),
                                                                  F.sum("n_shingles").alias("shingles"))
                   .where("lo <> hi").select("bucket", "n", "shingles"), "mixed")
    cells = (_cells(labelled, mixed).join(involved.select("doc_id", "sig"), "doc_id")
             .repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j"))
    candidates = stored(_cell_candidates(cells, threshold), "candidates")
    more = stored(_cell_links(candidates, docs, shingle, threshold, parts), "links")
    # whole components are joined by them: a table of labels, far smaller than that of the documents
    of = labels.select(F.col("node"), "label")
    merged = (more.join(of.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left")
              .join(of.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
              .select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b"))
    merged = stored(merged.distinct(), "merged")
    final = labels
    if merged.limit(1).count():
        onto = connected_components(merged)
        every = labels.union(merged.select(F.explode(F.array("a", "b")).alias("node")).distinct()
                             .join(labels.select("node"), "node", "left_anti").select("node", F.col("node").alias("label")))
        final = stored(every.join(onto.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left")
                       .select("node", F.coalesce("to", "label").alias("label")), "final")
    placed = stored(members.join(final.select(F.col("node").alias("class_id"), "label"), "class_id", "left")
                    .select("doc_id", "id", "n_shingles", F.coalesce("label", "class_id").alias("component"),
                            (F.col("n_shingles") > 0).alias("words")), "placed")
    # word-less rows may share a key but are no group
    firsts = (placed.where("words").groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "doc_id")).alias("f"), F.count("*").alias("n"))
              .where("n > 1").select("component", F.col("f.id").alias("least"), F.col("f.doc_id").alias("first"), F.lit(True).alias("words")))
    return (placed.join(firsts, ["component", "words"], "left")
            .select(F.col("doc_id").alias("row_key"), F.col("id").alias("doc_id"), "n_shingles", "component",
                    F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"),
                    F.coalesce("first", "doc_id").alias("first")))


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``.

    See ``near_duplicate_groups``.  ``kept`` marks rows whose id is the component's smallest; a component without any id
    has a null ``component_id``, and the row that stands for it is kept.
    """
    groups = near_duplicate_groups(docs, shingle, threshold)
    return groups.select("doc_id", "n_shingles", "component_id",
                         F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull() & (F.col("row_key") == F.col("first")))
                         .alias("kept"))


__all__ = ["near_duplicates", "near_duplicate_groups", "row_key", "ShingleHasher", "signature", "band_keys", "least_matches"]
