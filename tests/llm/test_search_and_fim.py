"""Ranked search, fill-in-middle cuts and bit-sliced top-k against brute-force versions, and their corner cases."""

import hashlib
import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runready.llm import best_position as bp
from runready.llm import bit_sliced as bs
from runready.llm import catalog
from runready.llm import fim_fenwick as fim
from runready.llm.blocks import QUERY, block_stream

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
ODD = [(1, None), (2, ""), (3, " .,;\n"), (4, "word"), (4, "word"), (None, "no id, one word"), (6, "a b " * 30_000),
       (7, "Ünïcode STRASSE İstanbul 中文 é"), (8, "x" * 50_000)]


def oracle(name, sf=SF):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    rel = con.sql(catalog.ORACLES[name])
    return rel.columns, rel.fetchall()


@pytest.mark.parametrize("name", ["op11_best_position", "op12_fim_fenwick", "op13_bit_sliced"])
def test_query_equals_its_sql(spark, name):
    columns, rows = oracle(name)
    got = catalog.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns) and rows
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(rows)


# ---- op11 ----------------------------------------------------------------------------

def brute_search(docs, items, k):
    split = [(d, TERM.findall(t.translate(LOW)) if t else []) for d, t in docs]
    n_docs, length = sum(bool(t) for _, t in split), sum(len(t) for _, t in split)
    df = Counter(w for _, t in split for w in set(t))
    out = []
    for item, text in {x for x in items if x[1] is not None}:
        scored = []
        for d, terms in split:
            tf, total = Counter(terms), 0
            m = 75 + (25 * len(terms) * n_docs) // max(1, length)
            for w in TERM.findall(text.translate(LOW)):
                if tf[w]:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                    total += weight * ((1_000_000_000 * tf[w]) // (1000 * tf[w] + 12 * m))
            if total > 0:
                scored.append((-total, bp.NO_ID if d is None else d))
        out += [(item, r + 1, None if d == bp.NO_ID else d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return Counter(out)


def searched(spark, docs, items, k):
    left = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "doc_id as item_id", "'z' as score", "1 as rank")
    right = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "7 as doc_id", "'z' as terms")
    return Counter(tuple(r) for r in bp.search(left.repartition(3), right, k).collect())


def test_search_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    weights = 1 / np.arange(1, 61)
    docs = [(int(i), " ".join(rng.choice(words, rng.integers(1, 60), p=weights / weights.sum()))) for i in rng.permutation(400)]
    docs += [(1000 + i, docs[0][1]) for i in range(40)] + [(docs[1][0], docs[1][1])] * 3 + ODD     # copies, repeated rows
    items = [(i, " ".join(rng.choice(words, 12))) for i in range(20)]
    items += [(3, "w3 w3 W3 w50"), (3, "w3 w3 W3 w50"), (90, None), (91, ""), (92, "nowhere"), (93, docs[0][1]), (None, "w1 word"), (94, "中文 é")]
    monkeypatch.setattr(bp, "SHARD_DOCS", 50)
    assert searched(spark, docs, items, 20) == brute_search(docs, items, 20)
    assert searched(spark, docs, items, 3) == brute_search(docs, items, 3)


def test_search_of_empty_tables(spark):
    assert not searched(spark, [], [(1, "a")], 20) and not searched(spark, [(1, "a")], [], 20) and not searched(spark, ODD[:3], [(1, "a")], 20)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 200), st.integers(1, 12)), min_size=1, max_size=150), min_size=1, max_size=5),
       st.integers(1, 8), st.integers(0, 40))
def test_best_positions_never_cut_a_tie(lists, k, floor):
    bp_first, bp.FIRST_READ = bp.FIRST_READ, 2
    try:
        made, total = [], Counter()
        for n, entries in enumerate(lists):
            by_doc = dict(entries)
            docs = np.array(sorted(by_doc), np.int64)
            made.append((bp.ImpactList(docs, np.array([by_doc[d] for d in docs], np.int64)), n + 1))
            total.update({d: (n + 1) * s for d, s in by_doc.items()})
        found, scores, _ = bp.best_position_search(made, 201, k, floor)
    finally:
        bp.FIRST_READ = bp_first
    want = sorted(((-s, d) for d, s in total.items()))[:k]
    got = list(zip((-scores).tolist(), found.tolist(), strict=True))
    # a document under the floor may be missing; all others are there, in order
    assert [x for x in got if -x[0] >= floor] == [x for x in want if -x[0] >= floor]


def test_best_positions_stop_before_the_end():
    docs = np.arange(20_000)
    one, two = bp.ImpactList(docs, 40_000 - docs), bp.ImpactList(docs, 40_000 - docs)
    found, _, entries = bp.best_position_search([(one, 1), (two, 1)], len(docs), 5)
    assert found.tolist() == [0, 1, 2, 3, 4] and entries <= 4 * bp.FIRST_READ


# ---- op12 ----------------------------------------------------------------------------

TEXT = st.text(st.sampled_from(list("ab \n<PSM>") + ["é", "中", "😀", "́"]), max_size=300)


@settings(max_examples=200, deadline=None)
@given(TEXT, st.sampled_from([1, 3, 8, 64]), st.sampled_from([None, r"\S+\s*", r"[^\n]*\n?"]))
def test_cuts_fall_on_unit_boundaries(text, block, unit):
    size, fim.BLOCK = fim.BLOCK, block
    try:
        data = text.encode()
        pattern = None if unit is None else re.compile(unit.encode(), re.DOTALL)
        index = fim.CutIndex(data, pattern)
        starts = ([len(text[:k].encode()) for k in range(len(text))] if unit is None else
                  [m.start() for m in pattern.finditer(data) if m.end() > m.start()])
        assert index.units == len(starts)
        for k in range(len(starts) + 1):
            want = 0 if k == 0 else len(data) if k == len(starts) else starts[k]
            assert index.cut(k) == (want, len(data[:want].decode()))
    finally:
        fim.BLOCK = size


@settings(max_examples=300, deadline=None)
@given(TEXT, TEXT, TEXT, st.sampled_from(["psm", "spm"]))
def test_texts_are_restored_from_output_and_form(a, b, c, form):
    text = (a + b + c).encode()
    if not any(x in text for x in (fim.PREFIX, fim.SUFFIX, fim.MIDDLE)):
        assert fim.restored(fim.arranged(a.encode(), b.encode(), c.encode(), form), form) == text


def test_transform_equals_brute_force(spark):
    rows = ODD + [(20, "a<P>b"), (21, "a<S>"), (22, "<M>"), (23, "<P <S> >")] + [(100 + k, "abc é 中😀 " * k) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as form", "text as output")
    got, want = Counter(), Counter()
    for r in fim.transform(docs).collect():
        assert r.restored == r.output if r.form == "plain" else True
        got[tuple(r)] += 1
    for doc, text in rows:
        text, h = text or "", hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
        n = len(text)
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
            want[doc, n, "plain", None, None, text, text] += 1
        elif h4 % 100 < 20:
            want[doc, n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}", text] += 1
        else:
            want[doc, n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}", text] += 1
    assert got == want and len({k[2] for k in want}) == 3
    assert fim.digests(fim.transform(docs.limit(0))).count() == 0


def test_transform_cuts_words(spark):
    text = "one two  three four five six seven eight nine ten"
    for r in fim.transform(spark.createDataFrame([(k, text) for k in range(40)], "doc_id long, text string"), rate=100, unit=r"\S+\s*").collect():
        words = re.findall(r"\S+\s*", text)
        edges = {len("".join(words[:k])) for k in range(len(words) + 1)}
        assert r.n == 10 and r.restored == text and {r.prefix_chars, r.prefix_chars + r.middle_chars} <= edges


# ---- op13 ----------------------------------------------------------------------------

def brute_top(rows, k):
    use = [(n, i, [math.floor(256 * x) for x in v]) for n, (i, v) in enumerate(rows)
           if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in use:
        if i is not None and i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, x)), bp.NO_ID if j is None else j) for m, j, x in use if m != n)
            out += [(i, r + 1, None if j == bp.NO_ID else j, -s) for r, (s, j) in enumerate(scored[:k])]
    return Counter(out)


def top(spark, rows, k=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as query_id", "'x' as score", "0 as block")
    return Counter(tuple(r) for r in bs.top_inner_products(df.repartition(3), F.col("vec_id") % 50 == 0, k).collect())


def test_top_inner_products_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(int(i), [float(np.float32(x)) for x in v]) for i, v in enumerate(rng.normal(0, 0.2, (700, 12)))]
    rows += [(2000 + i, rows[50][1]) for i in range(120)]                                        # a large tie
    rows += [(100, rows[7][1]), (100, rows[100][1]), (3000, None), (3001, [0.5, None]), (3050, [float("nan")] * 12),
             (3051, [float("inf")] * 12), (None, rows[50][1]), (3100, []), (3150, [0.25]), (3200, [1.0] * 15), (3250, [0.0] * 12),
             (3300, [1000.0] * 12), (3350, [-1000.0] + [0.0] * 11)]
    monkeypatch.setattr(bs, "BLOCK", 128)
    monkeypatch.setattr(bs, "QUERY_BLOCK", 4)
    assert top(spark, rows) == brute_top(rows, 5)
    assert top(spark, rows[:3], 5) == brute_top(rows[:3], 5)
    assert not top(spark, []) and not top(spark, [(1, [1.0])]) and not top(spark, [(0, [1.0])])


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 90), st.integers(1, 6), st.integers(1, 5), st.sampled_from([1, 3, 40, 100_000]), st.integers(0, 10 ** 6))
def test_slices_hold_the_best(n, dims, k, reach, seed):
    rng = np.random.default_rng(seed)
    x, q = rng.integers(-reach, reach + 1, (n, dims)), rng.integers(-reach, reach + 1, dims)
    block = bs.SlicedBlock(x)
    own = int(rng.integers(-1, n))
    found = block.best(q, k, own)
    score = x @ q
    others = np.array([r for r in range(n) if r != own], int)
    if len(others) > k:
        kth = np.sort(score[others])[-k]
        assert set(others[score[others] >= kth]) <= set(found.tolist())
    else:
        assert found.tolist() == others.tolist()
    sums = sum((1 << b) * np.unpackbits(s.view(np.uint8), bitorder="little")[:n].astype(object) for b, s in enumerate(block.sums(q)))
    slack = int((np.abs(q) * ((1 << block.drop) - 1)).sum())
    gap = score - np.array(sums if not np.isscalar(sums) else [0] * n, dtype=object)
    assert max(gap) - min(gap) <= slack


def test_sums_beyond_a_long_are_an_error(spark):
    with pytest.raises(Exception, match="long"):
        top(spark, [(0, [3e10] * 4), (1, [3e10] * 4)])


def test_every_block_meets_every_query_once(spark):
    for n, m in ((1, 1), (7, 3), (40, 50)):
        blocks = spark.range(n).select(F.col("id").alias("block"), F.lit(0).alias("part"))
        queries = spark.range(m).select(F.col("id").alias("query"), F.col("id").alias("name"))
        met, key, names = [], None, []
        for part in block_stream(blocks, queries, n, m, queries_a_round=8).rdd.glom().collect():
            for r in part:
                if r.key != key:
                    key, names = r.key, []
                if r.kind == QUERY:
                    names.append(r.name)
                else:
                    met += [(r.block, x) for x in names]
        assert sorted(met) == [(a, b) for a in range(n) for b in range(m)]
