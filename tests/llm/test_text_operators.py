"""Operators on documents against brute-force versions on small tables, and their corner cases."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from runready.llm import bayes_minhash as bm
from runready.llm import components, language_id, license_scan, quality_divergence, spaced_seeds
from runready.llm import importance_resampling as ir
from runready.llm import token_store as ts
from runready.llm.catalog import word_tokenizer

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, None, None)[:4] for r in rows], DOCS)


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (4, "word"), (5, "## $$ %%"), (None, "no id here"),
       (6, "a b " * 30_000), (7, "Ünïcode Straße İstanbul 中文   é")]


# ---- op1 -----------------------------------------------------------------------------

def brute_repeats(words):
    seen = Counter(tuple(words[k:k + 5]) for k in range(len(words) - 4))
    covered = {j for k in range(len(words) - 4) if seen[tuple(words[k:k + 5])] > 1 for j in range(k, k + 5)}
    return len(covered)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60))
def test_repeated_words(words):
    assert quality_divergence.repeated_words(words) == brute_repeats(words)


def test_quality_rules_base_and_corner_cases(spark):
    clean = "the cat sat on the mat and the dog ran far away from it today while birds sang. "
    texts = [(10 + k, "".join(random.Random(k).sample(clean, len(clean)))) for k in range(3)]
    rows = ODD + texts + [(20, "x\nx\n\n \nx\ny"), (21, clean * 4)]
    got = quality_divergence.quality_rules(docs_of(spark, rows).selectExpr("*", "doc_id as kept")).collect()
    assert len(got) == len(rows)
    expected = Counter()
    for doc, text in rows:
        text = text or ""
        w = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        rep = brute_repeats(w)
        failed = len(w) < 10 or 100 * rep > 20 * len(w)
        expected[doc, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
                 rep, failed] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                   for r in got) == expected
    assert not any(r.kept and r.base_failed for r in got)
    assert quality_divergence.quality_rules(docs_of(spark, [])).count() == 0


def test_js_distance():
    a, b = np.array([1.0, 0, 3]), np.array([0.0, 5, 0])
    assert quality_divergence.js_distance(a, a * 7) == 0 and quality_divergence.js_distance(a, b) == pytest.approx(1)
    assert quality_divergence.js_distance(a, np.zeros(3)) == 1


def test_junk_fails_and_clean_passes(spark):
    from runready.llm.tables import read_table
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r for r in read_table(spark, sf, "labels").collect()}
    got = quality_divergence.quality_rules(read_table(spark, sf, "documents")).collect()
    clean = [r for r in got if r.doc_id in labels and labels[r.doc_id].quality == 1 and not r.base_failed]
    junk = [r for r in got if r.doc_id in labels and labels[r.doc_id].quality == 0]
    assert sum(r.kept for r in clean) >= 0.99 * len(clean) and sum(r.kept for r in junk) <= 0.05 * len(junk)


@pytest.mark.parametrize("held", [None, 50])
def test_common_words_are_counted_over_all_documents(spark, monkeypatch, held):
    """Frequent words under a thousandth of every large partition, beside a partition of a few words."""
    if held:
        monkeypatch.setattr(quality_divergence, "HELD_WORDS", held)
    rnd = random.Random(5)
    flat = [f"w{k}" for k in range(3000)]
    texts = [" ".join(rnd.choice(flat[:100] if rnd.random() < .02 else flat) for _ in range(2000)) for _ in range(12)]
    rows = [(k, t, "aa", "s") for k, t in enumerate(texts)] + [(99, "Few rare words", "aa", "s"), (100, "x " * 5, "bb", "s")]
    counts = Counter((r[2], w) for r in rows for w in WORD.findall(r[1].lower()))
    expected = set()
    for lang in ("aa", "bb"):
        mine = sorted(((-n, w) for (at, w), n in counts.items() if at == lang))
        expected |= {w for _, w in mine[:quality_divergence.COMMON_WORDS]}
    for parts in (1, 4):
        assert quality_divergence.common_words(docs_of(spark, rows).repartition(parts)) == sorted(expected)


# ---- op2 -----------------------------------------------------------------------------

def test_language_sample_takes_each_text_once_up_to_its_limit(spark):
    limit = language_id.MAX_PER_LANG
    rows = [(k, f"distinct text {k}", "aa") for k in range(60)]
    rows += [(k, "one text often", "aa") for k in range(5000)]
    rows += [(k, f"other text {k}", "bb") for k in range(3 * limit)]
    rows += [(k, f"copy {k % 2}", "cc") for k in range(3000)] + [(1, None, "aa"), (2, "no lang", None)]
    for parts in (1, 6):
        got = language_id.sampled(docs_of(spark, rows).repartition(parts).select("text", "lang")).collect()
        texts = {lang: [r.text for r in got if r.lang == lang] for lang in ("aa", "bb", "cc")}
        assert sum(map(len, texts.values())) == len(got)
        assert sorted(texts["aa"]) == sorted({r[1] for r in rows if r[2] == "aa"} - {None})
        assert len(set(texts["bb"])) == len(texts["bb"]) == limit and sorted(texts["cc"]) == ["copy 0", "copy 1"]


def test_language_of_copies_reaches_the_model(spark):
    words = {"aa": "alpha beta gamma delta", "bb": "ein zwei drei vier", "cc": "uno dos tres cuatro"}
    rows = [(k, f"{words[lang]} {chr(97 + k % 26)}{chr(97 + k // 26)}", lang) for lang in ("aa", "bb") for k in range(60)]
    rows += [(k, words["cc"], "cc") for k in range(20_000)]
    model = language_id.train(docs_of(spark, rows).select("text", "lang"))
    assert model.langs == ["aa", "bb", "cc"]


def test_language_id_held_out_accuracy_and_corner_cases(spark):
    from runready.llm.catalog import op2_language_id
    from runready.llm.tables import read_table
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in read_table(spark, sf, "documents").select("doc_id", "lang").collect()}
    got = op2_language_id(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got) and len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    model = language_id.train(read_table(spark, sf, "documents").select("text", "lang"))
    odd = language_id.predict(docs_of(spark, ODD + [(8, "Привет мир как дела")]), model, "doc_id").collect()
    assert len(odd) == len(ODD) + 1 and all(0 <= r.score <= 1 for r in odd)
    assert all((r.lang_pred == "und") == (r.doc_id in (1, 2, 3, 5)) for r in odd)
    assert all(r.rejected for r in odd if r.doc_id in (1, 2, 3, 5, 8))
    # nothing to learn from, nothing to predict
    empty = language_id.train(docs_of(spark, [(1, "text")]).select("text", "lang"))
    assert {r.lang_pred for r in language_id.predict(docs_of(spark, ODD), empty, "doc_id").collect()} == {"und"}
    assert language_id.predict(docs_of(spark, []), model, "doc_id").count() == 0


# ---- op5 -----------------------------------------------------------------------------

def shingle_set(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(zip(*(w[k:] for k in range(n)), strict=False)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(rows, n, percent):
    sets = {d: shingle_set(t, n) for d, t in rows}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def near_copies(seed, n_groups=4):
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    rows = []
    for _ in range(n_groups):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([12, 40, 120]))]
        for _ in range(rnd.randint(1, 25)):
            t = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 3, 5])):
                t[rnd.randrange(len(t))] = rnd.choice(vocab)
            rows.append((len(rows), " ".join(t).upper() if rnd.random() < 0.2 else " ".join(t)))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("shingle", [2, 5])
def test_near_duplicates_equal_brute_force(spark, shingle):
    rows = near_copies(shingle) + [(1000, None), (1001, ""), (1002, "one"), (1003, "ONE"), (1004, "a b " * 20_000)]
    docs = docs_of(spark, rows).selectExpr("*", "doc_id as label")
    got = bm.near_duplicates(docs.union(docs.where("doc_id = 1000").selectExpr("null", "text", "lang", "source", "label")),
                             shingle, 0.8).collect()
    expected = brute_components(rows, shingle, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == expected
    assert len(got) == len(rows) + 1 and [(r.n_shingles, r.component_id) for r in got if r.doc_id is None] == [(0, None)]
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert bm.near_duplicates(docs_of(spark, []), shingle).count() == 0


def test_near_duplicates_with_shared_and_missing_ids(spark, monkeypatch):
    """Rows that share an id or have none are rows of their own; cells and stars of any size give the same result."""
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(7, a), (7, b), (7, a), (9, a + " x"), (None, b + " y"), (None, a), (None, "alone " + " ".join("cdefg")), (3, ""), (3, "")]
    got = sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in bm.near_duplicates(docs_of(spark, rows), 2, 0.8).collect())))
    assert got == sorted(map(str, [(7, 39, 7, True), (7, 39, 7, True), (7, 39, 7, True), (9, 40, 7, False), (None, 40, 7, False),
                                   (None, 39, 7, False), (None, 5, None, True), (3, 0, 3, True), (3, 0, 3, True)]))
    import corpus_pipeline
    kept = corpus_pipeline.drop_near_duplicates(spark, docs_of(spark, rows), SF).collect()
    assert sorted((str(r.doc_id), r.text[:5]) for r in kept) == [("3", ""), ("3", ""), ("7", a[:5]), ("7", b[:5]), ("None", "alone")]
    many = near_copies(4, 5)
    monkeypatch.setattr(bm, "LEADERS", 1)
    monkeypatch.setattr(bm, "CELL", 3)
    monkeypatch.setattr(bm, "STAR", 2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in bm.near_duplicates(docs_of(spark, many), 2, 0.8).collect()}
    assert got == brute_components(many, 2, 80)


def test_sequential_test_keeps_true_links():
    """The chance that a pair at the threshold is pruned stays near the chosen miss probability."""
    rng, looks = np.random.default_rng(1), bm.least_matches(0.8)
    same = rng.random((200_000, bm.HASHES)) < 0.8
    m = np.cumsum(same, axis=1)[:, bm.BATCH - 1::bm.BATCH]
    assert (m < np.array(looks)).any(axis=1).mean() < 1e-4
    far = np.cumsum(rng.random((2_000, bm.HASHES)) < 0.4, axis=1)[:, bm.BATCH - 1::bm.BATCH]
    assert (far < np.array(looks)).any(axis=1).mean() > 0.99


def test_components_of_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 300)] + [(500, 500), (300, 299)]
    got = {r.node: r.label for r in components.connected_components(
        spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(61)) and all(got[k] == 100 for k in range(100, 301))


def test_components_go_on_with_the_edges_between_trees(spark, monkeypatch):
    """Edges are looked at once: members that share many leaders do not come back in every round."""
    seen, store = [], components.stored

    def counted(df, name, *rest):
        out = store(df, name, *rest)
        if name == "edges":
            seen.append(out.count())
        return out

    monkeypatch.setattr(components, "stored", counted)
    edges = [(1000 + m, leader) for m in range(200) for leader in range(10) if (m + leader) % 3] + [(1200, 1199)]
    got = {r.node: r.label for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got.values()) == {0} and len(got) == 211
    assert seen[0] == len(edges) and sum(seen) < 1.2 * len(edges)


# ---- op6 -----------------------------------------------------------------------------

def test_masks_reach_every_window_with_two_substitutions():
    from itertools import combinations
    for differ in combinations(range(spaced_seeds.WINDOW), 2):
        assert any(not set(differ) & {at + k for k in mask} for mask in spaced_seeds.MASKS
                   for at in range(spaced_seeds.WINDOW - mask[-1]))


def brute_contaminated(docs, items):
    tokens = spaced_seeds.TokenHasher()
    found = set()
    for i, it in items:
        t = tokens(it)
        n = min(len(t), spaced_seeds.WINDOW)
        if len(t) < spaced_seeds.MIN_ITEM:
            continue
        for d, dt in docs:
            x = tokens(dt)
            if any((x[p:p + n] == t[q:q + n]).sum() >= n - (2 if len(t) >= spaced_seeds.WINDOW else 0)
                   for p in range(len(x) - n + 1) for q in range(len(t) - n + 1)):
                found.add((d, i))
    return found


def test_contaminated_equals_brute_force_both_ways(spark):
    rnd = random.Random(5)
    vocab = [f"v{k}" for k in range(60)]
    items = [(k, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([3, 5, 8, 13, 20, 30])))) for k in range(12)]
    items += [(50, None), (51, ""), (None, "no id of an item that is here now")]
    rows = []
    for k in range(60):
        t = [rnd.choice(vocab) for _ in range(rnd.randint(0, 60))]
        if k % 3:
            cut = items[rnd.randrange(12)][1].split()
            cut = cut[rnd.choice([0, 0, 2]):]
            for _ in range(rnd.choice([0, 1, 2, 3])):
                cut[rnd.randrange(len(cut))] = "zz"
            at = rnd.randint(0, len(t))
            t[at:at] = [w.upper() + "," for w in cut]
        rows.append((k, " ".join(t)))
    rows += [(100, None), (101, "")]
    expected = brute_contaminated([r for r in rows if r[1]], [i for i in items if i[1] and i[0] is not None])
    assert expected
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(spark, rows + [(None, items[8][1])])
    one = spaced_seeds.contaminated(docs, bench).collect()
    two = spaced_seeds.contaminated(docs, bench, max_broadcast_tokens=0).collect()
    assert {(r.doc_id, r.item_id) for r in one} == expected and len(one) == len(expected)
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))
    assert spaced_seeds.contaminated(docs_of(spark, []), bench).count() == 0
    assert spaced_seeds.contaminated(docs, bench.limit(0)).count() == 0


# ---- op7 -----------------------------------------------------------------------------

def test_license_scan(spark):
    rnd = random.Random(3)
    filler = lambda n: " ".join(rnd.choice(["of", "the", "work", "under", "lorem", "version"]) for _ in range(n))
    rows, expected = [], set()
    for k, (name, notices) in enumerate(license_scan.TEMPLATES.items()):
        for j, notice in enumerate(notices):
            doc = 100 * k + j
            words = notice.split()
            if len(words) > 20:
                words[5] = "changed"
            rows.append((doc, f"{filler(rnd.randint(0, 80))} {' '.join(words).upper()} {filler(rnd.randint(0, 90))}"))
            expected.add((doc, name))
    rows += [(9000, filler(500)), (9001, None), (9002, ""), (9003, "license")]
    got = license_scan.scan(docs_of(spark, rows)).collect()
    assert expected <= {(r.doc_id, r.license) for r in got}
    assert not [r for r in got if r.doc_id >= 9000] and all(0.8 <= r.containment <= 1 for r in got)
    tokens = spaced_seeds.TokenHasher()
    text = dict(rows)
    for r in got:                        # exact containment of the notice named, from the token named on
        t = license_scan.shingles(tokens(license_scan.TEMPLATES[r.license][r.notice]))
        s = license_scan.shingles(tokens(text[r.doc_id]))[r.first_token:]
        assert np.isin(np.unique(t), s).mean() >= r.containment
    assert license_scan.scan(docs_of(spark, [])).count() == 0


def test_license_scan_finds_what_an_exact_search_finds(spark):
    """Every run of a notice's length that holds 0.8 of its shingles, over the whole given table."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {(r.doc_id, r.license) for r in license_scan.scan(docs).collect()}
    tokens = spaced_seeds.TokenHasher()
    notices = [(name, set(license_scan.shingles(tokens(n)).tolist()), len(license_scan.shingles(tokens(n))))
               for name, each in license_scan.TEMPLATES.items() for n in each]
    expected = set()
    for r in docs.select("doc_id", "text").where("text is not null").collect():
        s = license_scan.shingles(tokens(r.text)).tolist()
        whole_text = set(s)
        for name, notice, n in notices:
            if (len(notice & whole_text) >= 0.8 * len(notice)
                    and any(len(notice & set(s[a:a + n])) >= 0.8 * len(notice) for a in range(max(1, len(s) - n + 1)))):
                expected.add((r.doc_id, name))
    assert expected and expected <= got
    # what is found beyond: runs up to a window of 1.25 * 1.5 notices long
    assert len(got - expected) <= 0.05 * len(got)


def test_license_identifiers_are_told_apart(spark):
    lines = {k: (name, notice) for k, (name, notice) in enumerate(
        (name, notice) for name, each in license_scan.TEMPLATES.items() for notice in each if notice.startswith("SPDX"))}
    rows = [(k, f"some code here // {notice.lower()} and more of it") for k, (_, notice) in lines.items()]
    rows += [(100, "SPDX-License-Identifier: Something-Else-9"), (101, "the license identifier of mit")]
    got = {(r.doc_id, r.license) for r in license_scan.scan(docs_of(spark, rows)).collect()}
    assert got == {(k, name) for k, (name, _) in lines.items()}


def test_license_scan_repeated_ids_clashing_columns_and_pieces(spark, monkeypatch):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
    notice = license_scan.TEMPLATES["MIT"][2]
    assert notice.startswith(mit)
    long_text = "plain words " * 9_000 + notice + " more words" * 9_000 + " " + notice
    rows = [(1, notice), (1, notice), (None, notice), (2, long_text), (3, None), (4, ""), (5, notice[:200])]
    docs = docs_of(spark, rows).selectExpr("*", "doc_id as license", "doc_id as notice", "text as containment")
    got = Counter((r.doc_id, r.license, r.notice) for r in license_scan.scan(docs).collect())
    assert got == {(1, "MIT", 2): 2, (None, "MIT", 2): 1, (2, "MIT", 2): 1}
    templates = license_scan.Templates(license_scan.TEMPLATES)
    members = license_scan.shingles(spaced_seeds.TokenHasher()(long_text + " " + " ".join([notice] * 40)))
    whole_text = templates.candidates(members)
    monkeypatch.setattr(license_scan, "PIECE", 64)
    assert whole_text and templates.candidates(members) == whole_text


# ---- op9 -----------------------------------------------------------------------------

def whole(tokenizer, text):
    return tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(
    " \n\t\x0b\x0c\r\x1c\x85  'sİßﬁé<|endoftext|>")), max_size=60))
def test_word_by_word_encoding_equals_whole_texts(text):
    enc = ts._encoder(word_tokenizer())
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == whole(enc.tokenizer, text)


def test_words_are_cut_into_pieces_of_their_own():
    """A piece goes to the model once, whatever stands around it; other words go through the whole tokenizer."""
    import random

    from tokenizers import Tokenizer
    tokenizer, encoder, r = Tokenizer.from_file(word_tokenizer()), ts.WordEncoder(word_tokenizer()), random.Random(5)
    encoder.encode("river River, (river) RIVER.")
    assert set(encoder.pieces) == {"river", ",", "(", ")", "."}
    letters = "".join(map(chr, range(33, 127))) + "'''stdlrvem" * 3 + "\u00e9\u00dc\u00df\u00ff\u00d7\u00f7\u0301\u0130\u03a3\u4e2d\u0663\ufb01\x1c\x7f\xa0"
    words = ["".join(r.choice(letters) for _ in range(r.randint(1, 8))) for _ in range(4_000)]
    words += ["<|endoftext|>", "x<|endoftext|>y", "<|ENDOFTEXT|>", "I'LL", "'S", "don't", *map(chr, range(0xA1, 0x250))]
    for word in words:
        ids = tokenizer.encode(word, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(word), "<u4").tolist() == ids, word


def test_pieces_of_many_texts_go_to_the_library_in_one_call(monkeypatch):
    """Also with null and empty texts, a slice of an array, and a table that is full at once."""
    import random

    import pyarrow as pa
    encoder, r = ts.WordEncoder(word_tokenizer()), random.Random(7)
    letters = "abcdeXYZ\u00e9\u00dc'st,.!7 \n\t"
    texts = [None, "", " \n ", "River, river 12", None, "\u4e2dx y\u0130 <|endoftext|> a<|endoftext|> <|ENDOFTEXT|>", "\x1cz\u00a0z",
             *("".join(r.choice(letters) for _ in range(80)) for _ in range(300)), ""]
    expected = [whole(encoder.tokenizer, text or "") for text in texts]
    bare, calls = encoder.bare, []

    class Counted:
        def encode_batch_fast(self, *args, **kwargs):
            calls.append(1)
            return bare.encode_batch_fast(*args, **kwargs)

    def check(array, expected):
        ids, n = encoder.encode_all(array)
        assert ids.tolist() == [i for e in expected for i in e] and n.tolist() == [len(e) for e in expected]

    encoder.bare = Counted()
    for _ in range(2):
        check(pa.array(texts, pa.string()), expected)
        assert len(calls) == 1
    check(pa.array(texts, pa.string()).slice(3, 50), expected[3:53])
    check(pa.array([None, ""], pa.string()), [[], []])
    check(pa.array([], pa.string()), [])
    monkeypatch.setattr(ts, "CACHED_PIECES", 20)
    monkeypatch.setattr(ts, "CALL_KEYS", 7)
    for at in range(0, len(texts), 9):
        check(pa.array(texts[at:at + 9], pa.string()), expected[at:at + 9])


def test_token_files_of_more_text_than_a_slice(spark, tmp_path):
    texts = [(k, f"w{k % 10} " * (ts.SLICE_BYTES // 20) + "end") for k in range(12)] + [(20, None), (21, "")]
    ts.write_tokens(docs_of(spark, texts).coalesce(1), str(tmp_path / "tokens"), word_tokenizer(), 2)
    start, tokenizer = 0, ts._encoder(word_tokenizer()).tokenizer
    got = sorted(ts.token_digests(spark, str(tmp_path / "tokens")).collect(), key=lambda r: r.doc_id)
    for row, (doc, text) in zip(got, texts, strict=True):
        ids = (whole(tokenizer, text[:3]) * (ts.SLICE_BYTES // 20) + whole(tokenizer, "end") if text else []) + [2]
        assert tuple(row) == (doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_round_trip(spark, tmp_path):
    import pyarrow.parquet as pq
    rows = [(5, "five words are in here"), (1, None), (3, ""), (9, "x " * 20_000), (5, "another five"), (5, "another five"),
            (None, "no id"), (-2, "Ünïcode ' 's <|endoftext|>")]
    docs = docs_of(spark, rows).selectExpr("*", "doc_id as shard")
    path = str(tmp_path / "tokens")
    ts.write_tokens(docs, path, word_tokenizer(), 2)
    enc = ts._encoder(word_tokenizer()).tokenizer
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    expected, start = [], 0
    for doc, text in order:
        ids = whole(enc, text or "") + [2]
        expected.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    digests = sorted(map(tuple, ts.token_digests(spark, path).collect()), key=lambda r: r[1])
    assert digests == [e[:4] for e in expected]
    back = sorted(ts.read_tokens(spark, path).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens, list(r.ids)) for r in back] == [(*e[:3], e[4]) for e in expected]
    files = sorted((tmp_path / "tokens").glob("*.parquet"))
    group = pq.ParquetFile(files[-1]).metadata.row_group(0)
    columns = {group.column(c).path_in_schema: group.column(c) for c in range(group.num_columns)}
    assert all(c.has_offset_index and c.has_column_index for c in columns.values())
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert any("DICTIONARY" in e for e in columns["ids.list.element"].encodings)
    assert ts.tokenize_documents(docs_of(spark, []), word_tokenizer()).count() == 0


# ---- op10 ----------------------------------------------------------------------------

def test_resample_counts_ratios_and_top_k(spark):
    good = [(k, f"fine clear prose number {k} reads well and says much") for k in range(40)]
    bad = [(100 + k, f"buy pills now cheap click {k} here deal win") for k in range(20)]
    rows = good + bad + [(900, None), (901, ""), (902, "x " * 30_000), (7, good[7][1])]
    docs = docs_of(spark, rows).selectExpr("*", "doc_id as log_weight")
    targets = spark.createDataFrame([(k,) for k in [*range(30), None, 3]], "doc_id long")
    hasher = ir.NgramHasher()
    raw, target = np.zeros(ir.BUCKETS), np.zeros(ir.BUCKETS)
    for doc, text in rows:
        n = np.bincount(hasher(text), minlength=ir.BUCKETS)
        raw += n
        target += n * (doc in range(30))
    ratios = ir.log_ratios(raw, target)
    got = ir.resample(docs, targets, share=0.5).collect()
    assert len(got) == len(rows)
    for r in got:
        texts = [t for d, t in rows if d == r.doc_id]
        assert any(r.log_weight == pytest.approx(sum(ratios[b] for b in hasher(t))) for t in texts)   # all n-grams count
    keys = sorted((r.gumbel_key for r in got), reverse=True)
    cut = keys[int(np.ceil(0.5 * len(rows))) - 1]
    assert all(r.kept == (r.gumbel_key >= cut) for r in got)
    assert sum(r.kept for r in got if 100 <= r.doc_id < 120) == 0
    assert ir.resample(docs_of(spark, []), targets, share=0.5).count() == 0
    tempered = [r.log_weight for r in ir.resample(docs, targets, share=0.5, full_weight=10).collect() if r.doc_id == 902]
    assert tempered == [pytest.approx(ratios[hasher("x " * 30_000)].mean() * 10)]
    none = ir.resample(docs, targets.limit(0), share=0.5).collect()
    assert all(r.log_weight == 0 for r in none)


def test_resample_equals_plain_python_models(spark):
    """Weights, noise and choice over the whole given table, from counts, hashes and logarithms of this test's own."""
    import math

    import xxhash
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    mask, odd = (1 << 64) - 1, 0x9E3779B97F4A7C15
    texts = {r.doc_id: r.text for r in docs.collect()}
    targets = set(sorted(texts)[::3])

    def grams(text):
        h = [xxhash.xxh3_64_intdigest(w.lower()) for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
        for a, b in zip(h, h[1:]):
            two = (a * odd & mask) ^ b
            yield ((two ^ two >> 31) * odd & mask) >> 48
        for a in h:
            yield a >> 48

    each = {d: list(grams(t)) for d, t in texts.items()}
    raw = Counter(g for gs in each.values() for g in gs)
    good = Counter(g for d in targets for g in each[d])
    share = sum(good.values()) / sum(raw.values())
    ratio = {g: math.log((good[g] + 10) / (n * share + 10)) for g, n in raw.items()}
    weights = {d: sum(ratio[g] for g in gs) for d, gs in each.items()}
    hashes = {r.doc_id: r.h for r in docs.selectExpr("doc_id", "xxhash64(doc_id, 7) as h").collect()}
    keys = {d: w - math.log(-math.log((((hashes[d] & mask) >> 11) + 0.5) / 2 ** 53)) for d, w in weights.items()}
    best = set(sorted(keys, key=keys.get, reverse=True)[:math.ceil(0.4 * len(keys))])
    got = ir.resample(docs, spark.createDataFrame([(d,) for d in targets], "doc_id long"), share=0.4, seed=7).collect()
    assert len(got) == len(texts) and {r.doc_id for r in got if r.kept} == best
    for r in got:
        assert r.log_weight == pytest.approx(weights[r.doc_id], abs=1e-9) and r.gumbel_key == pytest.approx(keys[r.doc_id], abs=1e-9)


@pytest.mark.parametrize("k", [0, 1, 2, 5, 9, 20])
def test_kth_greatest(spark, k):
    values = [3.5, -1.0, 3.5, 7.25, 0.0, 7.25, -1e9, 2.0, 1e-300]
    got = ir.kth_greatest(spark.createDataFrame([(v,) for v in values], "x double"), "x", k)
    assert got == (sorted(values, reverse=True)[min(k, len(values)) - 1] if k else None)
