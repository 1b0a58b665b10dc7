"""Extraction, quotation linking, mixing and the pipeline against brute-force versions."""

import hashlib
import html as htmllib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from runready.llm import html_wrapper as hw
from runready.llm import quote_links, spaced_seeds
from runready.llm import temperature_mix as tm
from runready.llm import token_store as ts
from runready.llm.catalog import ORACLES, op3_html_wrapper, op4_quote_links, op8_temperature_mix, word_tokenizer
from runready.llm.tables import read_table

SF = "/root/testdata/sf0.01"


# ---- op3 -----------------------------------------------------------------------------

def test_extraction_of_all_pages_equals_their_articles(spark):
    source = {r.page_id: r.html for r in read_table(spark, SF, "pages").collect()}
    got = op3_html_wrapper(spark, SF).collect()
    assert len(got) == len(source)
    for r in got:
        page = source[r.page_id]
        article = page[page.index("<article>") + 9:page.index("</article>")]
        blocks = [" ".join(htmllib.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def _site(k, rnd, article=True):
    """A page with template texts that nothing but their constancy gives away."""
    words = lambda n: " ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rnd.randrange(99))
                               for _ in range(n))
    body = [words(rnd.randint(5, 30)) for _ in range(rnd.randint(2, 6))]
    inner = "".join(f"<p>{b}</p>" if rnd.random() < .7 else f"<p><b>{b}</b>" for b in body)
    optional = "<div class=x9>Sale today only</div>" if k % 2 else ""
    content = f"<h1>{words(4)}</h1>" if article else ""
    heading = re.findall(r"<h1>(.*)</h1>", content)
    main = f"<article>{content}{inner}</article>" if article else f"<div class=body>{inner}</div>"
    page = (f"<html><body><header>Top {k}</header><div class=strip>Welcome to our site</div>{optional}"
            f"<nav><a href=/>Home</a></nav>{main}<div class='comments'><p>First! {k}</p></div>"
            f"<form><label>Mail</label><input></form><div id=cookie-notice>We use {k} cookies</div>"
            f"<div class=end>All rights kept by us</div><footer>c {k}</footer><script>var a = '<p>';</script></body></html>")
    return page, "\n".join(heading + body)


@pytest.mark.parametrize("article", [True, False])
def test_constant_nodes_are_template_and_slots_are_content(spark, article):
    rnd = random.Random(2)
    pages = [_site(k, rnd, article) for k in range(24)]
    rows = [(k, f"http://Site.example.com:80/{k}?x=1", page, "x") for k, (page, _) in enumerate(pages)]
    # copies of one page on another host are no template of it
    rows += [(100 + k, f"https://u@copy.example.org/{k}", "<body><p>Same old text</p><p>and more</p></body>", "x") for k in range(3)]
    odd = [(200, None, "<p>no host", "x"), (201, "http://a.example", None, "x"), (201, "http://a.example", "", "x"),
           (None, "http://a.example", "a &amp; b<br>c&nbsp;d <i>e</i>f<div>g", "x"),
           (202, "nonsense", "<div>" * 3000 + "deep" + "</div>" * 10 + "<p>end", "x"),
           (203, "http://b.example", "<table><tr><td>one<td>two<tr><td>three</table><ul><li>i<li>j</ul><!-- c --><p>k &lt", "x")]
    df = spark.createDataFrame(rows + odd, "page_id long, url string, html string, text string")
    got = defaultdict(list)
    for r in hw.extract(df).collect():
        assert r.n_chars == len(r.text)
        got[r.page_id].append(r.text)
    assert [got[k] for k in range(24)] == [[text] for _, text in pages]
    assert all(got[100 + k] == ["Same old text\nand more"] for k in range(3))
    assert got[200] == ["no host"] and got[201] == ["", ""] and got[None] == ["a & b c d ef\ng"]
    assert got[202] == ["deep\nend"] and got[203] == ["one\ntwo\nthree\ni\nj\nk <"]
    assert hw.extract(df.limit(0)).count() == 0


def test_wrapper_merge_does_not_depend_on_partitions(spark):
    rnd = random.Random(4)
    rows = [(f"h{k % 2}", _site(k, rnd, False)[0]) for k in range(40)]
    df = spark.createDataFrame(rows, "host string, html string")
    one = {r.host: r.wrapper for r in hw.induce(df.coalesce(1)).collect()}
    many = {r.host: r.wrapper for r in hw.induce(df.repartition(8)).collect()}
    texts = lambda w: re.findall(r'"([0-9a-f]+\.[0-9a-f]+)"', w)
    assert {h: sorted(texts(w)) for h, w in one.items()} == {h: sorted(texts(w)) for h, w in many.items()}
    assert all(texts(w) for w in one.values())


def test_template_text_beside_many_other_texts_is_found(spark):
    """A notice among 70 paragraphs that differ, in an element whose class is the page's own on every second page."""
    notice, rows = "All stories are kept in our archive", []
    for k in range(40):
        body = "".join(f"<p>story {k} part {j}</p>" for j in range(70))
        name = f" class=post{k}" if k % 2 else ""
        rows.append((k, f"http://long.example/{k}", f"<body><div><p>{notice}</p>{body}</div><section{name}><p>own {k}</p></section></body>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text.split("\n") for r in hw.extract(df).collect()}
    assert got == {k: [*(f"story {k} part {j}" for j in range(70)), f"own {k}"] for k in range(40)}


def test_nodes_cut_from_the_wrapper_keep_their_template_texts(spark, monkeypatch):
    wide = "".join(f"<div class=c{j}><p>Fixed {j}</p></div>" for j in range(30))
    page = lambda k: f"<body>{wide}<section><p>own {k}</p></section></body>"
    tree = hw.as_tree(hw.parse(page(0)), hw._hashes)
    root_only = hw.bare(tree)
    root_only[3] = []
    keys = [[(key, tuple(t)) for t, key, _, _ in hw.placed(hw.as_tree(hw.parse(page(k)), hw._hashes), root_only)] for k in (0, 1)]
    assert len(set(keys[0]) & set(keys[1])) == len(keys[0]) - 1      # all but the page's own text


@pytest.mark.parametrize("copies", [5, 3000])
def test_copies_of_a_page_keep_their_text(spark, copies):
    page = "<body><header>Seen {}</header><article><h1>Head</h1><p>Same old text</p></article></body>"
    rows = [(k, f"http://copy.example/{k}", page.format(k % 7)) for k in range(copies)]
    # a host with copies among other pages still has its template
    rows += [(10_000 + k, f"http://mixed.example/{k}", f"<body><p>Notice</p><div><p>own {max(k, 20)}</p></div></body>") for k in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in hw.extract(df).collect()}
    assert all(got[k] == "Head\nSame old text" for k in range(copies))
    assert all(got[10_000 + k] == f"own {max(k, 20)}" for k in range(40))


@pytest.mark.parametrize("html, text", [
    ("<html><head><title>t</title><body><article><p>text</p></article>", "text"),
    ("<head><title>t<meta name=a><p>text</p>", "text"),
    ("<head><title>t</title>text", "text"),
    ("<head><title>t</title><noscript><img src=x></noscript><script>a</script></head><p>text</p>", "text"),
    ("<select><option>a<option>b</select><p>text</p>", "text"),
    ("<div><select><option>a<option>b</div><p>text</p>", "text"),
    ("<p>text <button>Go<p>more</p>", "text\nGo\nmore"),
    ("<div><noscript></div><p>text</p>", "text"),
    ("<div><svg><path d=x></div><p>text</p>", "text"),
    ("<body>" + "<svg>" * 3000 + "<p>text</p>", "text"),
    ("<button><div>x</div><p>y</button><p>text</p><svg><title>z</title></svg>", "text"),
    ("<button>a<svg><path/></svg>b</button>text</svg> more<script>x = '<p>'", "text more")])
def test_skipped_elements_without_end_tags_take_no_text(html, text):
    assert hw.main_text(html, None) == text


# ---- op4 -----------------------------------------------------------------------------

def brute_threads(messages):
    """Per (conversation, turn): own text, reply_to, root, depth."""
    def cut(text):
        out = []
        for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
            mark = re.match(r"((?:[ \t]*>)*)", line)[1]
            body = re.sub(r"^(?:[ \t]*>)+[ \t]?", "", line)
            if out and out[-1][0] == mark.count(">"):
                out[-1][1].append(body)
            else:
                out.append((mark.count(">"), [body]))
        return [(level, "\n".join(lines)) for level, lines in out]

    norm = lambda u: re.sub(r"[\W_]+", " ", u.lower()).strip()
    units = lambda t: {norm(u) for u in [*re.split(r"\n[ \t]*\n", t), *t.split("\n")]} - {""}
    first, parents = {}, {}
    for conv, turn, _, text in messages:
        if conv is not None and turn is not None and text is not None:
            for level, t in cut(text):
                for u in units(t) if level == 0 else ():
                    first[conv, u] = min(turn, first.get((conv, u), turn))
    votes = defaultdict(Counter)
    for conv, turn, _, text in messages:
        if conv is not None and turn is not None and text is not None:
            for level, t in cut(text):
                for u in units(t) if level else ():
                    if first.get((conv, u), turn) < turn:
                        votes[conv, turn][level, first[conv, u]] += len(u)
    for key, found in votes.items():
        parents[key] = max(found, key=lambda f: (-f[0], found[f], f[1]))[1]
    out = []
    for conv, turn, role, text in messages:
        own = None if text is None else "\n".join(t for level, t in cut(text) if level == 0)
        root, depth = turn, 0
        while (conv, root) in parents:
            root, depth = parents[conv, root], depth + 1
        out.append((conv, turn, role, None if own is None else re.sub(r"^(?:[ \t]*\n)+|(?:\n[ \t]*)+$", "", own),
                    parents.get((conv, turn)), root, depth))
    return Counter(out)


def test_threads_equal_brute_force(spark):
    rnd = random.Random(8)
    messages = []
    for conv in range(6):
        texts = []
        for turn in range(rnd.randint(1, 40 if conv else 80)):
            own = "\n".join(" ".join(rnd.choice("red blue green dog cat sun".split()) for _ in range(rnd.randint(1, 9)))
                            + rnd.choice(["", "!", "..."]) for _ in range(rnd.randint(1, 4)))
            quote = ""
            if texts and rnd.random() < .7:
                lines = rnd.choice(texts[-3:]).split("\n")
                lines = lines[rnd.randrange(len(lines)):]
                quote = "\n".join(rnd.choice([">", "> "]) + line for line in lines) + "\n"
            text = quote + own if rnd.random() < .8 else own + "\n" + quote
            texts.append(text)
            messages.append((conv, turn, rnd.choice(["user", "assistant"]), text.upper() if rnd.random() < .1 else text))
    messages += [(None, 0, "user", "> red"), (0, None, "user", "> red"), (1, 900, None, None), (1, 901, "user", ""),
                 (2, 0, "user", messages[0][3]), (2, 0, "user", messages[0][3]), (3, 902, "user", ">> red\r\n> blue\r\nx" * 500)]
    df = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string").selectExpr("*", "turn as depth")
    got = quote_links.conversations(df).collect()
    assert Counter(map(tuple, got)) == brute_threads(messages) and max(r.depth for r in got) > 5
    assert quote_links.conversations(df.limit(0)).count() == 0


def test_attribution_lines_go_and_plain_conversations_stay(spark):
    df = spark.createDataFrame([(1, 0, "user", "Shall we?"), (1, 1, "assistant", "Sure.\nOn Monday you wrote:\n> Shall we?\nYes.")],
                               "conv_id long, turn long, role string, text string")
    assert quote_links.conversations(df).where("turn = 1").first()[3:] == ("Sure.\nYes.", 0, 0, 1)
    source = Counter((r.conv_id, r.turn, r.role, r.text) for r in read_table(spark, SF, "conversations").collect())
    assert Counter((r.conv_id, r.turn, r.role, r.text) for r in op4_quote_links(spark, SF).collect()) == source


# ---- op8 -----------------------------------------------------------------------------

def test_mix_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    sql = con.sql(ORACLES["op8_temperature_mix"])
    got = op8_temperature_mix(spark, SF)
    assert Counter(map(tuple, got.select(*sql.columns).collect())) == Counter(sql.fetchall())


def brute_mix(rows, weights, seed):
    """(doc_id, epoch) taken, from each source's budget, in md5 order."""
    key = lambda e, d: int(hashlib.md5(f"{seed}|{e}|{'' if d is None else d}".encode()).hexdigest()[:15], 16)
    out = Counter()
    for source, (tokens, budget) in weights.items():
        mine = [(d, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, s in rows if s == source]
        epochs, rest = divmod(budget, tokens)
        for d, _ in mine:
            for e in range(epochs):
                out[d, source, e] += 1
        used = 0
        for k in sorted({key(epochs, d) for d, _ in mine}):
            if used >= rest:
                break
            for d, n in mine:
                if key(epochs, d) == k:
                    out[d, source, epochs] += 1
                    used += n
    return out


@pytest.mark.parametrize("how", [{"target_entropy": 0.9, "budget": 4000}, {"max_repetition": 3.0, "budget": 9000},
                                 {"max_repetition": 2.0}, {"target_entropy": 0.5, "max_repetition": 4.0, "budget": 500}])
def test_mix_equals_brute_force(spark, how):
    rnd = random.Random(6)
    rows = [(k, "w " * rnd.randint(0, 30), rnd.choice("aaaaaabbbc") if k % 50 else None) for k in range(300)]
    rows += [(7, "again seven", "a"), (None, "no id", "a"), (400, None, "b"), (401, "", "empty"), (402, "x " * 3000, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    narrow = df.select("source", tm.word_count(df.text).alias("n_tokens"))
    weights = {r.source: (r.tokens, r.source_budget, r.weight) for r in tm.mixing_weights(
        tm.source_tokens(narrow), how.get("budget"), how.get("target_entropy"), how.get("max_repetition")).collect()}
    assert "empty" not in weights and None in weights
    share = {s: t / sum(w[0] for w in weights.values()) for s, (t, _, _) in weights.items()}
    a = math.log(weights["a"][2] / weights["c"][2]) / math.log(share["a"] / share["c"])      # the exponent found
    for s in share:
        assert weights[s][2] == pytest.approx(share[s] ** a / sum(x ** a for x in share.values()), abs=1e-8)
    p = [w[2] for w in weights.values()]
    entropy = -sum(x * math.log(x) for x in p) / math.log(len(p))
    most = max(b / t for t, b, _ in weights.values())
    if "max_repetition" in how:
        assert most <= how["max_repetition"] + 0.02
    if list(how) == ["max_repetition"]:
        assert min(b / t for t, b, _ in weights.values()) == 1 and most == pytest.approx(2, abs=0.01)
    elif "max_repetition" not in how:
        assert entropy == pytest.approx(how["target_entropy"], abs=1e-6)
    got = tm.mix(df.selectExpr("*", "doc_id as mix_epochs"), seed=9, **how).collect()
    assert Counter((r.doc_id, r.source, r.mix_epoch) for r in got) == brute_mix(
        rows, {s: w[:2] for s, w in weights.items() if w[1]}, 9)
    assert tm.mix(df.limit(0), **how).count() == 0


# ---- pipeline ------------------------------------------------------------------------

def test_pipeline_stages_equal_brute_force(spark):
    from test_text_operators import brute_components, brute_contaminated, whole

    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    bench = [(r.item_id, r.text) for r in read_table(spark, "/root/testdata/sf0.001", "benchmark").collect()]
    leak = bench[0][1].upper()
    extra = spark.createDataFrame(
        [(9000, None, "en", "src0", 0), (9001, "", "en", "src0", 0), (9002, "12 34 %% ##", None, None, 0),
         (9003, f"some words first {leak} and then more", "en", "src1", 0), (None, "a text without an id here", "en", "src1", 0)],
        docs.schema)
    docs = docs.union(extra).selectExpr("*", "doc_id as score", "text as mix_epoch")
    columns, out = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, "/root/testdata/sf0.001"), name)
        assert name == "token_output" or docs.columns == columns
        out[name] = docs.collect()
    before = {r.doc_id for r in out["language_id"]}
    assert not before & {9000, 9001, 9002} and {9003, None} <= before
    parts = brute_components([(r.doc_id, r.text) for r in out["language_id"] if r.doc_id is not None], 5, 80)
    kept = {d for d, (_, c) in parts.items() if d == c} | {None}      # a row without an id stays as a document of its own
    assert {r.doc_id for r in out["near_dedup"]} == kept
    hit = {d for d, _ in brute_contaminated([(r.doc_id, r.text) for r in out["near_dedup"]], bench)}
    assert 9003 in hit and {r.doc_id for r in out["decontamination"]} == kept - hit
    copies = Counter(r.doc_id for r in out["mixing"])
    assert set(copies) == kept - hit and max(copies.values()) <= 3
    enc, start, expected = ts._encoder(word_tokenizer()).tokenizer, 0, []
    for r in sorted(out["mixing"], key=lambda r: (r.doc_id is not None, r.doc_id)):
        ids = whole(enc, r.text) + [2]
        expected.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, out["token_output"]), key=lambda r: r[1]) == expected


def test_pipeline_of_an_empty_table(spark, tmp_path):
    read_table(spark, SF, "documents").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    read_table(spark, SF, "benchmark").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert spaced_seeds.MIN_ITEM < spaced_seeds.WINDOW
