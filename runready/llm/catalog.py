"""The registered queries ``opN_<name>``: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runready.llm import fim_fenwick
from runready.llm.bayes_minhash import near_duplicates
from runready.llm.best_position import search
from runready.llm.bit_sliced import top_inner_products
from runready.llm.html_wrapper import extract
from runready.llm.importance_resampling import resample
from runready.llm.language_id import predict, train
from runready.llm.license_scan import scan
from runready.llm.quality_divergence import quality_rules
from runready.llm.quote_links import conversations
from runready.llm.spaced_seeds import contaminated
from runready.llm.tables import read_table
from runready.llm.temperature_mix import mix, word_count
from runready.llm.token_store import tokenize_documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def word_tokenizer() -> str:
    """Path of the public word-level tokenizer file."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@_query
def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every whole document, write the token files, read them back: one row per document."""
    return tokenize_documents(read_table(spark, sf_dir, "documents"), word_tokenizer(), end_id=2)


def split_by_id(docs: DataFrame) -> DataFrame:
    """``held_out``: crc32 of the id's text leaves 2 modulo 4 (a null id is not held out)."""
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    return docs.withColumn("held_out", F.coalesce(remainder == 2, F.lit(False)))


@_query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole document, learnt from the documents that are not held out."""
    docs = split_by_id(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    model = train(docs.where(~F.col("held_out") & F.col("doc_id").isNotNull()).select("text", "lang"))
    return predict(docs, model, "doc_id", "held_out")


@_query
def op1_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and divergence verdict of every whole document."""
    return quality_rules(read_table(spark, sf_dir, "documents"))


@_query
def op5_bayes_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on 2-word shingles at similarity 0.8."""
    return near_duplicates(read_table(spark, sf_dir, "documents"), shingle=2, threshold=0.8)


@_query
def op6_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) pair with a substitution-tolerant overlap."""
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


# half the way from natural to equal entropy is near 0.95 for one large source among twenty
MIX = {"target_entropy": 0.95, "max_repetition": 4.0, "seed": 1}


@_query
def op8_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 95 % of the greatest entropy of sources, no source over four times, in
    as many words as the corpus has."""
    docs = read_table(spark, sf_dir, "documents")
    budget = docs.agg(F.sum(word_count(F.col("text")))).first()[0] or 0
    return mix(docs, budget=budget, **MIX).select(
        "doc_id", "source", "mix_tokens", "mix_epoch", "mix_block", "mix_key",
        F.round("mix_weight", 6).alias("mix_weight"))


ORACLES["op8_temperature_mix"] = r"""
with recursive sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as n from documents),
src as (select source, sum(n)::bigint as tokens from sized group by source having sum(n) > 0),
tot as (select sum(tokens)::double as total, count(*) as c from src),
shares as (select list(tokens / total) as s, list(tokens::double) as t, any_value(c) as c, any_value(total) as total
           from src, tot),
ent(i, lo, hi) as (
  select 0, 0.0::double, 8.0::double
  union all
  select i + 1, case when h >= 0.95 * ln(c) - 1e-12 then (lo + hi) / 2 else lo end,
         case when h >= 0.95 * ln(c) - 1e-12 then hi else (lo + hi) / 2 end
  from (select i, lo, hi, c,
          ln(list_sum(list_transform(s, lambda x: pow(x, (lo + hi) / 2))))
          - list_sum(list_transform(s, lambda x: pow(x, (lo + hi) / 2) * ln(pow(x, (lo + hi) / 2))))
            / list_sum(list_transform(s, lambda x: pow(x, (lo + hi) / 2))) as h
        from ent, shares where i < 40)),
rep(i, lo, hi) as (
  select 0, 0.0::double, 1.0::double
  union all
  select i + 1, case when m > 4.0 + 1e-12 then (lo + hi) / 2 else lo end,
         case when m > 4.0 + 1e-12 then hi else (lo + hi) / 2 end
  from (select i, lo, hi,
          list_max(list_transform(s, lambda x: pow(x, (lo + hi) / 2) / (x * total))) * total
          / list_sum(list_transform(s, lambda x: pow(x, (lo + hi) / 2))) as m
        from rep, shares where i < 40)),
exponent as (select greatest((select lo from ent where i = 40), (select lo from rep where i = 40)) as a),
w as (select source, tokens, pow(tokens / total, a) as w from src, tot, exponent),
weights as (select source, tokens, round(w / (select sum(w) from w), 9) as weight from w),
plan as (select source, tokens, weight, round(weight * total)::bigint as given,
                round(weight * total)::bigint // tokens as epochs,
                round(weight * total)::bigint % tokens as rest from weights, tot),
keyed as (
  select d.doc_id, d.source, d.n, epochs, rest, weight,
         ('0x' || substr(md5(concat_ws('|', '1', epochs, coalesce(d.doc_id::varchar, ''))), 1, 15))::bigint as k
  from sized d join plan p on d.source is not distinct from p.source where given > 0),
placed as (
  select *, coalesce(sum(n) over (partition by source order by k range between unbounded preceding and 1 preceding), 0)
            as before from keyed),
taken as (select *, epochs + (case when before < rest then 1 else 0 end) as copies from placed),
rows_ as (select doc_id, source, n, weight, unnest(range(copies)) as mix_epoch from taken where copies > 0)
select doc_id, source, n as mix_tokens, mix_epoch, mix_key >> 48 as mix_block, mix_key, round(weight, 6) as mix_weight
from (select *, ('0x' || substr(md5(concat_ws('|', '1', mix_epoch, coalesce(doc_id::varchar, ''))), 1, 15))::bigint
             as mix_key from rows_)
"""


@_query
def op3_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every whole page."""
    return extract(read_table(spark, sf_dir, "pages"))


@_query
def op10_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, resampled towards those labelled good and not toxic, as many as their share of the labels."""
    labels = read_table(spark, sf_dir, "labels")
    return resample(read_table(spark, sf_dir, "documents"), labels.where("quality = 1 and toxic = 0"), labelled=labels)


@_query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every whole document."""
    return scan(read_table(spark, sf_dir, "documents"))


@_query
def op4_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages without quotes, with the message each one replies to and its thread."""
    return conversations(read_table(spark, sf_dir, "conversations"))


@_query
def op11_best_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all documents for every benchmark item."""
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=20)


ORACLES["op11_best_position"] = r"""
with term as (select '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' as p,
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ' as up, 'abcdefghijklmnopqrstuvwxyz' as low),
docs as (select doc_id, regexp_extract_all(translate(text, up, low), p) as t from documents, term where text is not null),
stat as (select count(*)::bigint as nd, sum(len(t))::bigint as l from docs where len(t) > 0),
tf as (select doc_id, n, w, count(*)::bigint as tf
       from (select doc_id, len(t)::bigint as n, unnest(t) as w from docs) group by doc_id, n, w),
wt as (select w, floor(1000 * ln((2.0::double * nd + 2) / (2.0::double * count(*) + 1)))::bigint as weight from tf, stat group by w, nd),
query as (select item_id, w, count(*)::bigint as times
          from (select item_id, unnest(regexp_extract_all(translate(text, up, low), p)) as w from benchmark, term)
          group by item_id, w),
scored as (select item_id, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * nd) // l))))::bigint as score
           from query join wt using (w) join tf using (w), stat group by item_id, doc_id),
ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
           from scored where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 20
"""


@_query
def op12_fim_fenwick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document in its fill-in-middle form, as digests of the output and of the text rebuilt from it."""
    return fim_fenwick.digests(fim_fenwick.transform(read_table(spark, sf_dir, "documents")))


ORACLES["op12_fim_fenwick"] = r"""
with t as (select doc_id, coalesce(text, '') as text, length(coalesce(text, ''))::bigint as n,
                  sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
g as (select *, ('0x' || substr(h, 1, 8))::bigint % (n + 1) as c1, ('0x' || substr(h, 9, 8))::bigint % (n + 1) as c2,
             ('0x' || substr(h, 17, 8))::bigint % 100 as h3, ('0x' || substr(h, 25, 8))::bigint % 100 as h4 from t),
f as (select doc_id, text, n, least(c1, c2) as a, greatest(c1, c2) as b,
             case when n = 0 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 >= 90 then 'plain'
                  when h4 < 20 then 'spm' else 'psm' end as form from g),
o as (select *, text[:a] as prefix, text[a + 1:b] as middle, text[b + 1:] as suffix from f)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars,
       case when form <> 'plain' then b - a end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
       sha256(text) as restored_sha256
from o
"""


@_query
def op13_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best other vectors for every vector whose id 50 divides."""
    return top_inner_products(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


ORACLES["op13_bit_sliced"] = r"""
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as x from embeddings
           where embedding is not null and list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.x, c.x)::bigint as score
      from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
