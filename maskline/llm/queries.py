"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskline.llm import ann, chat, html, jaccard, langid, neardup, packing, pieces, tokenfile, toxicity
from maskline.llm.common import crc_mod, light_batches, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_mod("doc_id", 3) == 1)
    model = langid.learn(docs.where("not held_out"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op2_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(table(spark, sf_dir, "embeddings"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", crc_mod("doc_id", 4) == 2)
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 4) != 2).select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.learn(docs.where("not held_out"), labels)
    return toxicity.score(docs, model).drop("text")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, path, decoded=True).drop("text")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), words=4, percent=85)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chat(table(spark, sf_dir, "conversations"))


def _bounded(op):
    @wraps(op)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        light_batches(spark)
        return op(spark, sf_dir)

    return run


def queries() -> dict:
    ops = (op1_language_id, op2_embedding_neardup, op3_toxicity, op4_sentencepiece, op5_nearest_neighbours, op6_token_files, op7_ngram_jaccard, op8_packing, op9_html_text, op10_chat_format)
    return {f.__name__: _bounded(f) for f in ops}


#: Calls are users' turns, results the assistant's next ones; no text of the table is itself JSON.
CHAT_SQL = """
with calls as (select conv_id, turn, text from conversations where role = 'user'),
results as (
  select conv_id, turn - 1 as at, count(*) as n, min(turn) as turn, min(text) as content
  from conversations where role = 'assistant' group by 1, 2),
lines as (
  select c.conv_id, c.turn, 'call' as kind, 'turn-' || c.turn as call_id, coalesce(r.n, 0) as n_results,
    concat_ws('; ', case when c.text is null then 'missing prompt' end,
      case when r.n is null then 'no result' when r.n > 1 then 'several results' end) as problems,
    '{"arguments":{"prompt":' || coalesce(cast(to_json(c.text) as varchar), 'null') || '},"id":"turn-' || c.turn
      || '","name":"reply","result":' || coalesce(cast(to_json(r.content) as varchar), 'null') || '}' as json
  from calls c left join results r on r.conv_id = c.conv_id and r.at = c.turn
  union all
  select r.conv_id, r.turn, 'orphan', 'turn-' || r.at, r.n, 'no call',
    '{"id":"turn-' || r.at || '","result":' || coalesce(cast(to_json(r.content) as varchar), 'null') || '}'
  from results r where not exists (select 1 from calls c where c.conv_id = r.conv_id and c.turn = r.at)
  union all
  select conv_id, turn, 'message', null, 0, '',
    '{"role":' || coalesce(cast(to_json(role) as varchar), 'null') || ',"text":' || coalesce(cast(to_json(text) as varchar), 'null') || '}'
  from conversations where role is null or role not in ('user', 'assistant'))
select conv_id, turn, kind, call_id, cast(0 as integer) as level, n_results, problems, json, problems = '' as valid from lines
"""


#: All pairs of a label, then what links reach.
NEARDUP_SQL = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= 0.93),
reach as (select vec_id, vec_id as r from embeddings union select reach.vec_id, links.b from reach join links on links.a = reach.r),
n as (select a, count(*) as n from links group by 1)
select vec_id, coalesce(max(n.n), 0) as n_links, min(r) as component_id, vec_id = min(r) as kept from reach left join n on n.a = vec_id group by vec_id
"""
#: Words, their runs of four as a set, overlaps of all sets that share one, then what links reach.
JACCARD_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end) as g from w),
n as (select doc_id, count(*) as n from s group by 1),
k as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
links as (select k.a, k.b from k join n x on x.doc_id = k.a join n y on y.doc_id = k.b where 100 * k.k >= 85 * (x.n + y.n - k.k)),
reach as (select doc_id, doc_id as r from documents union select reach.doc_id, links.b from reach join links on links.a = reach.r)
select d.doc_id, coalesce(max(n.n), 0) as n_shingles, min(r) as component_id from reach d left join n on n.doc_id = d.doc_id group by d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_embedding_neardup": NEARDUP_SQL, "op7_ngram_jaccard": JACCARD_SQL, "op10_chat_format": CHAT_SQL}
