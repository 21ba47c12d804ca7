"""The queries ``opN_<name>``: each operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import ship
from . import bpe, jaccard_join, nn_descent, omh, packing, pii, preference, token_counts, toxicity, warc

#: A stand-in; a deployment passes a secret of its own.
PII_KEY = "a key for tests"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.edit_report(_table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, bpe.default_vocabulary(), decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_counts.count_sections(docs, bpe.default_vocabulary(), rule="first")
    return out.select("doc_id", "section", "sec_start", "sec_end", F.col("tokens").cast("long").alias("n_tokens"), "doc_tokens")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", "severity", "p_toxic", "grade", (F.col("p_toxic") >= toxicity.REJECT).alias("rejected"))


def op5_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preference.counterfactual_pairs(preference.conversations(_table(spark, sf_dir, "conversations")))
    out = preference.format_pairs(pairs, keep=("conv_id",))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select(
        "conv_id", F.col("prompt_turns").cast("long").alias("prompt_turns"), "prompt", "chosen", spans("chosen_spans").alias("chosen_loss"), "rejected", spans("rejected_spans").alias("rejected_loss")
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.derive(warc.responses(_table(spark, sf_dir, "pages")))
    return out.select("page_id", "type", "record_id", "refers_to", "target_uri", "content_length", "block_digest", "source_payload_digest", "block")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = packing.pack(docs, bpe.default_vocabulary(), with_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.link(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.pseudonymize(docs, PII_KEY, found="found")
    return out.select("doc_id", F.size("found").cast("long").alias("n_found"), "text")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_table(spark, sf_dir, "documents"), k=4, percent=85)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


#: Components of the table ``link(u, w)``, which holds both directions, over the ids of ``node(id)``.
_REACH = "reach(u, w) as (select id, id from node union select r.u, l.w from reach r join link l on r.w = l.u), least as (select u, min(w) as component_id from reach group by u)"

SQL = {
    "op5_preference": """
with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
        row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as i,
        count(*) over (partition by conv_id) as n from conversations where conv_id is not null),
    own as (select conv_id, i, n, role, text, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) as piece from t),
    ends as (select * from own where i = n - 1),
    bad as (select conv_id, i, role, text, piece from own where i < n - 1
        union all select a.conv_id, a.i, b.role, b.text, b.piece from ends a join ends b on b.conv_id = xor(a.conv_id, 1)),
    same as (select o.conv_id, coalesce(min(o.i) filter (where b.i is null or o.role <> b.role or o.text <> b.text), max(o.n)) as lcp
        from own o left join bad b on o.conv_id = b.conv_id and o.i = b.i group by o.conv_id),
    good_at as (select o.*, s.lcp, coalesce(sum(length(piece)) over (partition by o.conv_id, o.i >= s.lcp order by o.i rows between unbounded preceding and 1 preceding), 0) as before
        from own o join same s on o.conv_id = s.conv_id),
    bad_at as (select o.*, s.lcp, coalesce(sum(length(piece)) over (partition by o.conv_id, o.i >= s.lcp order by o.i rows between unbounded preceding and 1 preceding), 0) as before
        from bad o join same s on o.conv_id = s.conv_id),
    g as (select conv_id, string_agg(piece, '' order by i) filter (where i < lcp) as prompt, string_agg(piece, '' order by i) filter (where i >= lcp) as chosen,
        string_agg((before + 13 + length(role)) || '-' || (before + 23 + length(role) + length(text)), ',' order by i) filter (where i >= lcp and role = 'assistant') as chosen_loss
        from good_at group by conv_id),
    b as (select conv_id, string_agg(piece, '' order by i) filter (where i >= lcp) as rejected,
        string_agg((before + 13 + length(role)) || '-' || (before + 23 + length(role) + length(text)), ',' order by i) filter (where i >= lcp and role = 'assistant') as rejected_loss
        from bad_at group by conv_id)
select s.conv_id, cast(s.lcp as bigint) as prompt_turns, coalesce(prompt, '') as prompt, coalesce(chosen, '') as chosen, coalesce(chosen_loss, '') as chosen_loss,
    coalesce(rejected, '') as rejected, coalesce(rejected_loss, '') as rejected_loss
from same s left join g on s.conv_id = g.conv_id left join b on s.conv_id = b.conv_id
""",
    "op8_nn_descent": f"""
with recursive node as (select vec_id as id from embeddings),
    v as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings where label is not null and embedding is not null and len(embedding) > 0),
    f as (select * from v where len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
    link as (select a.vec_id as u, b.vec_id as w from f a join f b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.93),
    {_REACH}
select e.vec_id, (select count(*) from link where u = e.vec_id) as n_links, component_id, e.vec_id = component_id as kept from embeddings e join least on e.vec_id = least.u
""",
    "op10_jaccard_join": f"""
with recursive node as (select doc_id as id from documents),
    w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words from documents),
    s as (select doc_id, case when len(words) >= 4 then list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')))
        when len(words) > 0 then [array_to_string(words, ' ')] else [] end as shingles from w),
    u as (select doc_id, len(shingles) as n, unnest(shingles) as shingle from s),
    shared as (select a.doc_id as u, b.doc_id as w, any_value(a.n) as na, any_value(b.n) as nb, count(*) as same from u a join u b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
    link as (select u, w from shared where 100 * same >= 85 * (na + nb - same)),
    {_REACH}
select s.doc_id, cast(len(shingles) as bigint) as n_shingles, component_id from s join least on s.doc_id = least.u
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
