"""Queries of this folder's operators over the given tables."""

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardfit.llm import (
    bpe, cosine_links, language, line_runs, onebit, ordered_minhash, packing, pii, repair, templates, toxicity, warc,
    whitening,
)
from shardfit.llm.common import held_out


def table(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def op1_mixture_packing(spark, d):
    pieces = packing.pack(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048, 1)
    return packing.checksums(pieces)


def op2_feistel_pseudonyms(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, "shardfit test key")


def op3_cosine_links(spark, d):
    return cosine_links.link(table(spark, d, "embeddings"), threshold=0.98)


def op4_dictionary_warc(spark, d):
    back = warc.archive(table(spark, d, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_ordered_minhash(spark, d):
    found = ordered_minhash.classes(table(spark, d, "documents"))
    return found.select(F.col("key").alias("doc_id"), "class_id", "kept")


def op6_language_kernels(spark, d):
    docs = table(spark, d, "documents")
    model = language.fit_languages(docs.where(~held_out()))
    found = language.identify(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op7_page_templates(spark, d):
    return templates.extract(table(spark, d, "pages"))


def op8_one_bit_codes(spark, d):
    return onebit.search(table(spark, d, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op9_toxicity_network(spark, d):
    docs = table(spark, d, "documents")
    model = toxicity.fit_toxicity(docs.where(~held_out()), table(spark, d, "labels"))
    rated = toxicity.rate(docs, model, threshold=0.3)
    return rated.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op10_bpe_codec(spark, d):
    code = bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digests(bpe.decode(bpe.encode(table(spark, d, "documents"), code), code))


def op11_lanczos_whitening(spark, d):
    return whitening.whiten(table(spark, d, "embeddings"), n_components=8)


def op12_line_runs(spark, d):
    kept = line_runs.drop_repeated_lines(table(spark, d, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_suffix_repair(spark, d):
    return repair.report(repair.damaged(table(spark, d, "conversations")), copies="copies")


QUERIES = {f.__name__: f for f in (
    op1_mixture_packing, op2_feistel_pseudonyms, op3_cosine_links, op4_dictionary_warc,
    op5_ordered_minhash, op6_language_kernels, op7_page_templates,
    op8_one_bit_codes, op9_toxicity_network, op10_bpe_codec, op11_lanczos_whitening,
    op12_line_runs, op13_suffix_repair)}

ORACLE: dict[str, str] = {
    "op4_dictionary_warc": """
        with p as (select page_id, coalesce(html, '') as html from pages),
             s as (select page_id, strlen(html) as n, sha1(html) as digest from p),
             h as (select digest, max(page_id) as head, count(*) as copies from s where n >= 1000 group by 1)
        select page_id, n::bigint as payload_bytes, digest as payload_digest,
               case when copies > 1 and head <> page_id then 'revisit' else 'response' end as record_type,
               case when copies > 1 and head <> page_id then head end as refers_to
        from s left join h using (digest)""",
    "op12_line_runs": r"""
        with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
             l as (select r, doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as i from d),
             k as (select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
             s as (select key, max(doc_id) as top, count(*) as n
                   from (select distinct r, doc_id, key from k where length(key) >= 20) group by key having count(*) >= 3),
             j as (select k.*, n is not null and doc_id is distinct from top as gone from k left join s using (key))
        select any_value(doc_id) as doc_id, count(*)::bigint as n_lines, (count(*) filter (where gone))::bigint as n_dropped,
               sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
        from j group by r""",
}
