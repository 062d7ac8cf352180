"""The queries opN_<name> over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import table


def op1_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import page_number, read_archives, write_archives

    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    read = read_archives(spark, path, keep_payload=False)
    lost = F.raise_error(F.format_string("gap in %s at %d: %s", "file", "offset", "gap_reason")).cast("boolean")
    read = read.where(F.when(F.col("gap_reason").isNull(), F.lit(True)).otherwise(lost))  # of its own archives nothing may be lost
    return read.select(page_number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_number("refers_to").alias("refers_to"))


def op2_byte_gru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, fold, identify

    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs.where(fold("doc_id", 5) != 0)))
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "positions")


def op3_cnn_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fold
    from .toxicity import fit, scores

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = scores(docs, fit(docs, labels.where(fold("doc_id", 4) != 2)))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op4_probminhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .probminhash import classes

    return classes(table(spark, sf_dir, "documents"))


def op5_shard_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shardtable import place

    docs = table(spark, sf_dir, "documents").select("doc_id")
    return place(docs, "doc_id", [f"shard-{i:04d}" for i in range(256)])


def op6_minimum_cut_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmlcut import extract, fit

    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit(pages))


def op7_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import scan

    return scan(table(spark, sf_dir, "documents"))


def op8_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .colhash import search

    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op9_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .containment import find

    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resample import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_jaccard_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccardjoin import join

    return join(table(spark, sf_dir, "documents"))


#: What ``licences_planted`` puts in place of texts, by doc_id % 8: how, which licence, what is found.
_PLANTED = {0: ("dated", "MIT", "MIT"), 1: ("capitals", "ISC", "ISC"), 2: ("undated", "BSD-3-Clause", "BSD-3-Clause"), 3: ("more", "MIT", None), 4: ("dated", "GPL-3.0", "GPL-3.0")}


def licences_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence scan over the documents with licences in place of five in eight texts, in several dresses."""
    from .licences import KNOWN, full_texts, scan

    known = {k: v[1] for k, v in (KNOWN | full_texts()).items()}
    dress = {
        "dated": lambda x: F.concat(F.lit("Copyright (c) 2001 "), "source", F.lit("\n\n" + x)),
        "undated": lambda x: F.concat(F.lit("Copyright The "), "source", F.lit(" Authors. All rights reserved.\n" + x)),
        "capitals": lambda x: F.concat(F.lit("(C) 1999 "), "lang", F.lit("\n"), F.upper(F.lit(x))),
        "more": lambda x: F.concat(F.lit(x + "\nand "), "lang"),
    }
    text = F.col("text")
    for k, (how, name, _) in _PLANTED.items():
        text = F.when(F.pmod("doc_id", F.lit(8)) == k, dress[how](known[name])).otherwise(text)
    return scan(table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))).select("doc_id", "licence")


_PLANTED_SQL = "SELECT doc_id, CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN '{found}'" for k, (_, _, found) in _PLANTED.items() if found) + " END AS licence FROM documents"

_ALL = (op1_warc_roundtrip, op2_byte_gru_language, op3_cnn_toxicity, op4_probminhash_classes, op5_shard_table, op6_minimum_cut_text, op7_licence_digests, op8_collision_search, op9_benchmark_containment, op10_pack_sequences, op11_importance_resampling, op12_jaccard_metric_join, licences_planted)

_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)"""


# All articles of the table are headings and paragraphs in an article element, without notices or comments inside.
_ARTICLE_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_replace(replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '<br>', ' '), '</?b>', '', 'g') AS t FROM pages),
b AS (SELECT page_id, url, list_filter(list_transform(regexp_split_to_array(t, '</?(p|h1)>'),
      lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(replace(x, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') AS parts FROM a)
SELECT page_id, url, array_to_string(parts, chr(10)) AS text, length(array_to_string(parts, chr(10))) AS n_chars FROM b"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    from .containment import find_sql
    from .jaccardjoin import join_sql
    from .licences import scan_sql
    from .probminhash import classes_sql
    from .resample import resample_sql

    return {"op1_warc_roundtrip": _WARC_SQL, "op4_probminhash_classes": classes_sql(), "op6_minimum_cut_text": _ARTICLE_SQL, "op7_licence_digests": scan_sql(), "op9_benchmark_containment": find_sql(), "op11_importance_resampling": resample_sql(), "op12_jaccard_metric_join": join_sql(), "licences_planted": _PLANTED_SQL}
