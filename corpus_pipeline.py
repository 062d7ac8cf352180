"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), with docs in the columns of the table ``documents``; all but the last return
those columns. A document goes when it holds no letter or reads like no language (a mean probability under
``LEAST_LANGUAGE``), when its toxicity reaches 0.3, when a nearly equal document with a smaller id stays, or when it
holds 0.8 of the five-word shingles of a benchmark item.

Defined results: a null text goes in the first stage, as does an empty one; null ids pass through all stages, and come
first where the smallest id stays; of repeated rows, and of equal texts, one stays; very long texts are read whole;
extra columns, whatever their names, are carried until packing; empty tables pass through. What cannot be learned
rejects nothing, with a warning: without a labelled language every text with a letter stays, and without toxicity
labels of both values every text.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlpit.llm import containment, langid, packing, probminhash, toxicity
from marlpit.llm.common import table
from marlpit.session import cut

LEAST_LANGUAGE = 0.05

#: No stage but decontamination is SQL; the whole is tested stage by stage.
ORACLE_SQL: str | None = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    network = langid.fit(docs.where(langid.fold("doc_id", 5) != 0))
    if network is None:
        warnings.warn("no document has a language: all texts with a letter stay", stacklevel=2)
    return langid.keep_identified(docs, network, least=LEAST_LANGUAGE)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(langid.fold("doc_id", 4) != 2)
    classifier = toxicity.fit(docs, labels)
    if classifier is None:
        warnings.warn("toxicity labels lack one of the two values: all texts stay", stacklevel=2)
    return toxicity.keep_clean(docs, classifier)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return probminhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return containment.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language identification", identify_language),
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
