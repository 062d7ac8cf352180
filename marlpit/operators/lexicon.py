"""Which words of a large lexicon occur in texts, all words in one pass over each text.

``profile`` tests each keyword by an expression of its own, which suits some hundred words. Here the lexicon is a table of
any size: it becomes automata over all of its words (Aho-Corasick), each of at most ``block_chars`` characters of words,
which is what is sent to the tasks at once; a larger lexicon takes several passes. Words are compared as substrings, in
lower case, and overlapping words all count, as in ``profile``.

Defined results: null texts hold nothing, empty and null words are in nothing, repeated words of a kind count once;
repeated rows are rows each by itself; ids are carried, null too; empty tables give no hits, or counts of 0.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

BLOCK_CHARS = 8_000_000


def blocks_of(lexicon: DataFrame, word_col: str = "word", block_chars: int = BLOCK_CHARS) -> Iterator[list[str]]:
    """The different words, in lower case, in lists of at most ``block_chars`` characters; one list is held at a time."""
    held: list[str] = []
    size = 0
    for row in lexicon.select(F.lower(word_col).alias("w")).where("w is not null and w <> ''").distinct().toLocalIterator():
        if held and size + len(row["w"]) > block_chars:
            yield held
            held, size = [], 0
        held.append(row["w"])
        size += len(row["w"])
    if held:
        yield held


def _automaton(words: Iterable[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for w in words:
        found.add_word(w, w)
    found.make_automaton()
    return found


#: The automaton that a worker built last; its tasks of one query share it.
_BUILT: dict[int, object] = {}


def hits(docs: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text", word_col: str = "word", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """row, id and words (different ones, sorted) of every row of ``docs`` that holds any word, for each block of the lexicon.

    ``row`` tells rows with equal ids apart.
    """
    spark = docs.sparkSession
    ship(spark)
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("text"))
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", numbered.schema["id"].dataType), T.StructField("words", T.ArrayType(T.StringType()))])
    out = None
    for words in blocks_of(lexicon, word_col, block_chars):
        sent = spark.sparkContext.broadcast(words)

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            from marlpit.operators import lexicon as own

            if sent.value is not own._BUILT.get("words"):
                own._BUILT.update(words=sent.value, automaton=own._automaton(sent.value))
            automaton = own._BUILT["automaton"]
            for b in batches:
                found = [sorted({w for _, w in automaton.iter(t)}) if t else [] for t in b.column(2).to_pylist()]
                keep = pa.array([bool(x) for x in found])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.string()))], names=schema.names).filter(keep)

        part = numbered.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def counts(docs: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind_col: str = "kind", word_col: str = "word", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """id, kind and n of every row and kind that it holds words of: how many different ones, as the scores of ``profile`` count them."""
    found = hits(docs, lexicon, id_col, text_col, word_col, block_chars).select("row", "id", F.explode("words").alias("word"))
    kinds = lexicon.select(F.col(kind_col).alias("kind"), F.lower(word_col).alias("word")).distinct()
    return found.join(kinds, "word").groupBy("row", "id", "kind").agg(F.count("*").alias("n")).select("id", "kind", "n")
