"""Importance resampling towards a target's n-gram distribution, in DataFrame functions only.

A text's words are its runs of letters, digits and non-ASCII characters, with A-Z in lower case; its features are all
runs of one to ``longest`` words, joined by a space, repeats counted. A feature falls into one of ``buckets`` by its
CRC-32. Both corpora are counted by bucket (partial counts in the tasks, so at most ``buckets`` rows a task are
shuffled), and a bucket's gain, 1000 times the logarithm of its smoothed target share over its smoothed own share, is a
table of ``buckets`` rows, which is broadcast. A document's weight is the mean gain of its features, and its score the
weight plus Gumbel noise from a hash of ``seed`` and its id; taking the highest scores draws documents without
replacement in proportion to exp(weight / 1000). Ranks come from one distributed sort: a row's place in its sorted
partition plus the rows of the partitions before, of which there are few.

Defined results: a null, empty or wordless text has no features, weight 0 and no rank; a null id has the noise of an
empty one and comes last among equal scores; repeated rows are drawn each by itself, with ranks of their own; ties go
to the smaller id; very long texts are counted whole; without documents there are no rows, and without target texts all
buckets' target counts are 0. Columns other than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PLACE_BITS = 33  # of monotonically_increasing_id, below the partition's number


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), F.lit(_WORD), F.lit(0))


def features(words: Column, longest: int) -> Column:
    """All runs of one to ``longest`` words, as one array."""
    runs = [words]
    for n in range(2, longest + 1):
        tail = F.slice(words, n, F.greatest(F.size(words) - (n - 1), F.lit(0)))
        head = F.slice(runs[-1], 1, F.greatest(F.size(words) - (n - 1), F.lit(0)))
        runs.append(F.zip_with(head, tail, lambda a, b: F.concat(a, F.lit(" "), b)))
    return F.concat(*runs) if longest > 1 else words


def _bucket(feature: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(feature.cast("binary")), F.lit(buckets)).cast("int")


def bucket_counts(docs: DataFrame, text_col: str, longest: int, buckets: int) -> DataFrame:
    """bucket and n, the features that fall into it."""
    found = docs.select(words(F.col(text_col)).alias("words")).select(F.explode(features(F.col("words"), longest)).alias("feature"))
    return found.groupBy(_bucket(F.col("feature"), buckets).alias("bucket")).agg(F.count("*").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str, target_text_col: str, longest: int, buckets: int) -> DataFrame:
    """bucket and gain, one row for every bucket."""
    own = bucket_counts(docs, text_col, longest, buckets).withColumnRenamed("n", "s")
    aim = bucket_counts(target, target_text_col, longest, buckets).withColumnRenamed("n", "t")
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = cut(every.join(own, "bucket", "left").join(aim, "bucket", "left").fillna(0, ["s", "t"]), "bucket-counts")
    sums = both.agg(F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t"))  # one row
    ratio = (F.col("t") + 1).cast("double") * (F.col("all_s") + buckets) / ((F.col("s") + 1).cast("double") * (F.col("all_t") + buckets))
    return both.crossJoin(F.broadcast(sums)).select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def noise(id_col: Column, seed: int) -> Column:
    """Gumbel noise times 1000, floored, from the first 32 bits of the SHA-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def weights(docs: DataFrame, gained: DataFrame, id_col: str, text_col: str, longest: int, buckets: int) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row.

    A row's features stay in its task up to their partial sum, so what is shuffled is one row a document.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), words(F.col(text_col)).alias("words")).withColumn("row", F.monotonically_increasing_id())
    listed = rows.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), features(F.col("words"), longest).alias("features"))
    one = listed.select("row", "doc_id", "n_words", F.explode_outer("features").alias("feature")).withColumn("bucket", _bucket(F.col("feature"), buckets))
    sums = one.join(F.broadcast(gained), "bucket", "left").groupBy("row", "doc_id", "n_words").agg(F.sum("gain").alias("total"), F.count("feature").alias("n_features"))
    # floors go down, in whole numbers
    mean = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0))
    return sums.select("doc_id", "n_words", "n_features", mean.cast("long").alias("weight"))


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    longest: int = 2,
    buckets: int = 10_000,
    percent: int = 25,
    least_words: int = 20,
    seed: int = 7,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs``; rank is null where it is not drawn.

    Of the rows with at least ``least_words`` words, ``percent`` of a hundred (rounded down) are drawn.
    """
    gained = gains(docs, target, text_col, target_text_col, longest, buckets)
    scored = weights(docs, gained, id_col, text_col, longest, buckets).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("fit", F.col("n_words") >= least_words)
    order = [F.col("fit").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    placed = cut(scored.orderBy(*order).select("doc_id", "n_features", "weight", "score", "fit", F.monotonically_increasing_id().alias("place")), "sorted")
    part = F.shiftright("place", _PLACE_BITS)
    parts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if("fit").alias("fits"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each sorted partition
    ahead = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    draws = parts.agg(F.expr("coalesce(sum(fits), 0)").alias("fits")).select(F.expr(f"({percent} * fits) div 100").alias("draws"))
    offsets = ahead.crossJoin(F.broadcast(draws))
    ranked = placed.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", F.col("ahead") + F.col("place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)) + 1)
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("fit") & (F.col("rank") <= F.col("draws")), F.col("rank")).alias("rank"))


def resample_sql(longest: int = 2, buckets: int = 10_000, percent: int = 25, least_words: int = 20, seed: int = 7) -> str:
    """The same in DuckDB's SQL over ``documents`` and ``benchmark``; CRC-32 is computed byte by byte for each distinct feature."""
    def found(name: str, table: str, key: str) -> str:
        upper = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
        runs = ["w", *(f"list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i+{n - 1}], ' '))" for n in range(2, longest + 1))]
        return f"""{name}_words AS (SELECT {key} AS row_id, regexp_extract_all({upper}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {table}),
{name} AS (SELECT row_id, unnest({' || '.join(runs)}) AS f FROM {name}_words)"""

    return f"""
WITH RECURSIVE steps AS (SELECT i AS first, i AS v, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT first, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(v ORDER BY first) AS t FROM steps WHERE k = 8),
{found("own", "documents", "doc_id")},
{found("aim", "benchmark", "item_id")},
names AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM own UNION SELECT f FROM aim)),
hashed AS (SELECT f, xor(4294967295, list_reduce(list_transform(range(1, len(x), 2), lambda i: ('0x' || x[i:i+1])::BIGINT),
           lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT)) % {buckets} AS bucket FROM names, crc),
s AS (SELECT bucket, count(*) AS s FROM own JOIN hashed USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM aim JOIN hashed USING (f) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000.0::DOUBLE * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s)::DOUBLE + {buckets})
          / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0)::DOUBLE + {buckets}))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
sums AS (SELECT row_id AS doc_id, count(*) AS n, sum(gain)::BIGINT AS total FROM own JOIN hashed USING (f) JOIN gains USING (bucket) GROUP BY row_id),
weighed AS (SELECT o.row_id AS doc_id, len(o.w) AS n_words, coalesce(n, 0) AS n_features,
            coalesce((total - ((total % n) + n) % n) // n, 0) AS weight, ('0x' || substr(sha256('{seed}:' || o.row_id), 1, 8))::BIGINT AS h
            FROM own_words o LEFT JOIN sums ON doc_id = o.row_id),
scored AS (SELECT doc_id, n_words >= {least_words} AS fit, n_features, weight, weight + floor(-1000.0::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM weighed),
placed AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS place, ({percent} * count(*) OVER (PARTITION BY fit)) // 100 AS draws FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN fit AND place <= draws THEN place END AS rank FROM placed"""
