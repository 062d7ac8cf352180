"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, uncut


def components(links: DataFrame) -> DataFrame:
    """key and component (its smallest key) of every key in ``links`` (a, b).

    Every round takes the least label among a key's own and its neighbours', then that label's own label, which
    doubles the distance covered. Each round is written to the shared folder, so lineage stays short, and the
    one before is deleted.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = cut(both.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.col("key")).alias("component"), F.lit(True).alias("moved")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("key")).groupBy("a").agg(F.min("component").alias("near"))
        next_ = labels.join(near, F.col("key") == F.col("a")).select("key", "component", F.least("component", "near").alias("to"))
        own = labels.select(F.col("key").alias("to"), F.col("component").alias("far"))
        further = cut(next_.join(own, "to").select("key", F.least("to", "far").alias("component"), (F.least("to", "far") != F.col("component")).alias("moved")), "labels")
        uncut(labels)
        labels = further
        if labels.where("moved").isEmpty():
            uncut(both)
            return labels.select("key", "component")
