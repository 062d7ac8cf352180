"""Files by key: written whole or not at all."""

import pytest
from pyspark.sql import functions as F

from marlpit.sources.mdfiles import export_markdown


def held(folder):
    return {p.name: p.read_text() for p in folder.iterdir()}


def test_files_by_key(spark, tmp_path):
    rows = spark.createDataFrame([("a", "one"), ("b/c d", "zwei ä"), ("a", "two"), (None, "x"), ("n", None), ("e", "")], "pk string, text string").repartition(3)
    export_markdown(rows, f"file://{tmp_path}/out")
    assert held(tmp_path / "out") == {"a.md": "two", "b%2Fc%20d.md": "zwei ä", "e.md": ""}
    export_markdown(spark.createDataFrame([("a", "new"), ("z", "more")], "pk string, text string"), f"file://{tmp_path}/out")
    assert held(tmp_path / "out") == {"a.md": "new", "b%2Fc%20d.md": "zwei ä", "e.md": "", "z.md": "more"}
    export_markdown(rows.limit(0), f"file://{tmp_path}/none")


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    export_markdown(spark.createDataFrame([("k1", "old")], "pk string, text string"), f"file://{tmp_path}/out")
    text = F.when(F.col("id") == 77, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.lit("new"))
    rows = spark.range(100).repartition(4).select(F.concat(F.lit("k"), "id").alias("pk"), text.alias("text"))
    with pytest.raises(Exception, match="lost"):
        export_markdown(rows, f"file://{tmp_path}/out")
    assert held(tmp_path / "out") == {"k1.md": "old"}
