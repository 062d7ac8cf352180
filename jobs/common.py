"""What the jobs share: config files and the session of a command line."""

from __future__ import annotations

import json
import logging
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from marlpit.session import ship

LOG = logging.getLogger("jobs")


def config(path: str | None, default: str) -> dict[str, Any]:
    """The settings of a JSON file, over those of the file beside the job; unknown names are an error."""
    held = json.loads((Path(__file__).parent / default).read_text(encoding="utf-8"))
    if path:
        own = json.loads(Path(path).read_text(encoding="utf-8"))
        if unknown := set(own) - set(held):
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        held |= own
    return held


def session(name: str) -> SparkSession:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    return spark
