"""The session that tests, bench and examples share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def session(master: str = "local[8]", **conf: str) -> SparkSession:
    base = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
    }
    return SparkSession.builder.master(master).config(map=base | conf).getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
