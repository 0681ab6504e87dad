"""Folders that the driver and all executors see."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the checkpoint folder that the cluster names, else under the warehouse."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
