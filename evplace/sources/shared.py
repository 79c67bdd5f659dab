"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


#: Temporary folders of sessions that name no shared one, by application.
_temporary: dict[str, str] = {}


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; where that is unset, in a temporary folder on one machine (tests), an error on a cluster."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        d = _temporary[app] = _temporary.get(app) or "file://" + tempfile.mkdtemp(prefix="evplace-")
    return f"{d.rstrip('/')}/evplace-{name}-{uuid.uuid4().hex}"
