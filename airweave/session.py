"""What a session needs: the package on its workers, and a folder that they all share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from functools import lru_cache

from pyspark.sql import SparkSession


@lru_cache(8)
def _shipped(app: str, spark: SparkSession) -> None:
    here = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="airweave-", suffix=".zip")
    with os.fdopen(fd, "wb") as f, zipfile.ZipFile(f, "w") as z:
        for d, _, names in os.walk(here):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(d, n), os.path.relpath(os.path.join(d, n), os.path.dirname(here)))
    spark.sparkContext.addPyFile(path)


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once for each application."""
    _shipped(spark.sparkContext.applicationId, spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; our own only where it is unset and all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or _own_dir()).rstrip("/")


@lru_cache(1)
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="airweave-")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/airweave-{name}-{uuid.uuid4().hex}"
