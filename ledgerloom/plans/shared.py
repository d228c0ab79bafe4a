"""The folder that all executors share, and the check that a folder is one."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of our own if all executors run on this machine."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = _own.setdefault("root", tempfile.mkdtemp(prefix="ledgerloom-"))
    return root.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_root(spark)}/ledgerloom/{what}-{uuid.uuid4().hex}"


def check_shared(spark: SparkSession, folder: str) -> None:
    """Refuses a folder that executors on other machines may not see: a relative path on a cluster, or one outside the shared folder."""
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return
    root = shared_root(spark).removeprefix("file://")
    if "://" not in folder and not folder.startswith(f"{root}/"):
        raise RuntimeError(f"{folder} must lie below {root}, the folder that all executors share")
