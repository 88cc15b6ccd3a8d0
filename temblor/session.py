"""Session settings and getting this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only where that is unset and all runs on this machine, a temporary folder takes its place."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("temblor.shared.dir", None)
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='temblor-')}"
        spark.conf.set("temblor.shared.dir", path)
    return path.rstrip("/")


def ship_package(spark: SparkSession) -> None:
    """Adds this package to the job, once a context, so Python workers import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_temblor_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="temblor-"), "temblor.zip")
    with zipfile.ZipFile(path, "w") as out:
        for top, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    out.write(full, os.path.join("temblor", os.path.relpath(full, root)))
    context.addPyFile(path)
    context._temblor_shipped = True
