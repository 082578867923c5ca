"""Session settings the queries need where the caller has made none."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

import quotelens

_SHIPPED: set[str] = set()


def ensure_shared_folder(spark: SparkSession) -> None:
    """Keep the cluster's spark.checkpoint.dir; on a local master without one, use a temporary folder."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return
    if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))


def ship_package(spark: SparkSession) -> None:
    """Send the package to the Python workers once an application, wherever the driver was started."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    folder = os.path.dirname(os.path.abspath(quotelens.__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="spark-"), os.path.basename(folder))
    context.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(folder), os.path.basename(folder)))
