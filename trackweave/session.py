"""Session defaults and lineage cutting."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_own_folders: dict[str, str] = {}

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app: str = "trackweave", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution and UTC; cluster sizing stays with the submitter."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names. Only a session of one machine may do without: it gets one
    of its own, as in tests."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _own_folders:
        _own_folders[application] = tempfile.mkdtemp(prefix="trackweave-")
    return _own_folders[application]


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so that a lost executor never recomputes the past."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Give Python tasks this package, as ``--py-files`` would; once per application."""
    context = spark.sparkContext
    package = os.path.dirname(os.path.abspath(__file__))
    if context.applicationId in _shipped or not os.path.isdir(package):
        return
    root, name = os.path.split(package)
    # Built on the driver, handed to the executors by Spark.
    archive = os.path.join(tempfile.mkdtemp(prefix="trackweave-"), name)
    context.addPyFile(shutil.make_archive(archive, "zip", root_dir=root, base_dir=name))
    _shipped.add(context.applicationId)
