"""Session settings for this engine."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def session(name: str = "tidewell", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; anything else is left to the cluster."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, unless their search path has it already."""
    root = Path(__file__).resolve().parent.parent
    on_path = {os.path.realpath(x) for x in os.environ.get("PYTHONPATH", "").split(os.pathsep) if x} | {os.getcwd()}
    context = spark.sparkContext
    if str(root) in on_path or context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    path = Path(tempfile.mkdtemp(prefix="tidewell-")) / "tidewell.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((root / "tidewell").rglob("*.py")):
            z.write(f, f.relative_to(root))
    context.addPyFile(str(path))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; where none is named, a local one, if the master is local too."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tidewell-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own under the shared one."""
    return f"{shared_dir(spark)}/tidewell/{name}-{uuid.uuid4().hex}"
