"""Session defaults, shipping of the package to executors, lineage cuts."""

from __future__ import annotations

import io
import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED = "strataline_shipped"


def build_session(app: str = "strataline", master: str | None = None, cpus: int | None = None) -> SparkSession:
    """A session with the settings the engine expects; everything else is left to the cluster."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if cpus:
        b = b.config("spark.sql.shuffle.partitions", str(max(8, cpus)))
    return prepare(b.getOrCreate())


def _package_zip() -> bytes:
    root = Path(__file__).resolve().parent
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    return out.getvalue()


def prepare(spark: SparkSession) -> SparkSession:
    """Make the package importable in the Python workers, wherever they run.

    The archive is handed out by the driver's own file server, so no folder has to be shared.
    """
    sc = spark.sparkContext
    if getattr(sc, _SHIPPED, False):
        return spark
    folder = tempfile.mkdtemp(prefix="strataline-ship-")
    path = os.path.join(folder, "strataline_pkg.zip")
    Path(path).write_bytes(_package_zip())
    sc.addPyFile(path)
    setattr(sc, _SHIPPED, True)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a local one only where none is named and everything runs on this machine."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="strataline-ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there (survives lost executors)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
