"""Session helpers: table access, lineage cuts, and the package on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the executors' Python workers, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_auditloom_shipped", False):
        return
    sc._auditloom_shipped = True
    root = Path(__file__).resolve().parent
    handle, name = tempfile.mkstemp(prefix="auditloom-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir`` (a file or a directory of parts)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one the session names in ``spark.checkpoint.dir``.

    Only a session that runs in this one process (a ``local`` master, as in tests)
    gets a temporary folder where none is named; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master.startswith("local") and not sc.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="auditloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read from there.

    The folder is the one the session names in ``spark.checkpoint.dir``, shared by
    all executors, so a lost executor loses nothing (see ``shared_folder``). The result's plan carries neither
    the constraints nor the statistics of the plan that made it: in loops these grow
    with every round until planning takes longer than the work.
    """
    shared_folder(df.sparkSession)
    written = df.checkpoint(eager=True)._jdf
    plain = df.sparkSession._jsparkSession.internalCreateDataFrame(written.queryExecution().toRdd(), written.schema(), False)
    return DataFrame(plain, df.sparkSession)
