"""Stage boundaries: written, shared, and able to survive the loss of an executor."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def prepared(spark: SparkSession) -> SparkSession:
    """Make sure that workers can import this package and that there is a checkpoint folder.

    The folder is the one the cluster names in ``spark.checkpoint.dir``.  Only a
    local session without that setting gets a temporary one of its own, which goes when the session ends.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="corpusloom-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        sc.setCheckpointDir(shared)
    paths = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder; the lineage ends here.

    A checkpoint keeps what the optimizer has inferred about its rows.  In loops
    that doubles with every round until planning takes longer than the work, so
    the rows are taken up again as a plain table.
    """
    session = prepared(df.sparkSession)
    out = df.checkpoint(eager=True)
    plain = session._jsparkSession.internalCreateDataFrame(out._jdf.queryExecution().toRdd(), out._jdf.schema(), False)
    return type(out)(plain, session)
