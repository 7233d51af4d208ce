"""Cutting lineage in iterative jobs so that lost executors cost a re-read, not a re-run."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Point the context at the shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only in local mode (tests, a laptop) a temporary folder takes its place where that setting is absent; it is removed
    at the end. On a cluster executors could not share such a folder, so there the setting is required.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="quillstone-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    sc.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and go on from there."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def discard(*frames: DataFrame) -> None:
    """Delete the files of frames returned by ``cut`` that nothing reads any more, as all that came of them was cut itself."""
    for df in frames:
        session = df.sparkSession
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            path = session._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)
