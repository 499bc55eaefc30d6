"""Session construction and lineage helpers.

Nothing here holds global state: every operator takes DataFrames and
returns DataFrames. ``get_spark`` is a convenience for tests, the bench
and scripts; library code never creates a session on its own.
"""

from __future__ import annotations

import contextlib
import pathlib
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale. AQE re-plans at runtime: it coalesces
# small shuffle partitions, turns a sort-merge join into a broadcast join
# when the measured shuffle output of one side is below the adaptive
# threshold (that measurement is the size check for every join whose
# side is data-dependent), and splits skewed join partitions.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # independent fits run side by side, each in a scheduler pool of its own
    "spark.scheduler.mode": "FAIR",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def cluster_conf(input_bytes: float, target_partition_bytes: float = 256 * 2**20,
                 executors: int | None = None, cores_per_executor: int = 4) -> dict:
    """Partition sizing for a cluster run, from the input volume.

    Scan splits and shuffle partitions are sized to ``target_partition_bytes``
    (256 MiB: fits executor memory with room for aggregation buffers and
    sorts, and keeps the task count manageable). The shuffle partition count
    is an upper bound: AQE coalesces small partitions after each stage and
    splits skewed ones. For 100 TB of input this gives about 400k shuffle
    partitions before coalescing.
    """
    n = max(1, int(input_bytes // target_partition_bytes))
    conf = {
        "spark.sql.files.maxPartitionBytes": str(int(target_partition_bytes)),
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(int(target_partition_bytes)),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(int(4 * target_partition_bytes)),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    }
    if executors:
        conf["spark.default.parallelism"] = str(executors * cores_per_executor * 3)
    return conf


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "sparkwright", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the scale settings applied."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in SCALE_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster.

    Reads ``spark.checkpoint.dir`` from the session. Where it is unset, a
    ``local`` session (tests, the bench) gets a private folder of its own; on
    any other master this raises, because a folder of one machine is not
    visible to the other executors.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a shared folder on master {master}")
        d = tempfile.mkdtemp(prefix="sparkwright-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss), never localCheckpoint."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


SCRATCH = "sparkwright.scratch.dir"


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Intermediates saved inside go into a folder of their own under the shared
    checkpoint folder, which is deleted at the end.

    Results are lazy and read these files: write or collect them inside. Gives the folder's path.
    """
    path = f"{checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
    before = spark.conf.get(SCRATCH, None)
    spark.conf.set(SCRATCH, path)
    try:
        yield path
    finally:
        if before is None:
            spark.conf.unset(SCRATCH)
        else:
            spark.conf.set(SCRATCH, before)
        # through Hadoop's file system, so that any shared store is reached
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def save_intermediate(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` as parquet under the shared checkpoint folder and read it back.

    The re-read plan starts at the files, so later stages do not recompute
    (or lose with an executor) the lineage before this point. Each save has a
    path of its own: an earlier frame saved under the same name, or by another
    session, stays readable.
    """
    base = df.sparkSession.conf.get(SCRATCH, None) or f"{checkpoint_dir(df.sparkSession).rstrip('/')}/tables"
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)


def ship_library(spark: SparkSession) -> None:
    """Hand the library's modules to Python workers, once per application: a zip
    that Spark distributes (as ``--py-files`` does), also to executors that start later."""
    sc = spark.sparkContext
    if getattr(sc, "_sparkwright_shipped", False):
        return
    package = pathlib.Path(__file__).resolve().parent
    path = pathlib.Path(tempfile.mkdtemp(prefix="sparkwright-py-")) / "sparkwright_py.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, str(f.relative_to(package.parent)))
    sc.addPyFile(str(path))
    sc._sparkwright_shipped = True
