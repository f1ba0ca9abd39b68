"""Session settings the plans are written for, and lineage cuts.

Adaptive execution re-plans joins at run time (broadcast when a side turns
out small, split skewed partitions of a hot patient, coalesce small shuffle
partitions). A lineage cut writes to the shared folder named by
``spark.checkpoint.dir``; a folder is only invented for local sessions.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a join before an aggregation on the same key is split too, at the cost of one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # a join on more keys than its tables are stored by needs no exchange
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.session.timeZone": "UTC",
}


def cluster_conf(shuffle_bytes: int, total_cores: int, target_partition_bytes: int = 128 << 20,
                 max_partitions: int = 40_000) -> dict[str, str]:
    """Shuffle and scan sizing for a cluster run, from the bytes that are shuffled.

    ``shuffle_bytes`` is what is left after filters and projections reached the scans (a few
    columns of each event source), not the size of the input. About one ``target_partition_bytes``
    slice per task and at least two waves of the cluster's cores, but no more than
    ``max_partitions``: the driver keeps a status for every pair of map and reduce task, and AQE
    splits partitions that turn out larger.
    """
    parts = min(max_partitions, max(2 * total_cores, -(-shuffle_bytes // target_partition_bytes)))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(256 << 20),
        **SESSION_CONF,
    }


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "trialspark",
                  driver_memory: str = "8g") -> SparkSession:
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", driver_memory)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false"))
    for k, v in SESSION_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the session's ``spark.checkpoint.dir``; invent a temporary one only on a local master."""
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before cutting lineage")
        d = tempfile.mkdtemp(prefix="trialspark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as parquet under the checkpoint folder and read it back: lineage ends here.

    One computation (a reliable ``checkpoint()`` recomputes unless cached), files on
    the shared folder survive lost executors, and later reads prune columns and
    push filters into the scan.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)
