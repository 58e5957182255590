"""Intermediate tables in the shared folder the cluster names.

``materialise`` writes a DataFrame once and reads it back. That cuts lineage for
the iterative fits, survives lost executors (nothing lives only in an executor),
and gives Catalyst the true size of the table, so its own broadcast threshold
works on facts instead of estimates.
"""

import tempfile
import uuid

_local_dirs = {}


def scratch_dir(spark):
    """Shared folder from ``spark.checkpoint.dir``; a fresh local one in local mode only."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="swayline-")
    return _local_dirs[app]


def new_path(spark, label="table"):
    """A path in the scratch folder that nothing has used yet."""
    return f"{scratch_dir(spark)}/swayline/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialise(df, label="table"):
    """Write ``df`` to the scratch folder and return the table read back from it."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
