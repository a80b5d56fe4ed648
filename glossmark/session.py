"""Session helpers: a local session for tests, the shared scratch folder, spreading of small inputs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, app: str = "glossmark") -> SparkSession:
    """A session for tests and benches; on a cluster use the session that is there."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder name in the folder that all executors share.

    The cluster names that folder in ``spark.checkpoint.dir``; a temporary folder of this machine is
    used only where the setting is absent, as in local tests.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    folder = f"{base.rstrip('/')}/glossmark-{what}-{uuid.uuid4().hex}"
    _folders.append(folder)
    return folder


def spread(df: DataFrame) -> DataFrame:
    """Repartition an input that has fewer partitions than the cluster has cores.

    Files with few row groups give few tasks; Python stages over them would leave cores idle.
    Inputs with enough partitions are returned as they are, without a shuffle. So are streams, and plans with an
    exchange of their own, whose partitions are only known by running them.
    """
    if df.isStreaming or df._jdf.queryExecution().executedPlan().nodeName() == "AdaptiveSparkPlan":
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


_held: list[DataFrame] = []
_folders: list[str] = []


def hold(df: DataFrame) -> DataFrame:
    """Persist a frame that the result reads several times; ``release`` frees it when the results have been read."""
    _held.append(df.persist())
    return df


def release() -> None:
    """Free all that was held. Results made before are still right: they would be computed anew."""
    while _held:
        _held.pop().unpersist()


def clean(spark: SparkSession) -> None:
    """Free all that was held and delete what was written to the shared folder. Results made before can be read no more."""
    release()
    while _folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(_folders.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
