"""Session helpers and table access."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "corpusmill", cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that tests and benchmarks use; clusters bring their own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Rows and bytes of an Arrow batch that goes to a Python worker, in place of the session's defaults of 10000 rows and 64 MB.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and by bytes, so that a worker's memory is that of a batch however many or long a task's rows are. A session that has chosen its own number of rows keeps its settings."""
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, str(BATCH_ROWS))
        spark.conf.set(_BYTES, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table. Only Spark's reader touches the path, so any Hadoop filesystem works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder shared by driver and executors, as the cluster names it in spark.checkpoint.dir.

    In local mode a folder under the warehouse stands in where the setting is absent; a cluster without it is refused,
    as other machines would not see the driver's folders.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.corpusmill.root", None)
        if not root:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that all machines share")
            root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/corpusmill-shared"
            spark.conf.set("spark.corpusmill.root", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder for one written intermediate table."""
    return f"{shared_root(spark)}/corpusmill/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write `df` under the shared folder and read it back: the lineage ends at files every executor sees."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def saved_rows(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """`saved`, and the number of rows, observed while they are written."""
    seen = Observation(label)
    out = saved(df.observe(seen, F.count("*").alias("rows")), label)
    return out, seen.get["rows"]


def written(df: DataFrame, label: str) -> DataFrame:
    """`saved` for a step that has shuffled much of the input: what it shuffled is released, so that a run of many such steps keeps to its share of the disks."""
    out = saved(df, label)
    release(df.sparkSession)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written intermediate tables once everything made from them is itself written."""
    for t in tables:
        spark, path = t.sparkSession, t._written_path
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let the driver's JVM drop what it no longer refers to; executors then delete the shuffle files of finished steps.

    Spark deletes a shuffle's files once the driver has collected its handle, by itself every half hour; a plan of many shuffles would hold all of them until then.
    """
    spark.sparkContext._jvm.System.gc()


def sized_join(left: DataFrame, right: DataFrame, on: list[str], how: str, right_bytes: int, limit: int = 64 << 20) -> DataFrame:
    """Join with the right side broadcast if its measured size is under `limit`, else by shuffle."""
    return left.join(F.broadcast(right) if right_bytes <= limit else right, on, how)
