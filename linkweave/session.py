"""Session helpers: where checkpoints go and how a local session is built."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, app: str = "linkweave", **conf: str) -> SparkSession:
    """A session for tests and for the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def small_batches(spark: SparkSession, most_bytes: int = 1 << 20) -> None:
    """From now on the session's rows go to Python in Arrow batches of about `most_bytes`, unless it names a size itself.

    A task holds its batch outside the heap several times over: as vectors while they grow, as the message to Python and in
    Python. What batches of many MB leave behind there adds up over the life of an executor."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(most_bytes))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, or a folder in the warehouse where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point the context at the shared folder named by the cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))


def staged(df: DataFrame) -> DataFrame:
    """Write the rows as Parquet in the shared folder and read them back: a cut lineage that survives lost executors."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = spark.conf.get(key, "false")
    spark.conf.set(key, "true")  # what was shuffled for the write has no reader left after it
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, held)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a `staged` table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/staged-" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so a lost executor does not replay a whole loop."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, max_rows: int = 200_000, max_bytes: int = 32 << 20) -> DataFrame:
    """A lookup side expected to be small (models, ranges per dataset): written once, measured, and only
    broadcast when rows and bytes stay within the bounds; otherwise the join shuffles with AQE's skew handling."""
    stage = checkpointed(df)
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in stage.columns])))
    rows, held = stage.agg(F.count("*"), F.sum(size)).first()
    return F.broadcast(stage) if rows <= max_rows and (held or 0) <= max_bytes else stage
