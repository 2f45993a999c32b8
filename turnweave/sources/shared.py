"""Tables between steps: written once to the folder that all machines share, and read again; joins with counted keys; bounds of batches.

What follows a stored table has a short plan, reads only the columns it needs, and starts
from files when an executor is lost. Stored tables are deleted when the session's JVM ends.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines of the session share: its ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder will do on one machine only; a cluster's session is refused.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared one; deleted when the session's JVM ends."""
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder, and read again."""
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_with(df: DataFrame, *measures: Column) -> tuple[DataFrame, dict]:
    """``df`` stored, and these aggregates of its rows, taken while they are written."""
    seen = Observation()
    out = stored(df.observe(seen, *measures))
    return out, seen.get


#: Rows and bytes of one Arrow batch between the JVM and Python. Texts can be long, so
#: that the library default of 10,000 rows could need gigabytes for one batch.
BATCH_ROWS, BATCH_BYTES = 500, 64 << 20


def bound_batches(df: DataFrame, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Bound the Arrow batches of the session that will run ``df``; the bounds stay set, as the plan runs later."""
    conf = df.sparkSession.conf
    for name, value in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        if int(conf.get(f"spark.sql.execution.arrow.{name}").rstrip("b")) != value:
            conf.set(f"spark.sql.execution.arrow.{name}", str(value))


#: No more keys than this are hot in any table; a key of fewer rows than the second is never.
HOT_KEYS, HOT_ROWS = 10_000, 1000


def join_counted(rows: DataFrame, classes: DataFrame, keys: list[str], spread: list[str], total: int, most: int) -> DataFrame:
    """``rows`` left joined with ``classes`` (one row a key, with its number ``n`` of rows, ``most`` at most; stored).

    A key with more than ``total / HOT_KEYS`` rows is dealt to as many tasks as it has
    times that number, by a hash of the columns ``spread``. There cannot be more than
    ``HOT_KEYS`` such keys, and so they are broadcast to mark their rows. Rows with a
    null in a key meet nothing and are dealt evenly.
    """
    bound = max(HOT_ROWS, total // HOT_KEYS)
    place = F.xxhash64(*spread)
    null = F.lit(False)
    for key in keys:
        null = null | F.col(key).isNull()
    apart = F.when(null, (place % 1_000_003).cast("int"))
    if most <= bound:
        left = rows.withColumn("_salt", F.coalesce(apart, F.lit(0)))
        return left.join(classes.withColumn("_salt", F.lit(0)), [*keys, "_salt"], "left").drop("_salt")
    slices = F.ceil(F.col("n") / F.lit(bound)).cast("int")
    hot = classes.where(F.col("n") > bound).select(*keys, slices.alias("_slices"))
    salt = F.coalesce(apart, F.pmod(place, F.col("_slices")).cast("int"), F.lit(0))
    left = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).drop("_slices")
    right = classes.withColumn("_salt", F.explode(F.sequence(F.lit(0), slices - 1)))
    return left.join(right, [*keys, "_salt"], "left").drop("_salt")
