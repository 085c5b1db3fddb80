"""What the corpus operators share: staging, shipping and Arrow batching."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch. Texts may hold megabytes, so batches stay short.
BATCH_ROWS = 512
BATCH_BYTES = 32 << 20

#: Whether Spark deletes shuffle files as soon as the query that wrote them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_shipped: set[str] = set()
#: Paths that stage() wrote and nothing has deleted yet.
_staged: list[str] = []


def prepare(spark: SparkSession) -> None:
    """Sends this package to the Python workers and keeps Arrow batches short."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    top = os.path.dirname(root)
    archive = os.path.join(tempfile.mkdtemp(), "cladeflow_src.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, top))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session may go without it; it then gets a temporary folder.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("cladeflow.shared.dir", None)
    if found:
        return found
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="cladeflow-")
    spark.conf.set("cladeflow.shared.dir", made)
    import atexit

    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return made


def stage(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Writes `df` to the shared folder as Parquet and reads it back.

    This cuts the lineage: a lost executor costs the tasks it ran and not the
    steps before, and no step runs twice when its result is used twice. Spark
    deletes the step's shuffle files at its end, and not when the driver happens
    to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    _staged.append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def unstage(*frames: DataFrame) -> None:
    """Deletes what stage() wrote for `frames`, once all that is made of them is staged too."""
    for df in frames:
        _delete(df.sparkSession, df.staged_path)
        if df.staged_path in _staged:
            _staged.remove(df.staged_path)


class Scratch:
    """Deletes, at its end, what was staged within it, but for the frames that are kept.

    Operators return frames that still read what they staged, so they can't do
    this themselves: who writes an operator's result does.

        with Scratch(spark) as scratch:
            docs = scratch.keep(stage(operator(docs)))
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.before, self.kept = spark, set(_staged), set()

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.add(df.staged_path)
        return df

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in [p for p in _staged if p not in self.before | self.kept]:
            _delete(self.spark, path)
            _staged.remove(path)


def texts(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id and text of `docs` alone, null texts as empty ones."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *extra)


def columns_of(names: list[str]) -> list:
    """Columns of these names, whatever characters they hold."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def batch(**columns: tuple[object, pa.DataType]) -> pa.RecordBatch:
    """A record batch from name=(values, type)."""
    return pa.RecordBatch.from_arrays(
        [pa.array(v, type=t) for v, t in columns.values()], names=list(columns)
    )


def fold_held_out(modulus: int, held: int):
    """True where crc32 of doc_id, written as text, leaves `held`; null ids as ''."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus == held


#: Up to so many keys are sent to all workers (some 16 MB); more meet the rows in a shuffle.
BROADCAST_KEYS = 1_000_000


def without(rows: DataFrame, key, keys: DataFrame) -> DataFrame:
    """`rows` but those whose `key`, an expression, is in the one column of `keys`.

    Rows with a null key stay. `keys` is staged, so that it is computed once.
    """
    name = f"key_{uuid.uuid4().hex}"
    keys = stage(keys.toDF(name).filter(f"{name} is not null").distinct())
    other = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    return rows.join(other, key == F.col(name), "left_anti")


#: A key with 1 / HEAVY of the rows is dealt out apart; there are HEAVY such keys at most.
HEAVY = 256


def heavy_keys(rows: DataFrame, key: str) -> DataFrame | None:
    """`key` and `_parts`, over how many tasks to deal it, of keys with 1 / HEAVY of the staged `rows`; None without any."""
    total = rows.count()
    if total < HEAVY:
        return None
    n = F.col("count")
    found = rows.groupBy(key).count().filter((n * HEAVY >= total) & (n >= HEAVY)).collect()
    if not found:
        return None
    # as an Arrow table: from Python rows Spark starts further Python workers, which stay for a minute
    parts = pa.table({key: pa.array([r[0] for r in found], pa.int64()), "_parts": pa.array([-(-HEAVY * r[1] // total) for r in found], pa.int64())})
    return rows.sparkSession.createDataFrame(parts)


def join_spread(rows: DataFrame, table: DataFrame, key: str | list[str], n: str, total: int) -> DataFrame:
    """`rows` joined with a staged table that has one row a key and, in column `n`, how many of `total` rows have it.

    Keys with 1 / HEAVY of the rows or more, and HEAVY rows at least, are broadcast,
    so that none of them makes one large task; the others meet the rows in a
    shuffle. Without such keys it is one join, as each broadcast takes megabytes of
    the driver. Rows with a null key are left out, as in any join.
    """
    keys = [key] if isinstance(key, str) else key
    hot = (F.col(n) * HEAVY >= total) & (F.col(n) >= HEAVY)
    few = table.filter(hot)
    if total < HEAVY or few.isEmpty():
        return rows.join(table, keys)
    rest = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(table.filter(~hot), keys)
    return rows.join(F.broadcast(few), keys).unionByName(rest)
