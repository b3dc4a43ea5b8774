"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of a row number for the place within its file; the others number the file.
PLACE_BITS = 40
BROADCAST_FILES = 100_000
BATCH_BYTES = 4 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in a local session that names none, as in tests.

    A cluster must name a folder that driver and executors share: a machine's own is refused. Tables in it are scratch
    data of the session; who owns the folder clears it, as with any checkpoints."""
    set_here = spark.sparkContext._jsc.sc().getCheckpointDir()
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or (set_here.get() if set_here.isDefined() else None)
    if folder is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='ranksmith-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Bound what goes to Python at once to ``BATCH_BYTES`` (one row at least), unless the session asks for less.

    Both sides hold a batch several times over while they convert it; the usual bound of 64 MB is much of an executor."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


_lock, _writing = threading.Lock(), {"now": 0, "before": "false"}


@contextmanager
def _shuffle_files_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go with the query that wrote them, as long as any thread is in here."""
    with _lock:
        if not _writing["now"]:
            _writing["before"] = spark.conf.get(CLEANUP, "false")
            spark.conf.set(CLEANUP, "true")
        _writing["now"] += 1
    try:
        yield
    finally:
        with _lock:
            _writing["now"] -= 1
            if not _writing["now"]:
                spark.conf.set(CLEANUP, _writing["before"])


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as a Parquet table in the shared folder; returns it reread, and its path.

    The lineage ends here: executors that are lost later cost nothing that was written before, and the shuffle files of
    the write go with its end and not when the driver next collects its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with _shuffle_files_go(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table that no later plan reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def kept_columns(docs: DataFrame) -> Column:
    """All columns of a table as one struct, whatever their names are."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns])


def unpacked(docs: DataFrame, struct: str = "_doc", **instead: Column) -> list[Column]:
    """The columns of ``kept_columns`` again; ``instead`` names those that another expression replaces."""
    return [instead.get(c, F.col(struct).getField(c)).alias(c) for c in docs.columns]


def wider(schema: T.StructType, **more: str) -> T.StructType:
    """A schema with further fields, given as SQL types."""
    return T.StructType([*schema.fields, *[T.StructField(name, T._parse_datatype_string(kind)) for name, kind in more.items()]])


def _is_plain_scan(docs: DataFrame) -> bool:
    """Whether ``docs`` is a scan of Parquet files, filtered at most, that reads no file twice."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Filter", "SubqueryAlias") and plan.deterministic():
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation" or not plan.relation().getClass().getSimpleName().startswith("HadoopFsRelation"):
        return False
    relation = plan.relation()
    roots = sorted(relation.location().rootPaths().mkString("\n").split("\n"))
    return relation.fileFormat().toString() == "Parquet" and all(b != a and not b.startswith(a.rstrip("/") + "/") for a, b in zip(roots, roots[1:]))


class Rows:
    """A table whose rows have the same number in every job.

    The number is made of the file and the row's place in it, so it holds however the files are split among tasks, and
    after an executor is lost. Whatever is no plain scan of Parquet files is written as a table first."""

    def __init__(self, docs: DataFrame):
        self.docs = docs if _is_plain_scan(docs) else materialize(docs, "rows")[0]
        self._meta = self.docs.metadataColumn("_metadata")
        files = sorted(r[0] for r in self.docs.select(self._meta["file_path"]).distinct().collect())  # the driver lists them anyway
        self._files = docs.sparkSession.createDataFrame(list(enumerate(files)), "_file_number long, _file string")
        if len(files) <= BROADCAST_FILES:
            self._files = F.broadcast(self._files)

    def select(self, *columns: Column) -> DataFrame:
        """``_row`` and the given columns."""
        rows = self.docs.select(self._meta["file_path"].alias("_file_path"), self._meta["row_index"].alias("_place"), *columns)
        names = rows.columns[2:]
        rows = rows.join(self._files, F.col("_file_path") == F.col("_file"))
        return rows.select((F.shiftleft(F.col("_file_number"), PLACE_BITS) + F.col("_place")).alias("_row"), *names)
