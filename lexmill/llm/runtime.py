"""What the operators share of Spark: lineage cuts, size checks, row keys."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that an operator broadcasts at most; beyond it joins by a shuffle.
BROADCAST_BYTES = 64 << 20


#: Bytes of an Arrow batch of texts, in the JVM and in Python; a batch has one row at least.
BATCH_BYTES = 4 << 20


#: Of each session that operators were used in, by its id, the one that they run in.
_own: dict[str, SparkSession] = {}


def small_batches(df: DataFrame) -> DataFrame:
    """``df`` in a session of the operators' own, with the settings of its session, where Arrow batches are of BATCH_BYTES.

    So an operator's memory depends neither on these settings nor on what ran before, and
    the user's session stays as it is.
    """
    spark = df.sparkSession
    name = spark._jsparkSession.sessionUUID()
    own = _own.get(name)
    if own is None or own.sparkContext is not spark.sparkContext:
        copy = spark._jsparkSession.cloneSession()
        # one for all: Python workers of different sessions aren't shared
        own = _own[name] = _own[copy.sessionUUID()] = SparkSession(spark.sparkContext, copy)
    mine, theirs = (x._jsparkSession.sessionState().conf() for x in (own, spark))
    if own._jsparkSession.sessionUUID() != name:
        mine.clear()
        for k in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(theirs.getAllConfs()).items():
            mine.setConfString(*k)
    mine.setConfString("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    rows = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, df._jdf.queryExecution().analyzed())
    return DataFrame(rows, own)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where it is unset, a new one in local mode, an error on a cluster."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lexmill-"))
    return sc.getCheckpointDir()


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that is read no more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read from the shared folder from then on."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def may_broadcast(rows: int, row_bytes: int, limit: int | None = None) -> bool:
    return rows * row_bytes <= (BROADCAST_BYTES if limit is None else limit)


def small(df: DataFrame, rows: int, row_bytes: int, limit: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it is checked to be small, else as it is."""
    return F.broadcast(df) if may_broadcast(rows, row_bytes, limit) else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def id_order(doc_id: Column | str) -> Column:
    """Ids in order, a null id after all others."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.struct(c.isNull().alias("n"), c.alias("v"))
