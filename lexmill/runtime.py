"""What the operators share: the shared folder, lineage cuts, checked broadcasts, row numbers."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that an operator broadcasts at most; beyond it joins by a shuffle.
BROADCAST_BYTES = 64 << 20
#: Bytes that a core reads as one task.
SPLIT_BYTES = 128 << 20

#: Bytes of texts that Python takes apart at once.
SLICE_BYTES = 1 << 20


def in_slices(run: Callable, *columns: pa.Array, limit: int = SLICE_BYTES) -> pa.Array:
    """``run`` of columns of texts, local to a row, by slices of about ``limit`` bytes, so that its objects don't grow with the batch."""
    n = len(columns[0])
    total = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype("int64") for c in columns).cumsum()
    out, at = [], 0
    while at < n:
        base = total[at - 1] if at else 0
        end = max(at + 1, int(total.searchsorted(base + limit, side="right")))
        out.append(run(*[c.slice(at, end - at) for c in columns]))
        at = end
    return pa.concat_arrays(out) if out else run(*columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a new one in local mode, an error on a cluster."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lexmill-"))
    return sc.getCheckpointDir()


def spread(df: DataFrame, key: str) -> DataFrame:
    """A scan of fewer files than there are cores, and little data for each of these, dealt to all of them by ``key``.

    A file of one row group is one task however many splits it has.  Large inputs have
    splits enough and stay as they are, so nothing that grows is shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= cores * SPLIT_BYTES or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores, key)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def checked_broadcast(df: DataFrame, size: int, limit: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if ``size`` bytes are few enough."""
    return F.broadcast(df) if size <= (BROADCAST_BYTES if limit is None else limit) else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def numbered(df: DataFrame, order: list[str], name: str, start: int = 1) -> DataFrame:
    """``df`` with dense numbers from ``start`` in the order of the columns ``order``.

    Rows are range partitioned and sorted, and only the sizes of the partitions meet on
    the driver, so no task sees more than its own range.  ``df`` is kept in the shared
    folder.
    """
    k = free_name(df, "k")
    kept = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(k, F.monotonically_increasing_id()))
    part = free_name(kept, "part")
    placed = kept.withColumn(part, F.shiftright(k, 33))
    base, offsets = start, []
    for p, n in sorted((r[0], r[1]) for r in placed.groupBy(part).count().collect()):  # a row for each partition
        offsets.append((p, base))
        base += n
    if not offsets:
        return df.withColumn(name, F.lit(None).cast("bigint"))
    first = free_name(placed, "first")
    table = df.sparkSession.createDataFrame(offsets, f"{part} long, {first} long")
    within = F.col(k).bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(table), part).withColumn(name, (F.col(first) + within).cast("bigint")).drop(k, part, first)
