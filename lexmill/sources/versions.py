"""Tables that are replaced as a whole, version by version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class VersionedTable:
    """A table of versions, a folder each, of which the last whole one counts.

    Writing a version again writes the same folder again, so a batch of a stream that is
    replayed after a loss does no harm.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path, keep
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self, kind: str = "v") -> list[int]:
        root = self._hadoop.Path(self.path)
        if not self._fs.exists(root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        found = [int(n[2:]) for n in names if n.startswith(f"{kind}=") and n[2:].isdigit()]
        return sorted(v for v in found if self._fs.exists(self._hadoop.Path(f"{self.path}/{kind}={v}/_SUCCESS")))

    def last(self) -> int:
        """The newest whole version, -1 if there is none."""
        return max(self._versions(), default=-1)

    def read(self, before: int | None = None) -> DataFrame | None:
        """The table as it was before batch ``before``, or as it is; None if there is none yet."""
        there = [v for v in self._versions() if before is None or v < before]
        return self.spark.read.parquet(f"{self.path}/v={there[-1]}") if there else None

    def write(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v={batch}")
        for v in self._versions()[: -self.keep]:
            self._fs.delete(self._hadoop.Path(f"{self.path}/v={v}"), True)


class DeltaTable(VersionedTable):
    """A table that grows: a version has what a batch adds, and every ``compact`` of them are merged into one.

    So a batch costs what it adds, and now and then a rewriting.  ``merge`` makes of the
    rows of several versions those of one.
    """

    def __init__(self, spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame] = lambda df: df, compact: int = 50):
        super().__init__(spark, path)
        self.merge, self.compact = merge, compact

    def _folders(self, before: int | None) -> list[str]:
        """The folders that make up the table: the last merged one, and the versions after it."""
        last = [v for v in self._versions("m") if before is None or v < before][-1:]
        later = [v for v in self._versions() if (before is None or v < before) and (not last or v > last[0])]
        return [f"{self.path}/m={v}" for v in last] + [f"{self.path}/v={v}" for v in later]

    def read(self, before: int | None = None) -> DataFrame | None:
        there = self._folders(before)
        return self.merge(self._rows(there)) if there else None

    def _rows(self, folders: list[str]) -> DataFrame:
        # the schema of the first holds for all; their names aren't columns
        schema = self.spark.read.parquet(folders[0]).schema
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*folders)

    def write(self, df: DataFrame, batch: int) -> None:
        """Add the rows of a batch."""
        df.write.mode("overwrite").parquet(f"{self.path}/v={batch}")
        there = self._folders(batch + 1)
        if len(there) > self.compact:
            self.merge(self._rows(there)).write.mode("overwrite").parquet(f"{self.path}/m={batch}")
            # the merging before this one stays, for a replay of its successor's batch
            for kind, old in (("m", self._versions("m")[:-2]), ("v", [v for v in self._versions() if v <= max(self._versions("m")[:-1], default=-1)])):
                for v in old:
                    self._fs.delete(self._hadoop.Path(f"{self.path}/{kind}={v}"), True)
