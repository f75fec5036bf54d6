"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import new_path

#: The white space that parts words in every contract of this subpackage.
SPACE = "[\\x20\\x09-\\x0D]+"

#: In DuckDB's SQL, the unsigned CRC-32 of a number's decimal text, bit by bit: eight steps for each character.
CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({0}::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda acc, x: xor(xor(acc, x) >> 1, 3988292384 * (xor(acc, x) & 1))))"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z only: lower() would also fold other alphabets and can change lengths."""
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """The words between white space; none for an empty or null text."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACE), lambda w: w != "")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder


class Spool:
    """Cuts lineage by writing a table to the shared folder and reading it again, so that a lost
    executor costs one reread. drop() removes tables that a loop has outgrown. The others stay for
    the rows that are still to be computed from them: sweep() removes these once results are written."""

    open_: list[Spool] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at, self.n = spark, new_path(spark, name), 0
        self.passing: list[DataFrame] = []  # tables that what is computed next is read from, and nothing after it
        Spool.open_.append(self)

    def cut(self, df: DataFrame) -> DataFrame:
        path, self.n = f"{self.at}/{self.n}", self.n + 1
        df.write.parquet(path, compression="zstd")
        out = self.spark.read.schema(df.schema).parquet(path)
        out._spooled = path
        return out

    def drop(self, df: DataFrame) -> None:
        self._remove(df._spooled)

    def let_go(self) -> None:
        for df in self.passing:
            self.drop(df)
        self.passing = []

    def tidy(self) -> None:
        """Shuffle files go when nothing refers to them any more, which the driver finds out as it
        collects garbage; after a large step this asks for it, rather than wait for the disk to fill."""
        gc.collect()
        self.spark._jvm.System.gc()

    def close(self) -> None:
        self._remove(self.at)

    def _remove(self, at: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def sweep(*keep: Spool) -> None:
    """Removes all spooled tables but those of the spools to keep. For callers whose results are written."""
    for s in Spool.open_:
        if s not in keep:
            s.close()
    Spool.open_ = [s for s in Spool.open_ if s in keep]
