"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions.tables import written

__all__ = ["WHITE", "Sealed", "identity", "shuffle_width", "table", "words", "written"]

#: The six ASCII white-space characters; everything else belongs to a word.
WHITE = "[\\x20\\x09-\\x0D]+"


class Sealed:
    """A frame under private column names, so that no column of its own can clash with a work column."""

    def __init__(self, df: DataFrame):
        self.names, self.schema = df.columns, df.schema
        self.df = df.toDF(*[f"__in{i}" for i in range(len(self.names))])

    def _at(self, name: str) -> int:
        """An exact match goes before one of another case."""
        return self.names.index(name) if name in self.names else [n.lower() for n in self.names].index(name.lower())

    def at(self, name: str) -> str:
        """The private name of a column."""
        return f"__in{self._at(name)}"

    def __getitem__(self, name: str) -> Column:
        return F.col(self.at(name))

    def kind(self, name: str):
        return self.schema[self._at(name)].dataType

    def back(self, df: DataFrame, outputs: dict[str, Column]) -> DataFrame:
        """Own columns under their names, then the outputs.

        An output takes the place of an own column of the same name, whatever its case.
        """
        taken = {o.lower() for o in outputs}
        own = [F.col(f"__in{i}").alias(n) for i, n in enumerate(self.names) if n.lower() not in taken]
        return df.select(*own, *[c.alias(n) for n, c in outputs.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    parts = F.split(F.coalesce(text, F.lit("")), WHITE)
    # Only the first and the last part can be empty.
    return F.filter(parts, lambda w: w != "")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def identity(ident: str | Column, text: str | Column) -> tuple[Column, Column]:
    """Two hashes that stand for a row's id and text, the same in every run."""
    of = lambda c: F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("\x00null"))
    return F.xxhash64(of(ident), of(text)), F.xxhash64(F.lit(7), of(ident), of(text))
