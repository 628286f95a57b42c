"""Expressions and small helpers that several operators of this folder share."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word for the size and shingle operators: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of white-space-separated words; null counts as no words."""
    return F.size(words(text)).cast("long")


def words(text: Column, separators: str = SPACE) -> Column:
    """The words of a text as an array; null, empty and all-separator texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separators), lambda w: w != "")


def by_value(module: str) -> None:
    """Send this module's functions to executors whole, so that they need not have the library installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


#: Bytes of Parquet up to which a written table is broadcast, some times as many in memory.
BROADCAST_BYTES = 8 << 20


def sized(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` bytes, else as it is, to be shuffled.

    ``df`` comes from a written table (``cut``), whose files tell the planner their size; no job is run.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(df) if size <= most else df


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores as keep it apart from ``columns``, whatever the case."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def named(column: str) -> Column:
    """A column by its whole name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def kept_columns(columns: list[str], made: list[str]) -> list[Column]:
    """All columns but those that an operator makes itself."""
    return [named(c) for c in columns if c.lower() not in {m.lower() for m in made}]


def shielded(docs: DataFrame, *used: str, made: list[str] = ()) -> tuple[DataFrame, list[Column]]:
    """``docs`` with names of our own for all but the ``used`` columns, and what selects its columns again.

    An operator that makes columns inside then can't clash with the user's; those named like its results (``made``)
    are left out in the end.
    """
    inner = {c: c if c in used else f"own_{i}" for i, c in enumerate(docs.columns)}
    back = [named(n).alias(c) for c, n in inner.items() if c.lower() not in {m.lower() for m in made}]
    return docs.select(*[named(c).alias(n) for c, n in inner.items()]), back


def each(df: DataFrame, array: Column, name: str, *keep: str | Column) -> DataFrame:
    """A row for each element that isn't null.

    A plain explode would make the planner test the array's size below it, which computes the array once more with
    all that it is made of put in line, and so once for each word.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())
