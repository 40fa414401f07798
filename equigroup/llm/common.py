"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equigroup.session import materialize
from equigroup.sources.tables import read_table

__all__ = ["col", "id_text", "let", "materialize", "pack_rows", "read_table", "shared_bytes", "unpack_rows"]

#: The characters of ``[\x20\x09-\x0D]`` as a regular expression class.
SPACE = r"[\x20\x09-\x0D]"


def col(name: str) -> Column:
    """Column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string), null texts as empty; every other column is
    left unread, so extra columns can't clash with an operator's own."""
    return docs.select(col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))


def let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``value`` worked out once, as ``name``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def pack_rows(docs: DataFrame, name: str = "row") -> Column:
    """The whole input row as one struct column: carried through joins and
    aggregates under one name, its own column names can't clash."""
    return F.struct(*[col(c) for c in docs.columns]).alias(name)


def unpack_rows(df: DataFrame, columns: list[str], name: str = "row") -> DataFrame:
    return df.select(*[F.col(name).getField(c).alias(c) for c in columns])


def shared_bytes(spark: SparkSession, path: str):
    """A driver-side file (a vocabulary of about 2 MB) as a broadcast variable,
    so executors need not have it."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())
