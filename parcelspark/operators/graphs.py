"""Joins with groups of any size, and connected components of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import staged

#: Tasks, at most, that share the rows of one group.
SALTS = 64


def salt(spread: str) -> Column:
    """One of ``SALTS`` numbers, by the column ``spread``."""
    return F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")


def salts_of(spread: str) -> Column:
    """Aggregate: the salts of a group's rows, as bits."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), salt(spread)))


def join_groups(rows: DataFrame, groups: DataFrame, by: list[str], spread: str) -> DataFrame:
    """``rows`` with what ``groups`` says of their group ``by``; ``groups`` has the bits of ``salts_of`` as ``salts``.

    Each group's row goes only to those of ``SALTS`` tasks that hold rows of it, so
    that a group of any size is many tasks' work and a small one costs no more.
    """
    each = F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), i -> getbit(salts, i) = 1)")).alias("salt")
    groups = groups.select(*(c for c in groups.columns if c != "salts"), each)
    return rows.withColumn("salt", salt(spread)).join(groups.hint("merge"), [*by, "salt"]).drop("salt")


def _each(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """(u, v): for every row one of each of ``pairs`` of columns, in one pass."""
    each = [F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs]
    return rows.select(F.explode(F.array(*each)).alias("_pair")).select("_pair.*")


def _stars(pairs: DataFrame) -> bool:
    """Whether every ``u`` of different pairs (u, v) has one ``v`` only, which is no ``u``."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("_end"))
    of = ends.select("_end.*").groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
    return of.where("up > 1 or (up = 1 and n > 1)").isEmpty()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); component: its least node. Nodes are of any type with an order.

    Alternates large-star and small-star steps: each node's neighbours are hung
    on its least neighbour. A minimum by node, combined before the shuffle, and
    a salted join take the place of neighbour lists, so that a node of any degree
    does no harm. Every round is a table in the shared folder; the rounds end when
    all components are stars, which one count by node shows.
    """

    def hang(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), salts_of("v").alias("salts"))
        return join_groups(pairs, least, ["u"], "v")

    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    pairs = staged(pairs, name)
    while not _stars(pairs):
        large = hang(_each(pairs, ("u", "v"), ("v", "u"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _each(hang(large.where("u <> v")), ("v", "m"), ("u", "m"))
        pairs = staged(small.where("u <> v").distinct(), name)
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
