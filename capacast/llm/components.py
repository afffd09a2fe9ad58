"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capacast import session


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _each(df: DataFrame, *pairs: tuple[str, str], names: tuple[str, str] = ("node", "other")) -> DataFrame:
    """Several pairs of columns out of each row.  A union would hold the plan below it once for each pair: the driver then
    plans, compiles and re-optimises every round several times over."""
    return df.select(F.inline(F.array(*[F.struct(*[F.col(c).alias(n) for c, n in zip(p, names)]) for p in pairs])))


def _nearest(pairs: DataFrame) -> DataFrame:
    """Each pair (node, other) with the smallest member of the node's neighbourhood.

    A merge join, as a broadcast would build a table of the nodes on the driver, in every round.
    """
    lowest = pairs.groupBy("node").agg(F.min("other").alias("low"))
    return pairs.join(lowest.hint("merge"), "node").withColumn("low", F.least("node", "low"))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b, both bigint); the component is its smallest node.

    Each round is two grouped minima and two equality joins over the links, none of which gathers a neighbourhood in
    one row.  Rounds write to the shared scratch folder, so the plan stays short and lost executors cost one round at
    most.  Links of a node to itself and repeated links are harmless; an empty table gives an empty result.
    """
    links = links.where("a is not null and b is not null and a <> b")
    edges = session.materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                                .distinct(), "links")
    before = None
    for _ in range(rounds):
        now = _signature(edges)
        if now == before or not now[0]:
            break
        before = now
        large = _nearest(_each(edges, ("a", "b"), ("b", "a"))).where("other > node").select(
            F.col("other").alias("node"), F.col("low").alias("other"))
        small = _nearest(large.distinct())
        edges = session.materialise(
            _each(small, ("other", "low"), ("node", "low"), names=("a", "b")).where("a <> b").distinct(), "links")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return _each(edges, ("a", "b"), ("b", "b"), names=("node", "component")).distinct()
