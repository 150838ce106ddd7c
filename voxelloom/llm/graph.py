"""Connected components of a link table, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _roots(links: DataFrame) -> DataFrame:
    """(node, root): each node's least neighbour, followed to its end by doubling steps."""
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("to")).unionAll(
        links.select(F.col("b").alias("node"), F.col("a").alias("to"))
    )
    found = materialize(ends.groupBy("node").agg(F.least("node", F.min("to")).alias("root")))
    while True:
        step = found.where("node <> root").select(F.col("node").alias("at"), F.col("root").alias("next"))
        jumped = materialize(
            found.join(step, found["root"] == step["at"], "left")
            .select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        )
        found = jumped.select("node", "root")
        if jumped.where("moved").isEmpty():
            return found


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): the least node that its links reach.

    In each round every node joins its least neighbour, to the end of that
    chain, and the links between
    the joined groups go into the next round, until there are none.  Nodes
    that link only themselves, or are null, are left out.
    """
    left = materialize(links.where("a <> b").select("a", "b").distinct())
    whole = None
    while not left.isEmpty():
        found = _roots(left)
        if whole is None:
            whole = found
        else:
            step = found.select(F.col("node").alias("at"), F.col("root").alias("next"))
            whole = materialize(
                whole.join(step, whole["root"] == step["at"], "left").select("node", F.coalesce("next", "root").alias("root"))
            )
        a = found.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = found.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = materialize(
            left.join(a, "a").join(b, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
        )
    return left.select(F.col("a").alias("node"), F.col("b").alias("root")) if whole is None else whole
