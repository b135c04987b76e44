"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dugout.llm.runtime import Scratch


def _toward_smallest(edges: DataFrame, either_way: bool) -> DataFrame:
    """Link each neighbour of a node to the smallest of its neighbourhood.

    ``either_way``: over all neighbours, for the larger ones; otherwise over the
    smaller neighbours, for these and the node itself.  The minimum is combined
    before the shuffle and joined back, so that a node with very many neighbours
    is never gathered anywhere.
    """
    if either_way:
        links = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = links.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
    return out.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node with an edge; the component is its smallest node.

    ``edges`` has two columns of one ordered type.  Null ends, loops and repeats
    are allowed and link nothing.  An empty table gives an empty result.  Stars
    are built alternately toward the smallest of all neighbours and of the
    smaller ones; every round is written, and the rounds grow with the logarithm
    of a component's diameter.
    """
    left, right = edges.columns[:2]
    state = scratch.store(
        edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .filter(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
        .distinct(),
        "links",
    )
    seen = None
    while True:
        print_of = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(print_of) == seen:
            break
        seen = tuple(print_of)
        if not seen[0]:
            break
        after = scratch.store(_toward_smallest(_toward_smallest(state, True), False), "links")
        scratch.drop(state)
        state = after
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
