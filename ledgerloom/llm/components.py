"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.scratch import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b: long); the component is its smallest node.

    Each round points every remaining node at its smallest neighbour if that is smaller, follows the
    pointers to their ends by doubling, and replaces the ends of all links by what they point at;
    links inside one node go. Every node that has a smaller neighbour goes in a round, so a chain or
    a star takes one round or two and a random graph about the logarithm of its size. The links shrink from round to round and are written between rounds; nothing is
    collected but a row count. Null ends are dropped; an empty table has no components.
    """
    links = materialise(links.where("a is not null and b is not null").select("a", "b"), "links")
    found = materialise(links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
                        .select("node", F.col("node").alias("component")), "nodes")
    left = links.where("a <> b")
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        pointers = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to"))
        pointers = materialise(pointers, "pointers")
        while True:
            hop = pointers.select(F.col("node").alias("_n"), F.col("to").alias("_t"))
            further = materialise(pointers.join(hop, F.col("to") == F.col("_n"))
                                  .select("node", F.col("_t").alias("to"), (F.col("_t") != F.col("to")).alias("moved")), "pointers")
            pointers = further.select("node", "to")
            if further.where("moved").isEmpty():
                break
        ends = pointers.select(F.col("node").alias("_n"), F.col("to").alias("_t"))
        found = materialise(found.join(ends, F.col("component") == F.col("_n"), "left")
                            .select("node", F.coalesce("_t", "component").alias("component")), "nodes")
        others = ends.select(F.col("_n").alias("_m"), F.col("_t").alias("_s"))
        left = materialise(left.join(ends, F.col("a") == F.col("_n")).join(others, F.col("b") == F.col("_m"))
                           .where("_t <> _s").select(F.least("_t", "_s").alias("a"), F.greatest("_t", "_s").alias("b")).distinct(), "links")
    return found
