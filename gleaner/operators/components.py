"""Connected components of a link table by min-label propagation with pointer jumping, all distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.plans.scratch import kept, scratch, stored
from gleaner.plans.skew import join_on_counted_key


def connected_components(links: DataFrame) -> DataFrame:
    """links: columns a, b, of one type. One row per linked vertex: node, component (the smallest vertex reachable).

    Each round a vertex takes the smallest label among its own, its neighbours' and its label's label; labels only
    fall, and the rounds needed grow with the logarithm of a component's width. Every round is written to the
    shared folder, so its lineage is one table. A vertex with very many links and a label that very many vertices
    have are summed by partial aggregation and joined through `join_on_counted_key`.
    """
    with scratch(links.sparkSession):
        both = links.select("a", "b").where("a != b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a != b")).distinct()
        both = stored(both, "links")
        labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"), F.count(F.lit(1)).alias("n_links")), "labels")
        total = max(1, both.count())
        while True:
            told = labels.select(F.col("node").alias("b"), F.col("component").alias("near"), "n_links")
            near = join_on_counted_key(both, told, "b", "n_links", total).groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
            lower = stored(labels.join(near, "node").select("node", "n_links", F.col("component").alias("old"), F.least("component", "near").alias("component")), "lower")
            # the label's own label; a label is always a vertex
            held = lower.groupBy("component").agg(F.count(F.lit(1)).alias("n_held"))
            roots = held.join(lower.select(F.col("node").alias("component"), F.col("component").alias("root")), "component")
            after = join_on_counted_key(lower, roots, "component", "n_held", total)
            after = stored(after.select("node", "n_links", F.col("root").alias("component"), (F.col("root") != F.col("old")).alias("moved")), "labels")
            labels = after.drop("moved")
            if not after.where("moved").limit(1).collect():
                return kept(labels.select("node", "component"), "components")
