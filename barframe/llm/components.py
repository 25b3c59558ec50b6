"""Connected components of a distributed link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barframe.session import cut


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """(id, component) of every end of ``links`` (a, b): the smallest id that can be reached.

    Labels spread to neighbours and then jump to their label's label, so a chain of n links needs about
    log(n) rounds. Each round is a written table; minima are summed up before the shuffle, so a node with
    very many links is no hot spot. Links with a null end count for nothing.
    """
    links = links.where("a is not null and b is not null")
    edges = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{label}-edges")
    labels = cut(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("component")), f"{label}-labels")
    while True:
        heard = edges.join(labels, edges.b == labels.id).groupBy("a").agg(F.min("component").alias("heard")).withColumnRenamed("a", "id")
        spread = labels.join(heard, "id", "left").select("id", F.least("component", "heard").alias("now"), F.col("component").alias("was"))
        target = labels.select(F.col("id").alias("now"), F.col("component").alias("further"))
        stepped = cut(spread.join(target, "now", "left").select("id", F.least("now", "further").alias("component"), "was"), f"{label}-labels")
        labels = stepped.drop("was")
        if stepped.where("component <> was").isEmpty():
            return labels
