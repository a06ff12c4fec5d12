"""Connected components of a link table, by contraction in DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinemill.llm.common import parts_for, stage

LINKS = 100_000


def components(links: DataFrame, jumps: int = 2, parts: int | None = None) -> DataFrame:
    """(node, root) for every node of links (a, b) that is not its component's root.

    Each round maps a node to its smallest neighbour, shortens those paths by pointer jumping and
    replaces the ends of every link by their images; linked images stay linked, so the rounds end
    with one root for each component. Nodes at least halve in a round. Only aggregated tables move,
    and each round is written to the shared folder, in files of about LINKS links (the links themselves
    in parts files at most, if given).
    """

    def tidy(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    rounds: list[DataFrame] = []
    live = stage(tidy(links), "links", parts)
    parts = parts_for(live.count(), LINKS)
    while live.take(1):
        to = live.groupBy("a").agg(F.min("b").alias("p"))
        for _ in range(jumps):
            far = to.select(F.col("a").alias("p"), F.col("p").alias("q"))
            to = to.join(far, "p", "left").select("a", F.coalesce("q", "p").alias("p"))
        to = stage(to, "parents", parts)
        rounds.append(to)
        ends = live.join(to, "a").select(F.col("p").alias("x"), F.col("b"))
        ends = ends.join(to.select(F.col("a").alias("b"), F.col("p").alias("y")), "b", "left")
        live = stage(tidy(ends.select(F.col("x").alias("a"), F.coalesce("y", "b").alias("b"))), "links", parts)
    if not rounds:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = rounds[0].select(F.col("a").alias("node"), F.col("p").alias("root"))
    for to in rounds[1:]:
        # a node that a later round moves but the first did not has to enter here
        late = to.select(F.col("a").alias("root"), F.col("p").alias("q"))
        seen = out.join(late, "root", "left").select("node", F.coalesce("q", "root").alias("root"))
        fresh = to.join(out.select(F.col("node").alias("a")), "a", "left_anti").select(F.col("a").alias("node"), F.col("p").alias("root"))
        out = seen.unionByName(fresh)
    return out
