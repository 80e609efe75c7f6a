"""Connected components by alternating large-star and small-star rounds of joins."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintwise.session import work_table

ROUNDS = 60


def stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round. Every vertex has its neighbours hung on the least of them and itself: the larger
    neighbours in a large-star round, the others in a small-star round."""
    if large:
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    else:
        both = edges.select(
            F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")
        )
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("least"))
    met = both.join(least, "src")
    if large:
        out = met.where("dst > src").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    else:
        hung = met.select(F.col("dst").alias("src"), F.col("least").alias("dst"))
        out = hung.unionByName(least.select("src", F.col("least").alias("dst")))
    return out.where("src != dst").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable, for every id in the undirected edges (src, dst) of
    bigint ids. Edges with a null or equal ends are passed over; an id without other edges has no
    row. A vertex with very many edges is met through aggregates with a map-side part and joins
    that adaptive execution can split; each round is kept in the shared folder."""
    now = work_table(edges.where("src != dst").select("src", "dst").distinct(), "edges")
    seen = None
    for _ in range(ROUNDS):
        now = work_table(stars(stars(now, large=True), large=False), "edges")
        state = now.agg(
            F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))
        ).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    own = now.select(F.col("src").alias("id"), F.col("dst").alias("component"))
    roots = now.select(F.col("dst").alias("id"), F.col("dst").alias("component")).distinct()
    return own.unionByName(roots)
