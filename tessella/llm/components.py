"""Connected components by alternating large-star and small-star, and splits made of them.

Defined cases: edges with a null end and self-loops add nothing; repeated edges count
once; no edges give no rows. Nodes may be of any orderable type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.identifiers import unit_interval
from tessella.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node ties its larger neighbours to its smallest one."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node ties itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars already: each lower end has one upper end, which is no lower end itself.

    That is exactly what both stars leave as it is, so no further round is needed to see it.
    """
    once = edges.groupBy("u").agg(F.count("*").alias("n"))
    return once.filter("n > 1").isEmpty() and edges.join(once.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def connected_components(edges: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node of the component of each node with an edge.

    Every round runs both stars and writes the edges to the checkpoint folder; it ends
    when the edges are stars, after about log2(nodes) rounds at worst. Stars are
    formed by an aggregate and a join rather than by groups, so a hub of any size is
    combined before the shuffle and split by the skew join. Edges that are stars from
    the start need no round.
    """
    now = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    now = cut_lineage(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        if _settled(now):
            break
        now = cut_lineage(_small_star(_large_star(now)))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


#: Components above this share of the records of any kind are placed one by one, so there are at most kinds / LARGE.
LARGE = 1e-4


def placed(sizes: list[tuple], totals: list[int], shares: dict[str, float]) -> tuple[dict, dict[str, float]]:
    """Splits of the given components, and the share of what is left that each split lacks.

    `sizes` has (component, records of each kind). The largest go first, each to the split
    that then lacks most of its proportion of the kinds that the component has.
    """
    kinds = [i for i, t in enumerate(totals) if t]
    whole = sum(shares.values())
    lacks = {name: [share / whole] * len(kinds) for name, share in shares.items()}
    weights = {row[0]: [row[1 + i] / totals[i] for i in kinds] for row in sizes}
    out = {}
    for component, weight in sorted(weights.items(), key=lambda x: (-sum(x[1]), x[0])):
        split = max(lacks, key=lambda name: sum(w * lack for w, lack in zip(weight, lacks[name], strict=True)))
        out[component] = split
        lacks[split] = [lack - w for w, lack in zip(weight, lacks[split], strict=True)]
    rest = {name: max(0.0, sum(lack)) for name, lack in lacks.items()}
    left = sum(rest.values())
    return out, {name: lack / left if left > 1e-9 else shares[name] / whole for name, lack in rest.items()}


def proportional_splits(records: DataFrame, component: str, kind: str, kinds: list, shares: dict[str, float], seed: int = 0, large: float = LARGE) -> DataFrame:
    """`records` with `split`, the same for all records of a component.

    The few components that hold more than `large` of the records of a kind are placed
    by size; all others by the hash of their id, in ranges set so that the proportions
    come out. What remains of the error is the size of the largest component, where a
    single one exceeds its split, or some sqrt(large) / 2. The same records always give
    the same splits; when records are added, components may move.
    """
    spark = records.sparkSession
    counts = [F.count_if(F.col(kind) == k).alias(f"n{i}") for i, k in enumerate(kinds)]
    totals = list(records.agg(*counts).first())
    over = " OR ".join(f"n{i} > {large * t!r}" for i, t in enumerate(totals))
    sizes = records.groupBy(component).agg(*counts).filter(over) if any(totals) else None
    known, ranges = placed([tuple(r) for r in sizes.collect()] if sizes is not None else [], totals, shares)
    table = F.broadcast(spark.createDataFrame(list(known.items()), f"`{component}` string, known string"))
    point, bound, names, hashed = unit_interval(F.col(component), seed=seed), 0.0, list(ranges), None
    for name in names[:-1]:
        bound += ranges[name]
        hashed = F.when(point < bound, name) if hashed is None else hashed.when(point < bound, name)
    hashed = F.lit(names[0]) if hashed is None else hashed.otherwise(names[-1])
    return records.join(table, component, "left").withColumn("split", F.coalesce("known", hashed)).drop("known")


def group_pairs(members: DataFrame, node: str, component: str) -> DataFrame:
    """(a, b): the pairs within each component, smaller first. Only for results defined as pairs."""
    a = members.select(F.col(component).alias("c"), F.col(node).alias("a"))
    b = members.select(F.col(component).alias("c"), F.col(node).alias("b"))
    return a.join(b, "c").filter("a < b").select("a", "b")
