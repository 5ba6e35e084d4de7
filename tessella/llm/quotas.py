"""Samples with given category proportions, by controlled rounding and exact quotas.

The wanted table of quotas (share times sample size, by row and column category) is
first made feasible: no cell below its minimum or above the records there are. What a
cell lacks goes to the other cells of its row in proportion to what they want, and only
what the row can't take to other rows. A maximum flow then makes this table integer,
with its cells, row sums, column sums and total all next to what they were; since cells
are bounded by whole numbers, minimum and supply hold for the integers too. So the
quotas always sum to the sample size if there are as many records in the cells, and if
the minimums alone don't exceed it. Then each cell gives exactly its quota: the records
with the smallest random keys.

Defined cases: a cell with fewer records than it wants or needs gives all it has, and
the report says how many it is short of; a cell of the targets that no record has
counts as 0 records; records outside the targets are never drawn. Equal random keys are
told apart by the id. No records give an empty sample and a report in which every cell
with a minimum is short.
"""

from __future__ import annotations

from collections import defaultdict, deque
from fractions import Fraction
from math import ceil, floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.session import cut_lineage

#: Greatest number of target cells; the flow runs on the driver.
MAX_CELLS = 100_000


def max_flow(arcs: list[list[int]], source: int, sink: int, nodes: int) -> list[int]:
    """Flow on each (from, to, capacity) arc of a maximum flow, by blocking flows over levels."""
    heads: list[list[int]] = [[] for _ in range(nodes)]
    to, room = [], []
    for a, b, capacity in arcs:
        heads[a].append(len(to))
        heads[b].append(len(to) + 1)
        to += [b, a]
        room += [capacity, 0]
    while True:
        level = [-1] * nodes
        level[source] = 0
        queue = deque([source])
        while queue:
            node = queue.popleft()
            for edge in heads[node]:
                if room[edge] and level[to[edge]] < 0:
                    level[to[edge]] = level[node] + 1
                    queue.append(to[edge])
        if level[sink] < 0:
            return [room[2 * k + 1] for k in range(len(arcs))]
        turn, path, node = [0] * nodes, [], source
        while True:
            if node == sink:
                step = min(room[edge] for edge in path)
                for edge in path:
                    room[edge] -= step
                    room[edge ^ 1] += step
                path, node = [], source
                continue
            while turn[node] < len(heads[node]):
                edge = heads[node][turn[node]]
                if room[edge] and level[to[edge]] == level[node] + 1:
                    break
                turn[node] += 1
            else:
                if not path:
                    break
                node = to[path.pop() ^ 1]
                turn[node] += 1
                continue
            path.append(edge)
            node = to[edge]


def controlled_rounding(table: dict[tuple, Fraction]) -> dict[tuple, int]:
    """Integers next to the values of a two-way table whose margins are next to its margins.

    A flow with lower bounds: source to rows, rows to columns by the cells, columns to
    sink, and back. The table itself is a fractional flow, so an integer one exists.
    """
    row_sums, column_sums = defaultdict(Fraction), defaultdict(Fraction)
    for (r, c), value in table.items():
        row_sums[r] += value
        column_sums[c] += value
    row_at = {r: 2 + i for i, r in enumerate(row_sums)}
    column_at = {c: 2 + len(row_at) + i for i, c in enumerate(column_sums)}
    source, sink = 0, 1
    bounded = [(row_at[r], column_at[c], value) for (r, c), value in table.items()]
    bounded += [(source, row_at[r], value) for r, value in row_sums.items()]
    bounded += [(column_at[c], sink, value) for c, value in column_sums.items()]
    bounded.append((sink, source, sum(table.values(), Fraction(0))))
    nodes = 4 + len(row_at) + len(column_at)
    supply, demand = nodes - 2, nodes - 1
    excess = [0] * nodes
    arcs = []
    for a, b, value in bounded:
        arcs.append([a, b, ceil(value) - floor(value)])
        excess[b] += floor(value)
        excess[a] -= floor(value)
    for node, over in enumerate(excess[: nodes - 2]):
        if over:
            arcs.append([supply, node, over] if over > 0 else [node, demand, -over])
    flow = max_flow(arcs, supply, demand, nodes)
    return {cell: floor(value) + flow[k] for k, (cell, value) in enumerate(table.items())}


def _poured(amount: Fraction, room: dict, weight: dict) -> dict:
    """Shares of `amount` in proportion to the weights, none above its room; what has no weight comes last."""
    out: dict = dict.fromkeys(room, Fraction(0))
    for cells in ([c for c in room if weight[c] > 0], [c for c in room if weight[c] <= 0]):
        weights = {c: weight[c] if weight[c] > 0 else Fraction(1) for c in cells}
        rest = sum(weights.values(), Fraction(0))
        for c in sorted(cells, key=lambda c: room[c] / weights[c]):
            out[c] = min(Fraction(room[c]), amount * weights[c] / rest)
            amount -= out[c]
            rest -= weights[c]
    return out


def feasible(wanted: dict[tuple, Fraction], least: dict[tuple, int], most: dict[tuple, int], size: int) -> dict[tuple, Fraction]:
    """The table next to `wanted` with every cell from `least` to `most` and the sum `size`, as far as there can be one.

    Row sums stay as wanted wherever the cells of the row allow it.
    """
    low = {c: min(least[c], most[c]) for c in wanted}
    table = {c: min(max(v, low[c]), Fraction(most[c])) for c, v in wanted.items()}
    rows = defaultdict(list)
    for cell in wanted:
        rows[cell[0]].append(cell)

    def move(cells: list, gap: Fraction) -> None:
        room = {c: most[c] - table[c] if gap > 0 else table[c] - low[c] for c in cells}
        for c, part in _poured(min(abs(gap), sum(room.values(), Fraction(0))), room, wanted).items():
            table[c] += part if gap > 0 else -part

    for cells in rows.values():
        move(cells, sum((wanted[c] - table[c] for c in cells), Fraction(0)))
    move(list(wanted), size - sum(table.values(), Fraction(0)))
    return table


def quota_report(usable: DataFrame, targets: DataFrame, rows: str, columns: str, share: str, least: str, fraction: tuple[int, int]) -> DataFrame:
    """(row, column, target_share, min_rows, available, sample_size, wanted, quota, short, met).

    The sample size is fraction[0] * usable // fraction[1]. `wanted` is share * size, exact;
    `quota` what is drawn, by `feasible` and its controlled rounding. A cell needs
    `wanted`, and its minimum; `short` is by how many records its supply, the upper bound
    of its arc, falls below that, `met` whether it doesn't. Targets are looked up on the
    driver; they must have at most MAX_CELLS rows.
    """
    spark = usable.sparkSession
    counted = usable.groupBy(F.col(rows).alias("r"), F.col(columns).alias("c")).agg(F.count("*").alias("n"))
    counted = cut_lineage(counted)
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    size = fraction[0] * total // fraction[1]
    goals = targets.select(F.col(rows).alias("r"), F.col(columns).alias("c"), F.col(share).cast("decimal(18,9)").alias("share"), F.col(least).cast("long").alias("least")).limit(MAX_CELLS + 1)
    met = goals.alias("t").join(counted.alias("n"), F.col("t.r").eqNullSafe(F.col("n.r")) & F.col("t.c").eqNullSafe(F.col("n.c")), "left")
    asked = met.select("t.r", "t.c", "share", "least", F.coalesce("n", F.lit(0)).alias("n")).collect()
    if len(asked) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} target cells")
    wanted = {(a.r, a.c): Fraction(a.share or 0) * size for a in asked}
    minimum, supply = {(a.r, a.c): int(a.least or 0) for a in asked}, {(a.r, a.c): a.n for a in asked}
    quotas = controlled_rounding(feasible(wanted, minimum, supply, size)) if wanted else {}
    out = []
    for a in asked:
        cell = (a.r, a.c)
        need = max(minimum[cell], ceil(wanted[cell]))
        short = need - min(need, supply[cell])
        out.append((a.r, a.c, float(a.share or 0), minimum[cell], a.n, size, float(wanted[cell]), quotas[cell], short, short == 0))
    kinds = {f.name: f.dataType.simpleString() for f in targets.schema}
    return spark.createDataFrame(out, f"`{rows}` {kinds[rows]}, `{columns}` {kinds[columns]}, target_share double, min_rows int, available long, sample_size long, wanted double, quota long, short long, met boolean")


def draw_quotas(usable: DataFrame, record: str, rows: str, columns: str, report: DataFrame, seed: int = 0, buckets: int = 4096) -> DataFrame:
    """(record, row, column): exactly `quota` records of each cell, those with the least random keys.

    Keys fall into buckets by their leading bits; counts per bucket (at most `buckets` a
    cell) tell which are drawn whole and which one is cut, and only the records of that
    one are ranked. So a cell with most of all records is never sorted in one task.
    """
    keyed = usable.select(F.col(record).alias("id"), F.col(rows).alias("r"), F.col(columns).alias("c"), F.xxhash64(record, F.lit(seed)).alias("key"))
    keyed = keyed.withColumn("bucket", F.shiftrightunsigned("key", 64 - (buckets - 1).bit_length()).cast("int"))
    quotas = report.select(F.col(rows).alias("r"), F.col(columns).alias("c"), "quota").filter("r IS NOT NULL AND c IS NOT NULL")
    upto = W.partitionBy("r", "c").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    filled = keyed.groupBy("r", "c", "bucket").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(upto))
    filled = filled.join(F.broadcast(quotas), ["r", "c"]).withColumn("free", F.col("quota") - F.col("upto") + F.col("n")).filter("free > 0")
    chosen = keyed.join(filled.select("r", "c", "bucket", "free", "n"), ["r", "c", "bucket"])
    whole = chosen.filter("n <= free").select("id", "r", "c")
    place = F.row_number().over(W.partitionBy("r", "c", "bucket").orderBy("key", "id"))
    cut = chosen.filter("n > free").withColumn("place", place).filter("place <= free").select("id", "r", "c")
    return whole.unionByName(cut).select(F.col("id").alias(record), F.col("r").alias(rows), F.col("c").alias(columns))
