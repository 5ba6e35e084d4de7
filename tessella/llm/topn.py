"""The best N items of every group, by a loser-tree merge of stored, sorted runs.

Rows are dealt once, into buckets of groups; a group with too many rows for one task is
dealt into several runs of its bucket. Each run is stored in a file of its own, ordered
by group, falling score and id. One task a bucket then opens all its runs and merges
them with a loser tree. After N outputs of a group every run moves on to its next
group, and what lies between is not looked at: rows are passed over a group at a time,
and whole row groups by the statistics of the file. Nothing is shuffled a second time.

Defined cases: items without a group, id or score are out. Of an item's versions the
newest counts, of equally new ones that with the smallest id. Higher scores come first,
equal ones by smaller id, so the result does not depend on partitions. Groups with
fewer than N items give all they have. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.operators.skew import dealt, hot_keys
from tessella.session import scratch_folder
from tessella.sources import shared

#: Rows of a group up to which one run is enough, whatever the size of the table.
RUN_ROWS = 4_096
#: Runs that one task merges at once; more take another pass.
FAN_IN = 128
#: Bytes of a row group of a stored run, the least that is read or passed over.
ROW_GROUP_BYTES = 1 << 20


class LoserTree:
    """A tournament over sorted runs: the root is the run with the least head.

    Inner nodes hold the losers, so replacing the winner's head costs one comparison a
    level. An exhausted run has the head None, which loses to everything.
    """

    def __init__(self, heads: list):
        self.size = max(1, len(heads))
        self.heads = heads or [None]
        self.losers = [0] * self.size
        winners = [0] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._beats(a, b) else (b, a)
        self.winner = winners[1] if self.size > 1 else 0

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x <= y)

    def replace(self, head) -> None:
        """Give the winner's run its next head and find the new winner."""
        run = self.winner
        self.heads[run] = head
        node = (run + self.size) // 2
        while node:
            if self._beats(self.losers[node], run):
                run, self.losers[node] = self.losers[node], run
            node //= 2
        self.winner = run


class StoredRun:
    """A stored run as a stream of (group, -score, id) that can pass over groups."""

    def __init__(self, location: str):
        self.file = pq.ParquetFile(shared.seekable(location))
        self.groups_read, self.next = 0, 0
        self.names: list[str] = []
        self._load(None)

    def _load(self, past: str | None) -> None:
        """The next row group that can hold a group greater than `past`."""
        self.names, self.at, self.row = [], 0, 0
        while self.next < self.file.num_row_groups and not self.names:
            number, self.next = self.next, self.next + 1
            known = self.file.metadata.row_group(number).column(0).statistics
            if past is not None and known is not None and known.has_min_max and isinstance(known.max, str) and known.max <= past:
                continue
            self.groups_read += 1
            table = self.file.read_row_group(number, columns=["grp", "score", "id"]).combine_chunks()
            coded = table["grp"].chunk(0).dictionary_encode() if table.num_rows else None
            if coded is None:
                continue
            codes = coded.indices.to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1])
            words = coded.dictionary.to_pylist()
            self.names, self.ends = [words[c] for c in codes[starts]], [*starts[1:].tolist(), len(codes)]
            self.scores, self.ids = table["score"].to_numpy(), table["id"].to_numpy()

    def head(self) -> tuple[str, float, int] | None:
        if not self.names:
            return None
        return self.names[self.at], -float(self.scores[self.row]), int(self.ids[self.row])

    def advance(self) -> None:
        self.row += 1
        if self.row == self.ends[self.at]:
            self.at += 1
            if self.at == len(self.names):
                self._load(None)

    def seek_past(self, group: str) -> None:
        """Move to the first row of a group greater than this one."""
        while self.names and self.names[self.at] <= group:
            self.row, self.at = self.ends[self.at], self.at + 1
            if self.at == len(self.names):
                self._load(group)


def merged(runs: list, n: int) -> Iterator[tuple[str, float, int, int]]:
    """(group, score, id, place) of the n first rows of every group, from all runs."""
    tree = LoserTree([run.head() for run in runs])
    group, place = None, 0
    while (least := tree.heads[tree.winner]) is not None:
        run = runs[tree.winner]
        if least[0] != group:
            group, place = least[0], 0
        if place == n:
            run.seek_past(group)
        else:
            place += 1
            yield group, -least[1], least[2], place
            run.advance()
        tree.replace(run.head())


def _merge_tasks(batches: Iterator[pa.RecordBatch], folder: str, n: int, fan_in: int) -> Iterator[pa.RecordBatch]:
    names = ["bucket", "chunk", "grp", "score", "id", "place"]
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int64(), pa.int32()]
    for batch in batches:
        for bucket, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            stored = [f for f in shared.listed_below(shared.joined(folder, f"bucket={bucket}")) if f.endswith(".parquet")]
            files = [f for f in stored if chunk * fan_in <= int(f.rsplit("/", 2)[1].removeprefix("run=")) < (chunk + 1) * fan_in]
            rows = []
            for row in merged([StoredRun(f) for f in files], n):
                rows.append((bucket, chunk, *row))
                if len(rows) == 8_192:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _stored(rows: DataFrame) -> str:
    """Write (bucket, run, grp, score, id), sorted in each partition, as one file a run; returns the folder."""
    folder = scratch_folder(rows.sparkSession, "runs")
    rows.select("bucket", "run", "grp", "score", "id").write.partitionBy("bucket", "run").option("parquet.block.size", ROW_GROUP_BYTES).parquet(folder)
    return folder


def store_runs(rows: DataFrame, buckets: int, run_rows: int | Callable[[int], int]) -> tuple[str, int]:
    """(folder, most runs of a bucket) of `rows` (grp, item, version, score, id), newest versions only.

    The shuffle by (bucket, run) serves the choice of versions and the order of the
    run. A group is dealt by item, so an item's versions meet.
    """
    hot, n_hot = hot_keys(rows, ["grp"], run_rows)
    most = hot.agg(F.max("parts")).first()[0] if n_hot else 1
    placed = dealt(rows, (hot, n_hot), ["grp"], "item", "run").withColumn("bucket", F.pmod(F.xxhash64("grp"), F.lit(buckets)).cast("int"))
    placed = placed.repartition("bucket", "run")
    newest = F.row_number().over(W.partitionBy("bucket", "run", "grp", "item").orderBy(F.desc("version"), "id"))
    kept = placed.withColumn("v", newest).filter("v = 1")
    return _stored(kept.sortWithinPartitions("bucket", "run", "grp", F.desc("score"), "id")), most


def merge_runs(spark: SparkSession, folder: str, buckets: int, most: int, n: int, fan_in: int = FAN_IN) -> DataFrame:
    """(grp, id, place) from stored runs, in as many passes as the fan-in takes."""
    schema = "bucket int, chunk int, grp string, score double, id long, place int"
    while True:
        chunks = -(-most // fan_in)
        tasks = spark.range(0, buckets * chunks, 1, buckets * chunks).select((F.col("id") % buckets).cast("int").alias("bucket"), F.floor(F.col("id") / buckets).cast("int").alias("chunk"))
        out = tasks.mapInArrow(lambda batches, folder=folder: _merge_tasks(batches, folder, n, fan_in), schema)
        if chunks == 1:
            return out.select("grp", "id", "place")
        folder, most = _stored(out.withColumnRenamed("chunk", "run")), chunks


def top_n(items: DataFrame, group: Column, item: Column, version: Column, score: Column, number: Column, n: int, run_rows: int = RUN_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """(grp, id, place): the up to n best items of each group.

    There are as many buckets as shuffle partitions. A group gets several runs when it
    has more than `run_rows` rows and more than a quarter of what a bucket holds on
    average, so the runs are at most some four times as many as the buckets. They are
    stored in the shared folder and read whenever the result is.
    """
    spark = items.sparkSession
    rows = items.select(group.cast("string").alias("grp"), item.alias("item"), version.alias("version"), (score.cast("double") + F.lit(0.0)).alias("score"), number.cast("long").alias("id"))
    rows = rows.filter("grp IS NOT NULL AND item IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) AND id IS NOT NULL")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder, most = store_runs(rows, buckets, lambda total: max(run_rows, -(-total // (4 * buckets))))
    return merge_runs(spark, folder, buckets, most, n, fan_in)
