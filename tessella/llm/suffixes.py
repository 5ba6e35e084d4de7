"""Shared spans of records in different splits, by a suffix array over partitions.

The suffixes of all texts lie sorted in partitions of bounded size, each a range of the
one array; records with equal suffixes follow each other by their ids, so a suffix that
very many records have is spread over as many partitions as it fills. In this order the
longest prefix a suffix shares with any suffix of the other side is the one it shares
with the nearest of them before or after it. A partition learns the nearest ones of the
other partitions from a list with at most four entries a partition. Suffixes that share
less than a least span with the other side, nearly all, are left out; the spans of the
others are merged into the coverage of their record, or tell which records to compare.

A suffix is stored as at most `reach` bytes. A span that is longer than that shows at
the places after its start too, so its coverage is the same.

Defined cases: null texts and texts shorter than the span share nothing; equal texts of
both sides are wholly covered; repeated rows count once; no texts give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.session import cut_lineage

#: Suffixes of one partition of the array, about.
PART_ROWS = 500_000
#: Keys of stretches up to this number are broadcast (some 40 bytes each); beyond it they are joined by shuffle.
BROADCAST_KEYS = 100_000
#: Rows compared at once.
_BLOCK = 65_536


def suffixes(records: DataFrame, span: int, step: int = 1, reach: int = 64, aligned: bool = False) -> DataFrame:
    """(place, suffix, left, id, start, least) of `records` (id, left, text), text being binary.

    `step` takes suffixes only where a span may start; `aligned` keeps apart suffixes
    from different places, as the digits of a digest mean different things there. The
    text must be in bytes whose order and units are those of interest, see `coverage`.
    """
    starts = F.when(F.length("text") >= span, F.sequence(F.lit(1), F.length("text") - span + 1, F.lit(step)))
    cut = records.select("id", "left", "text", F.explode(starts).alias("start"))
    return cut.select((F.col("start") if aligned else F.lit(0)).alias("place"), F.expr(f"substring(text, start, {reach})").alias("suffix"), "left", "id", "start", F.lit(span).alias("least"))


def suffix_array(rows: DataFrame, part_rows: int = PART_ROWS, n: int | None = None) -> DataFrame:
    """`rows` (place, suffix, left, id, ...) sorted over partitions, with the partition's number as `part`.

    They are written to the checkpoint folder, since they are read twice. `n` is an upper
    bound of their number, where one is known without counting them.
    """
    spark = rows.sparkSession
    fewest = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = rows.count() if n is None else n
    parts = max(1, -(-n // part_rows), min(fewest, -(-n // 20_000)))
    order = ["place", "suffix", "left", "id"]
    return cut_lineage(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))


def _ends(array: DataFrame) -> dict[int, list]:
    """By partition: the nearest (place, suffix, left) of either side before it and after it."""
    row = F.struct("place", "suffix")
    ends = array.groupBy("part", "left").agg(F.min(row).alias("first"), F.max(row).alias("last")).collect()
    parts = sorted({e.part for e in ends})
    found: dict[int, list] = {p: [] for p in parts}
    at = {(e.part, e.left): e for e in ends}
    for order, name in ((parts, "last"), (parts[::-1], "first")):
        near: dict[bool, tuple] = {}
        for p in order:
            found[p].append([(*v, side) for side, v in near.items()])
            for side in (False, True):
                if (p, side) in at:
                    near[side] = tuple(at[p, side][name])
    return found


def _matrix(values: pa.Array, width: int) -> np.ndarray:
    """Byte strings as rows of one matrix, filled up with zeros."""
    sizes = np.diff(np.frombuffer(values.buffers()[1], dtype=np.int32, count=len(values) + 1, offset=4 * values.offset))
    out = np.zeros((len(values), width), dtype=np.uint8)
    data = np.frombuffer(values.buffers()[2] or b"", dtype=np.uint8)
    begin = int(np.frombuffer(values.buffers()[1], dtype=np.int32, count=1, offset=4 * values.offset)[0])
    data = data[begin : begin + int(sizes.sum())]
    if len(sizes) and sizes.min() == sizes.max() == width:
        return data.reshape(-1, width).copy()
    out[np.arange(width)[None, :] < sizes[:, None]] = data
    return out


def nearest_shared(place: np.ndarray, text: np.ndarray, size: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Of each of the sorted rows: the bytes it shares with the nearest rows of the other side."""
    n = len(place)
    out = np.zeros(n, dtype=np.int32)
    number = np.arange(n)
    for step in (1, -1):
        seen = number[::step]
        near = np.full(n, -1)
        for side in (False, True):
            marks = np.where(left[seen] == side, np.arange(n), -1)
            last = np.maximum.accumulate(marks)
            last = np.where(last >= 0, seen[np.maximum(last, 0)], -1)
            wanted = left[seen] != side
            near[seen[wanted]] = last[wanted]
        for a in range(0, n, _BLOCK):
            rows = number[a : a + _BLOCK]
            rows = rows[near[rows] >= 0]
            other = near[rows]
            differ = text[rows] != text[other]
            same = np.where(differ.any(axis=1), differ.argmax(axis=1), text.shape[1])
            same = np.minimum(same, np.minimum(size[rows], size[other]))
            out[rows] = np.maximum(out[rows], np.where(place[rows] == place[other], same, 0))
    return out


def _shared_in_part(batches: Iterator[pa.RecordBatch], ends: dict[int, list]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    column = {c: table[c].chunk(0) for c in table.column_names}
    before, after = ends[column["part"][0].as_py()]
    around = [*before, *after]
    n, a, b = table.num_rows, len(before), len(after)
    suffix = pa.concat_arrays([pa.array([bytes(e[1]) for e in before], pa.binary()), column["suffix"].cast(pa.binary()), pa.array([bytes(e[1]) for e in after], pa.binary())])
    size = np.array([len(e[1]) for e in before] + np.diff(np.frombuffer(suffix.buffers()[1], dtype=np.int32, count=len(suffix) + 1))[a : a + n].tolist() + [len(e[1]) for e in after], dtype=np.int32)
    place = np.concatenate([[e[0] for e in before], column["place"].to_numpy(), [e[0] for e in after]]).astype(np.int64)
    left = np.concatenate([[e[2] for e in before], column["left"].to_numpy(zero_copy_only=False), [e[2] for e in after]]).astype(bool)
    del around
    shared = nearest_shared(place, _matrix(suffix, int(size.max(initial=1)) or 1), size, left)[a : a + n]
    kept = np.flatnonzero(shared >= column["least"].to_numpy())
    if len(kept):
        out = table.take(pa.array(kept)).drop_columns(["part"]).append_column("shared", pa.array(shared[kept], pa.int32()))
        yield from out.combine_chunks().to_batches()


def shared_spans(rows: DataFrame, part_rows: int = PART_ROWS, n: int | None = None) -> DataFrame:
    """The rows of a suffix array that share at least `least` bytes with one of the other side, with `shared`.

    `rows` has (place, suffix, left, id, least, ...); all columns but the helper `part`
    come out again.
    """
    array = suffix_array(rows, part_rows, n)
    ends = array.sparkSession.sparkContext.broadcast(_ends(array))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in array.schema if f.name != "part") + ", shared int"
    return array.mapInArrow(lambda batches: _shared_in_part(batches, ends.value), schema)


def merged_length(spans: Column) -> Column:
    """Units covered by an array of (s, e) spans, e being exclusive, overlaps counted once."""
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    return F.aggregate(F.sort_array(spans), none, lambda m, x: F.struct((m["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], m["upto"]))).alias("n"), F.greatest(m["upto"], x["e"]).alias("upto")), lambda m: m["n"])


#: A text is cut into blocks of so many characters before its spans are merged.
MERGE_BLOCK = 4_096


def coverage(records: DataFrame, span: int, aligned: bool = False, part_rows: int = PART_ROWS, ascii_only: bool = False) -> DataFrame:
    """(id, left, covered): characters of each record's text in spans that a record of the other side has too.

    `records` has (id, left, text), one text an id. Every place of a text starts a suffix,
    stored as far as the span, in characters of four bytes (one if all are ASCII), so that
    any text may be given whole; a longer span is what those at the next places add up to. Spans are merged within blocks of the text, so a very long
    text is never one row.
    """
    unit = 1 if ascii_only else 4
    coded = records.select("id", "left", F.encode("text", "US-ASCII" if ascii_only else "UTF-32").alias("text")).filter("text IS NOT NULL").distinct()
    found = shared_spans(suffixes(coded, unit * span, unit, unit * span, aligned), part_rows)
    spans = found.select("id", "left", ((F.col("start") - 1) / unit).cast("int").alias("s"), F.floor(F.col("shared") / unit).cast("int").alias("n"))
    first, last = F.floor(F.col("s") / MERGE_BLOCK).cast("int"), F.floor((F.col("s") + F.col("n") - 1) / MERGE_BLOCK).cast("int")
    cut = spans.select("id", "left", "s", (F.col("s") + F.col("n")).alias("e"), F.explode(F.sequence(first, last)).alias("block"))
    cut = cut.select("id", "left", "block", F.struct(F.greatest("s", F.col("block") * MERGE_BLOCK).alias("s"), F.least("e", (F.col("block") + 1) * MERGE_BLOCK).alias("e")).alias("x"))
    merged = cut.groupBy("id", "left", "block").agg(merged_length(F.collect_set("x")).alias("n"))
    return merged.groupBy("id", "left").agg(F.sum("n").cast("int").alias("covered"))


def differing_bits(a: Column, b: Column, digits: int = 32) -> Column:
    """Bits in which two strings of hexadecimal digits differ."""
    parts = [(F.conv(F.substring(a, i, 8), 16, 10).cast("long"), F.conv(F.substring(b, i, 8), 16, 10).cast("long")) for i in range(1, digits, 8)]
    return reduce(lambda x, y: x + y, [F.bit_count(x.bitwiseXOR(y)) for x, y in parts])


def turned_digests(digest: Column, bits: int, digits: int = 32) -> list[tuple[int, Column]]:
    """(place, suffix) of a digest in bytes at each place where two digests may agree.

    Of bits + 1 equal segments of two digests that differ in up to `bits` bits one is the
    same in both, so they share a span of digits / (bits + 1) at the same place. A
    suffix is written with what is before it behind it, so it holds the whole digest.
    """
    width = digits // (bits + 1) // 2
    if width < 1 or width * 2 * (bits + 1) != digits:
        raise ValueError("digits must be a multiple of 2 * (bits + 1)")
    return [(place, F.concat(digest.substr(place * width + 1, digits), digest.substr(1, place * width)) if place else digest) for place in range(bits + 1)]


def digest_suffixes(records: DataFrame, bits: int, digits: int = 32) -> DataFrame:
    """(place, suffix, left, id, least) of `records` (id, left, text), text being a digest of `digits` hexadecimal digits."""
    coded = records.select("id", "left", F.unhex("text").alias("text"))
    entries = F.array(*[F.struct(F.lit(place).alias("place"), suffix.alias("suffix")) for place, suffix in turned_digests(F.col("text"), bits, digits)])
    return coded.select("id", "left", F.explode(entries).alias("t")).select("t.place", "t.suffix", "left", "id", F.lit(digits // (bits + 1) // 2).alias("least"))


def digest_of(place: Column, suffix: Column, bits: int, digits: int = 32) -> Column:
    """The digest of a row of `digest_suffixes`."""
    return F.lower(F.hex(F.concat(suffix.substr(F.lit(digits // 2 + 1) - place * (digits // (bits + 1) // 2), F.lit(digits)), suffix.substr(F.lit(1), F.lit(digits // 2) - place * (digits // (bits + 1) // 2)))))


def _segments(parts: int) -> Column:
    """(segment, remainder) structs that cut `rest` into equal parts, each taken out once."""
    def cut(i: Column) -> Column:
        low = F.floor(i * F.length("rest") / parts).cast("int")
        high = F.floor((i + 1) * F.length("rest") / parts).cast("int")
        return F.struct(F.concat_ws(":", F.col("key"), i.cast("string"), F.substring(F.col("rest"), low + 1, high - low)).alias("key"), F.concat(F.substring(F.col("rest"), F.lit(1), low), F.substring(F.col("rest"), high + 1, F.length("rest"))).alias("rest"))

    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), cut)


def near_digests(spans: DataFrame, bits: int = 3, digits: int = 32, most: int = 1_000_000) -> DataFrame:
    """(a, b): digests of the left and the right side that differ in 1 to `bits` bits.

    `spans` are the rows of `digest_suffixes` that `shared_spans` keeps, so they lie in
    stretches of the array with a common prefix and both sides. All pairs of a stretch
    are compared in full. One with more than `most` combinations is cut first: what
    remains of its digests agrees in one of bits + 1 segments too, and so on until the
    remainder is so short that the stretch holds few different digests. So the result is
    exact.
    """
    width = digits // (bits + 1)
    held = spans.select("place", digest_of(F.col("place"), F.col("suffix"), bits, digits).alias("text"), F.hex(F.expr(f"substring(suffix, 1, {width // 2})")).alias("prefix"), F.hex(F.expr(f"substring(suffix, {width // 2} + 1)")).alias("rest"), "left").distinct()
    rows = cut_lineage(held.select("text", "left", F.concat_ws(":", F.col("place").cast("string"), "prefix").alias("key"), "rest"))
    found, remaining = None, digits - width
    while True:
        counts = rows.groupBy("key").agg(F.count_if("left").alias("nl"), F.count_if(~F.col("left")).alias("nr")).filter("nl > 0 AND nr > 0")
        counts = cut_lineage(counts.select("key", (F.col("nl") * F.col("nr")).alias("n")))
        few = F.broadcast if counts.count() <= BROADCAST_KEYS else (lambda keys: keys)
        small = counts if remaining <= bits + 1 else counts.filter(F.col("n") <= most)
        kept = rows.join(few(small.select("key")), "key", "left_semi")
        pairs = kept.filter("left").select("key", F.col("text").alias("a")).join(kept.filter(~F.col("left")).select("key", F.col("text").alias("b")), "key").filter("a <> b").select("a", "b")
        pairs = pairs.filter(differing_bits(F.col("a"), F.col("b"), digits) <= bits)
        found = pairs if found is None else found.unionByName(pairs)
        if remaining <= bits + 1 or counts.filter(F.col("n") > most).isEmpty():
            return found.distinct()
        dense = rows.join(few(counts.filter(F.col("n") > most).select("key")), "key", "left_semi")
        rows = cut_lineage(dense.select("text", "left", F.explode(_segments(bits + 1)).alias("s")).select("text", "left", "s.key", "s.rest"))
        remaining -= remaining // (bits + 1)
