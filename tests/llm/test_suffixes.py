import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import overlaps_queries
from tessella.llm import suffixes
from tessella.llm.suffixes import coverage, differing_bits, digest_suffixes, near_digests, nearest_shared, shared_spans


def flip(digest, bits, draw):
    value = int(digest, 16)
    for b in draw.sample(range(128), bits):
        value ^= 1 << b
    return f"{value:032x}"


def digests(seed, n, shared=""):
    draw = random.Random(seed)
    out = {}
    for _ in range(n):
        base = shared + f"{draw.getrandbits(128):032x}"[len(shared) :]
        out[base] = (draw.random() < 0.7, False)
        for bits in (1, 2, 3, 4, 5):
            if draw.random() < 0.3:
                out.setdefault(flip(base, bits, draw), (False, True))
    return [(t, left, right or not left) for t, (left, right) in out.items()]


def records(spark, rows):
    return spark.createDataFrame([(t, side, t) for t, *sides in rows for side, there in zip((True, False), sides, strict=True) if there], "id string, left boolean, text string")


def near_spans(spark, rows, part_rows=100):
    return shared_spans(digest_suffixes(records(spark, rows), 3), part_rows)


def brute(rows, bits=3):
    a, b = [t for t, x, _ in rows if x], [t for t, _, x in rows if x]
    return {(x, y) for x in a for y in b if x != y and (int(x, 16) ^ int(y, 16)).bit_count() <= bits}


@pytest.mark.parametrize("shared,most", [("", 1_000_000), ("", 2), ("0123456789abcdef", 40), ("00000000000000000000000000", 5)])
def test_all_near_pairs_are_found(spark, shared, most):
    rows = digests(len(shared) + most % 7, 120, shared)
    got = {(r.a, r.b) for r in near_digests(near_spans(spark, rows), most=most).collect()}
    assert got == brute(rows) and got


def test_differing_bits(spark):
    row = spark.createDataFrame([("f" * 32, "0" * 31 + "1")], "a string, b string").select(differing_bits(F.col("a"), F.col("b")).alias("n")).first()
    assert row.n == 127


def test_nearest_shared_against_all_pairs():
    draw = random.Random(3)
    rows = sorted((draw.randrange(2), bytes(draw.choices(b"ab", k=draw.randint(1, 6))), draw.random() < 0.5) for _ in range(300))
    width = max(len(t) for _, t, _ in rows)
    text = np.array([list(t.ljust(width, b"\0")) for _, t, _ in rows], dtype=np.uint8)
    got = nearest_shared(np.array([p for p, _, _ in rows]), text, np.array([len(t) for _, t, _ in rows]), np.array([x for _, _, x in rows]))
    for (p, t, x), n in zip(rows, got, strict=True):
        assert n == max([len(os.path.commonprefix([t, u])) for q, u, y in rows if q == p and y != x], default=0)


def test_one_suffix_of_all_records_is_spread_over_partitions(spark):
    rows = spark.range(5000).select(F.lit(0).alias("place"), F.lit(b"same").alias("suffix"), (F.col("id") % 1000 != 7).alias("left"), "id", F.lit(4).alias("least"))
    array = suffixes.suffix_array(rows, 1000)
    assert array.groupBy("part").count().agg(F.max("count")).first()[0] < 2500
    assert shared_spans(rows, 1000).count() == 5000


def plain_coverage(texts, span):
    out = {}
    for side, other in ((1, 2), (2, 1)):
        rest = [t for t in texts if t[other]]
        for t in texts:
            if not t[side]:
                continue
            marks = set()
            for i in range(len(t[0]) - span + 1):
                if any(t[0][i : i + span] in o[0] for o in rest):
                    marks |= set(range(i, i + span))
            if marks:
                out[t[0], "lr"[side - 1]] = len(marks)
    return out


def test_coverage_by_nearest_suffixes(spark):
    draw = random.Random(5)
    words = ["mô đệm", "tuyến", "benign", "x", "lát cắt 12", "hyperplasia"]
    texts = list({" ".join(draw.choices(words, k=draw.randint(1, 7))): (draw.random() < 0.6, draw.random() < 0.5) for _ in range(60)}.items())
    rows = [(t, a, b) for t, (a, b) in texts]
    got = {(r.id, "l" if r.left else "r"): r.covered for r in coverage(records(spark, rows), 8, part_rows=500).collect()}
    assert got == plain_coverage(rows, 8) and got


def test_short_null_and_absent_texts(spark):
    odd = [(1, True, None), (2, True, ""), (2, False, ""), (3, True, "abc"), (4, False, "abc")]
    assert coverage(spark.createDataFrame(odd, "id long, left boolean, text string"), 8).count() == 0
    assert near_digests(near_spans(spark, [])).count() == 0
    assert coverage(spark.createDataFrame([], "id long, left boolean, text string"), 8).count() == 0


def test_very_long_texts_are_merged_in_blocks(spark):
    draw = random.Random(9)
    middle = "".join(draw.choices("abcdefgh ", k=9_000))
    a, b = "".join(draw.choices("xyz", k=700)) + middle + "q" * 5, "w" * 11 + middle + "".join(draw.choices("ijk", k=300))
    got = {r.id: r.covered for r in coverage(spark.createDataFrame([(1, True, a), (2, False, b)], "id long, left boolean, text string"), 20, part_rows=4000).collect()}
    assert got == {1: 9_000, 2: 9_000}


def plain_aligned_coverage(texts, span):
    out = {}
    for side, other in ((1, 2), (2, 1)):
        rest = [t for t in texts if t[other]]
        for t in texts:
            marks = {j for i in range(len(t[0]) - span + 1) if t[side] and any(t[0][i : i + span] == o[0][i : i + span] for o in rest) for j in range(i, i + span)}
            if marks:
                out[t[0], "lr"[side - 1]] = len(marks)
    return out


def test_p6_coverage_counts_spans_from_any_digit(spark, monkeypatch):
    base = "0123456789abcdef" * 2
    rows = [(base, True, False), (base[:11] + "0" + base[12:], False, True)]  # differs in digit 12 only
    other = "fedcba9876543210" * 2
    rows += [(other, True, False), ("0" * 3 + other[3:14] + "f" * 18, False, True)]  # shares digits 4 to 14, which hold no whole block
    draw = random.Random(6)
    rows += [(t, left, right) for t, left, right in digests(6, 40) if left != right]
    for _ in range(30):  # a span of 6 to 20 digits at a random place
        t, n = f"{draw.getrandbits(128):032x}", draw.randint(6, 20)
        at = draw.randint(0, 32 - n)
        rows += [(t, True, False), (f"{draw.getrandbits(128):032x}"[:at] + t[at : at + n] + f"{draw.getrandbits(128):032x}"[at + n :], False, True)]
    facts = spark.createDataFrame([(f"I{i}", left, t) for i, (t, left, _) in enumerate(rows)], "image string, left boolean, thumb string")
    monkeypatch.setattr(overlaps_queries, "image_facts", lambda *_: facts)
    got = {(rows[int(r.image[1:])][0], {"train": "l", "other": "r"}[r.side]): r.covered for r in overlaps_queries.p6_coverage(spark, "").collect()}
    assert got == plain_aligned_coverage(rows, 8)
    assert got[base, "l"] == 31 and got[other, "l"] == 11


def test_overlaps_with_odd_values(spark, monkeypatch):
    """Very long, null, repeated and ill-formed values; an image that lists itself and one that nobody has."""
    long, thumb = "L" * 200_000, "0123456789abcdef" * 2
    rows = [
        ("A", True, "train", None, "s1", thumb, ["B", long]), ("B", False, "val", "x", None, None, None), (long, False, "test", "x", "f" * 64, "no digest", ["A", None]),
        ("C", True, "train", "x", "F" * 64, "no digest", ["C", "nobody"]), ("D", False, "val", "x", "s1", thumb[:-1] + "e", []), ("D", False, "val", "x", "s1", thumb[:-1] + "e", []),
        ("E", False, "val", "x", "S1" + long, thumb[:-2] + "00", None), ("G", True, "train", "x", "S1" + long, None, None),
    ]
    facts = spark.createDataFrame(rows, "image string, left boolean, split string, source string, sha string, thumb string, others array<string>")
    facts = facts.withColumn("sha", F.lower("sha"))
    monkeypatch.setattr(overlaps_queries, "image_facts", lambda *_: facts)
    got = {(r.image_a, r.image_b) for r in overlaps_queries.p6_found(spark, "").collect()}
    assert got == {("A", "B"), ("A", long), ("A", "D"), ("C", long), ("E", "G")}
    report = {(r.split, r.reason): (r.n_images, r.n_links) for r in overlaps_queries.p6_report(spark, "").collect()}
    assert report == {("val", "list"): (1, 1), ("test", "list"): (1, 2), ("val", "sha"): (2, 2), ("test", "sha"): (1, 1), ("val", "thumb"): (1, 1), ("test", "thumb"): (1, 1)}
