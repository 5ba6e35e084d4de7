import random

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import cutoff
from tessella.llm.cutoff import cut_texts, features, fit, length_limits, probabilities, _matrix

SLOTS = {
    "side": ["phải", "trái", "đỉnh tuyến", "đáy tuyến", "hai bên", "vùng ngoại vi"], "zone": ["left", "right", "apical", "basal", "bilateral", "peripheral zone"],
    "amount": ["mild", "marked", "focal", "patchy", "diffuse", "subtle", "moderate", "scattered"], "how": ["nhẹ", "rõ", "khu trú", "rải rác", "lan tỏa", "kín đáo"],
    "tissue": ["stroma", "smooth muscle", "acini", "the capsule", "small vessels", "glandular lumina"], "n": [str(i) for i in range(1, 99)],
}
PARTS = ["Kết luận: tăng sản lành tính, phần {side}.", "Conclusion: benign hyperplasia, {zone}.", "Tỉ lệ tổn thương ước lượng {n}%, chênh nhau {n} điểm giữa hai lần đọc.", "Glands proliferate with {amount} crowding and two cell layers, {tissue} unremarkable.",
    "PSA trước sinh thiết là {n}.{n} ng/ml, phù hợp với tổn thương {how}.", "The border between {tissue} and the lesion is {amount}.", "Mảnh B{n} có hình ảnh dạng sàng {how}, cần nhuộm thêm.", "Core {n} is very thin and needs {n} deeper levels.",
    "Bề mặt mảnh cắt {how}, không thấy ổ hoại tử.", "Endothelial swelling is {amount} without thrombosis.", "Mực đen đánh dấu bờ {side}, bờ còn lại để trống.", "The enclosed file lists PSA {n}.{n} ng/ml over {n} months."]
ENDS = ["", "", "\nBlock: D6", "\nKý duyệt: GPB-14", " [OK]", "\n-- hết phiếu --", "  "]


def corpus(seed, n, limit=300):
    """(id, text, source, cut): some texts cut at the limit, some in transfer, some whole ones without a stop."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        source = draw.choice(["report", "note"])
        text = " ".join(part.format(**{k: draw.choice(v) for k, v in SLOTS.items()}) for part in draw.choices(PARTS, k=draw.randint(2, 7)))
        closed = text.rstrip(".") if draw.random() < 0.1 else text + draw.choice(ENDS)
        cut = False
        if source == "report" and len(closed) > limit:
            closed, cut = closed[:limit], True
        elif draw.random() < 0.05:
            closed, cut = text[: draw.randint(10, len(text) - 5)] + draw.choice(["", "", "…", "--more--"]), True
        if cut and closed.rstrip()[-1] in ".":
            cut = None
        rows.append((i, closed, source, cut))
    return rows


def test_cut_texts_are_found(spark):
    rows = corpus(1, 3000)
    df = spark.createDataFrame([(i, t, s, "x", 3) for i, t, s, _ in rows], "no long, body string, source string, tail string, limits int")
    got = {r.no: r.cut for r in cut_texts(df, "no", "body", "source").collect()}
    known = [(got[i], c) for i, _, _, c in rows if c is not None]
    true = sum(a and c for a, c in known)
    assert true / sum(c for _, c in known) > 0.9 and true / max(1, sum(a for a, _ in known)) > 0.9


def test_held_out_accuracy():
    rows = corpus(2, 2500)
    x = _matrix([features(t[-96:], s, 0, False) for _, t, s, c in rows if c is not None])
    y = np.array([float(c) for *_, c in rows if c is not None])
    half = len(y) // 2
    p = probabilities(x[half:], fit(x[:half], y[:half]))
    assert ((p >= 0.5) == (y[half:] == 1)).mean() > 0.95


def test_limits_are_found_in_characters_and_bytes(spark):
    draw = random.Random(3)
    rows = [("a", draw.randint(20, 99), 0) for _ in range(500)] + [("a", 100, 0)] * 40 + [("b", draw.randint(20, 90), draw.randint(200, 290)) for _ in range(300)] + [("b", draw.randint(91, 99), 300) for _ in range(30)]
    got = {(r.source, r.unit, r["size"]) for r in length_limits(spark.createDataFrame(rows, "source string, chars int, bytes int")).collect()}
    assert ("a", "chars", 100) in got and ("b", "bytes", 300) in got and not any(s < 90 for n, u, s in got if u == "chars")


def test_blank_texts_have_no_row_and_copies_agree(spark):
    base = [(i, t, s) for i, t, s, _ in corpus(4, 300)]
    rows = base + [(1000 + i, t, s) for i, t, s in base[:50]] + [(2000, None, "note"), (2001, "", "note"), (2002, "  \n", None), (2003, "A whole sentence.", None), (2004, "x" * 200_000, "note")]
    got = {r.no: round(r.p, 6) for r in cut_texts(spark.createDataFrame(rows, "no long, body string, source string"), "no", "body", "source").collect()}
    assert not {2000, 2001, 2002} & got.keys() and {2003, 2004} <= got.keys() and len(got) == 352
    assert all(got[1000 + i] == got[i] for i in range(50))


def test_no_texts(spark):
    df = spark.createDataFrame([(1, None, "a")], "no long, body string, source string")
    assert cut_texts(df, "no", "body", "source").count() == 0 and cut_texts(df.limit(0), "no", "body", "source").count() == 0
    assert df.filter(F.col("no") < 0).count() == 0


def test_rare_sources_are_not_crowded_out_of_the_fit(spark, monkeypatch):
    got, examples = [], cutoff._examples
    monkeypatch.setattr(cutoff, "_examples", lambda rows, often, seed: got.extend(r.source for r in rows) or examples(rows, often, seed))
    rows = [(i, f"Some text of number {i}.", "rare" if i < 20 else "ab"[i % 2]) for i in range(2000)]
    cut_texts(spark.createDataFrame(rows, "no long, body string, source string"), "no", "body", "source", sample=200, per_source=150).count()
    assert {s: got.count(s) for s in set(got)} == {"rare": 20, "a": 90, "b": 90}


def test_the_sample_has_the_least_hashes_of_each_source(spark):
    rows = spark.range(30_000).select("id", F.when(F.col("id") % 50 == 0, "rare").when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    got = cutoff.sampled(rows, 3000, 1400, 5).collect()
    key = {r.id: r.k for r in rows.select("id", F.xxhash64("id", F.lit(5)).alias("k")).collect()}
    of = {r.id: r.source for r in rows.collect()}
    for source, n in (("rare", 600), ("a", 1200), ("b", 1200)):
        assert {r.id for r in got if r.source == source} == set(sorted((i for i in of if of[i] == source), key=key.get)[:n])


def test_fair_level():
    assert cutoff.fair_level([(5, 2), (100, 1)], 30, 50) == 20 and cutoff.fair_level([(5, 1)], 30, 50) == 50 and cutoff.fair_level([(1, 99)], 3, 50) == 1


def test_copies_are_counted_over_all_texts_by_share(spark):
    """An ending that 2 in 1,000 texts have speaks for itself at any size, though the sample holds few of them."""
    for n in (1000, 20_000):
        rows = spark.range(n).select("id", F.lit("s").alias("source"), F.when(F.col("id") % 500 == 0, "a long ending that comes again").otherwise(F.concat(F.lit("ending of number "), "id")).alias("tail"), F.lit(0).alias("limits"))
        sample = [r for r in rows.withColumn("code", F.xxhash64("tail")).withColumn("of_all", F.lit(n)).filter("id % 500 = 0 OR id < 50").collect()]
        found = cutoff.many_copies(rows, sample, 400)
        assert len(found) == (n // 500 >= 5 * max(1, n / 400))
    rows = rows.withColumn("tail", F.when(F.col("id") % 50 == 0, "again and again and again").otherwise(F.col("tail")))
    sample = [r for r in rows.withColumn("code", F.xxhash64("tail")).withColumn("of_all", F.lit(n)).filter("id < 60").collect()]
    assert len(cutoff.many_copies(rows, sample, 400)) == 1
    assert not cutoff.many_copies(rows.withColumn("limits", F.lit(1)), sample, 400)
