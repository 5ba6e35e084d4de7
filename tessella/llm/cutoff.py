"""Texts that stop before their author did, by a hashed logistic regression.

Intact values are cut artificially to make positive examples: some as a field's length
limit cuts, some as a broken transfer does, with or without one of the marks that tools
leave. The model sees the closing characters, words and line, punctuation, and whether
the length lies at a limit of the source; it thus learns how texts of each source end.
Some texts taken as intact are cut themselves: those that fits on other texts take for
cut ones are left out, and the last fit is made without them. Then every record is scored.

Length limits are found over all texts: a length, in characters or bytes, that many
more texts of a source have than any length near it.

The sample for the fit has at most `per_source` texts a source and `sample` in all, of
each source the ones with the least hashes, and as many of each as of any other as long
as it has them, so that a rare source is not crowded out; everything else covers all texts.

Defined cases: null, empty and blank texts are no records here and get no row; a text
of a source not seen in the fit is judged by what holds for all; repeated texts get
equal scores; no texts give no rows. A fit without any text scores everything as whole.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.session import cut_lineage

#: Hashed weights; 2^18 of 4 bytes go to each worker.
BITS = 18
#: Most features of one text.
WIDTH = 30
#: Characters of the ending that are looked at.
TAIL = 96
#: Marks that tools leave where they stop (fixed values).
MARKS = ("…", "...", " …", " ...", " [...", " [...]", " [", "--more--", "--More--", "�", "<more>", "[truncated]", " (cont", "[cut]", " <tr", "&nb", "<", "&", " <br", "&am")
#: Texts used for the fit, in all and of one source.
SAMPLE, PER_SOURCE = 30_000, 6_000
#: Limits up to this number are broadcast.
BROADCAST_LIMITS = 100_000
#: Probability from which a text counts as cut.
THRESHOLD = 0.5
#: Texts whose ending, judged by fits without them, is cut with at least this probability
#: are no examples of whole texts, sooner so if their length lies at a limit; that is
#: found in so many rounds over so many folds.
DOUBT, DOUBT_AT_LIMIT, ROUNDS, FOLDS = 0.6, 0.3, 2, 3
#: So many equal endings among SAMPLE texts, or the same share of more, speak for themselves; of whole texts up to SHORT characters, so many.
COPIES, SHORT_COPIES, SHORT = 5, 3, 24

#: What may follow a text's last character: all Unicode blanks, and marks without width.
_BLANKS = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
_HEX = re.compile(r"\b(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])[0-9a-f]{5,}\b")
_NUMBER = re.compile(r"\d+")


def _kind(c: str) -> str:
    if c.isalpha():
        return "A"
    if c.isdigit():
        return "9"
    return c if ord(c) < 0x2100 or c == "�" else "S"


def _folded(text: str) -> str:
    """Without marks on letters, so that texts typed without them share words with others."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).replace("đ", "d")


def features(tail: str, source: str, limits: int, opened: bool) -> array:
    """Hashes of what the closing of a text shows."""
    text = unicodedata.normalize("NFC", tail).rstrip().lower()
    length = min(len(text) - 1 - max(text.rfind(" "), text.rfind("\n")), 48) // 8
    text = _NUMBER.sub("9", _HEX.sub(lambda m: f"<h{len(m[0])}>", text))
    line = text.rpartition("\n")[2]
    words = text.split()[-4:] or [""]
    bare = [w.strip(".,;:!?()[]\"'“”’") for w in words]
    plain = [_folded(w) for w in bare]
    kinds = "".join(_kind(c) for c in text[-3:])
    last = kinds[-1:]
    s = source
    names = [
        "b", f"s|{s}", f"k1|{last}", f"k1s|{last}|{s}", f"k2|{kinds[-2:]}", f"k3|{kinds}|{s}", f"c1|{text[-1:]}", f"c2|{text[-2:]}", f"c3|{text[-3:]}", f"c5|{text[-5:]}",
        f"w1|{words[-1]}", f"w1s|{words[-1]}|{s}", f"w2|{' '.join(words[-2:])}", f"w3|{' '.join(words[-3:])}", f"w4|{' '.join(words[-4:])}",
        f"v1|{bare[-1]}", f"v2|{' '.join(bare[-2:])}", f"v3|{' '.join(bare[-3:])}",
        f"f1|{plain[-1]}|{last}", f"f2|{' '.join(plain[-2:])}|{last}", f"f3|{' '.join(plain[-3:])}|{last}",
        f"n|{min(len(line.split()), 6)}|{last}", f"o|{opened}|{last}", f"lim|{limits}", f"limk|{limits}|{last}", f"lims|{limits}|{s}", f"g|{length}|{last}",
    ]
    signed = re.split(r"(?:^|\s)[–—-]\s", line)
    names.append(f"d|{min(len(signed[-1].split()), 6) if len(signed) > 1 else -1}|{s}")
    if len(line) <= 40:
        names.append(f"l|{line}")
        names.append(f"ls|{line}|{s}")
    return array("i", [zlib.crc32(n.encode("utf-8", "replace")) & ((1 << BITS) - 1) for n in names])


def _matrix(rows: list[array]) -> np.ndarray:
    """One row of hashes each, filled up with the index whose weight is always 0."""
    out = np.full((len(rows), WIDTH), 1 << BITS, dtype=np.int32)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 10, rate: float = 0.15, decay: float = 1e-6, seed: int = 7) -> np.ndarray:
    """Weights of a logistic regression on hashed features, by Adagrad; the last is always 0."""
    size = (1 << BITS) + 1
    weights, squares = np.zeros(size), np.full(size, 1e-6)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        turn = order.permutation(len(y))
        for at in range(0, len(turn), 2048):
            rows = turn[at : at + 2048]
            cells = x[rows]
            p = 1 / (1 + np.exp(-np.clip(weights[cells].sum(axis=1), -30, 30)))
            slope = np.bincount(cells.ravel(), np.repeat(p - y[rows], cells.shape[1]), minlength=size) / len(rows) + decay * weights
            squares += slope * slope
            weights -= rate * slope / np.sqrt(squares)
            weights[-1] = 0
    return weights.astype(np.float32)


def probabilities(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(weights[x].sum(axis=1), -30, 30)))


def length_limits(texts: DataFrame, least: int = 4, times: float = 6.0, near: int = 20) -> DataFrame:
    """(source, unit, size): lengths at which texts of a source are cut.

    `texts` has (source, chars, bytes). A limit has at least `least` texts and `times`
    as many as the lengths up to `near` away have on average, by counts over all texts.
    """
    each = texts.select("source", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("size")))).alias("s"))
    counts = each.groupBy("source", "s.unit", "s.size").agg(F.count("*").alias("n"))
    around = W.partitionBy("source", "unit").orderBy("size").rangeBetween(-near, near)
    rest = (F.sum("n").over(around) - F.col("n")) / (2.0 * near)
    every = W.partitionBy("source", "unit")
    longer = F.sum("n").over(every.orderBy(F.desc("size"))) - F.col("n")
    counts = counts.withColumn("rest", rest).withColumn("longer", longer).withColumn("all", F.sum("n").over(every))
    return counts.filter((F.col("longer") <= F.col("all") / 2) & (F.col("n") >= least) & (F.col("n") >= times * F.greatest(F.col("rest"), F.lit(0.25)))).select("source", "unit", "size")


def _opened(text: Column) -> Column:
    """Whether more brackets open than close."""
    return F.length(F.translate(text, "([", "")) < F.length(F.translate(text, ")]", ""))


def _examples(rows: list, often: set[int], seed: int) -> tuple[list, list[int], list[int], list[float]]:
    """Features, answers, folds and doubts: each sampled text as it is, and cut at up to two places.

    A few copies of a text share a fold, so that none vouches for another, and so do any
    number at a limit; else an ending with many copies among all texts (its hash is in
    `often`) is how texts end, and is spread over all folds.
    """
    random = np.random.default_rng(seed)
    x, y, group, doubt = [], [], [], []
    seen = Counter(row.tail for row in rows)
    for row in rows:
        x.append(features(row.tail, row.source or "", row.limits, row.opened))
        y.append(0)
        doubt.append(DOUBT_AT_LIMIT if row.limits else DOUBT)
        seen[row.tail] -= 1
        group.append((zlib.crc32(row.tail.encode("utf-8", "replace")) + (seen[row.tail] if row.code in often and not row.limits else 0)) % FOLDS)
        for cut in row.cuts:
            head, after = cut.head, cut.after
            closed = head.rstrip()
            if not closed or (closed[-1] in ".!?" and (head != closed or not after or after[0].isspace())) or after[:1] in ("", "\n", "\r", ".", "!", "?"):
                continue
            at_limit = bool(random.random() < 0.5)
            mark = MARKS[random.integers(len(MARKS))] if not at_limit and random.random() < 0.5 else ""
            x.append(features(head + mark, row.source or "", int(random.integers(1, 4)) if at_limit else 0, cut.opened))
            y.append(1)
            doubt.append(1.0)
            group.append(group[-1])
    return x, y, group, doubt


def fair_level(counts: list[tuple[int, int]], sample: int, per_source: int) -> int:
    """The most texts of one source such that no more than `sample` are taken in all; `counts` has (texts, sources with so many)."""
    low, high = 1, max(1, per_source)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if sum(min(n, middle) * k for n, k in counts) <= sample else (low, middle - 1)
    return low


def sampled(texts: DataFrame, sample: int, per_source: int, seed: int, columns: list | None = None) -> DataFrame:
    """Up to `sample` texts, up to `per_source` of a source and as many of each as of any other; those with the least hashes.

    Counts of all sources tell which hashes can be among the least, with a margin of six
    deviations. Only texts near the sample get the `columns` (by default all of `texts`)
    and are ranked; none is moved before.
    """
    counts = cut_lineage(texts.groupBy("source").agg(F.count("*").alias("of_source")))
    spread = [(r.of_source, r.k) for r in counts.groupBy("of_source").agg(F.count("*").alias("k")).collect()]
    level, total = fair_level(spread, sample, per_source), sum(n * k for n, k in spread)
    columns = columns or [c for c in texts.columns if c not in ("id", "source")]
    keyed = texts.withColumn("key", F.xxhash64("id", F.lit(seed)))
    few = counts.count() <= BROADCAST_LIMITS
    rows = keyed.join(F.broadcast(counts), "source") if few else keyed.select("id", "source", "key", *columns).join(counts, "source")
    below = F.lit(level + 6 * level**0.5 + 12) / F.col("of_source") * F.lit(2.0**64) - F.lit(2.0**63)
    near = rows.filter(F.col("key").cast("double") <= below)
    near = near.select("id", "source", "key", *columns) if few else near.drop("of_source")
    ranked = near.withColumn("place", F.row_number().over(W.partitionBy("source").orderBy("key", "id"))).filter(F.col("place") <= per_source)
    return ranked.orderBy("place", "key", "id").limit(sample).withColumn("of_all", F.lit(total).cast("long"))


def many_copies(texts: DataFrame, rows: list, sample: int) -> set[int]:
    """Hashes of the sample's endings that many of all texts have, those at a limit left out.

    The endings of the sample are broadcast, and their copies counted over all texts.
    """
    lengths = {row.code: len(row.tail) for row in rows}
    codes = texts.sparkSession.createDataFrame([(c,) for c in lengths], "code long")
    counts = texts.filter("limits = 0").select(F.xxhash64("tail").alias("code")).join(F.broadcast(codes), "code").groupBy("code").agg(F.count("*").alias("n")).collect()
    share = max(1.0, rows[0].of_all / sample)
    return {r.code for r in counts if r.n >= share * (SHORT_COPIES if lengths[r.code] <= SHORT else COPIES)}


def train(texts: DataFrame, sample: int = SAMPLE, per_source: int = PER_SOURCE, seed: int = 7) -> np.ndarray:
    """Weights from a bounded sample of `texts` (id, source, text, tail, limits, opened)."""
    cuts = []
    for turn in range(2):
        place = F.pmod(F.xxhash64("id", F.lit(seed + 1 + turn)), F.greatest(F.length("text") - 1, F.lit(1))).cast("int") + 1
        head = F.col("text").substr(F.lit(1), place)
        cuts.append(F.struct(F.substring(head, F.greatest(place - TAIL, F.lit(0)) + 1, F.lit(TAIL)).alias("head"), F.col("text").substr(place + 1, F.lit(2)).alias("after"), _opened(head).alias("opened")))
    chosen = sampled(texts, sample, per_source, seed, ["tail", "limits", "opened", F.xxhash64("tail").alias("code"), F.array(*cuts).alias("cuts")])
    rows = chosen.select("source", "tail", "limits", "opened", "code", "of_all", "cuts").collect()
    if not rows:
        return np.zeros((1 << BITS) + 1, dtype=np.float32)
    x, y, fold, doubt = _examples(rows, many_copies(texts, rows, sample), seed)
    del rows
    x, y, fold, doubt = _matrix(x), np.array(y, dtype=np.float64), np.array(fold), np.array(doubt)
    kept = np.ones(len(y), dtype=bool)
    for _ in range(ROUNDS):
        p = np.zeros(len(y))
        for k in range(FOLDS):
            p[fold == k] = probabilities(x[fold == k], fit(x[kept & (fold != k)], y[kept & (fold != k)]))
        kept = (y == 1) | (p < doubt)
    return fit(x[kept], y[kept])


def _scored(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        x = [features(t, s or "", m, o) for t, s, m, o in zip(*(columns[c].to_pylist() for c in ("tail", "source", "limits", "opened")), strict=True)]
        p = probabilities(_matrix(x), weights) if x else np.zeros(0)
        yield pa.RecordBatch.from_arrays([columns["id"], columns["source"], pa.array(columns["limits"].to_numpy(zero_copy_only=False) > 0), pa.array(p.astype(np.float64))], ["id", "source", "at_limit", "p"])


def cut_texts(docs: DataFrame, number: str, text: str, source: str, threshold: float = THRESHOLD, sample: int = SAMPLE, per_source: int = PER_SOURCE) -> DataFrame:
    """(number, source, at_limit, p, cut) of every text that is not blank."""
    rows = docs.select(F.col(number).alias("id"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.make_valid_utf8(F.col(text)).alias("text"))
    rows = rows.withColumn("closed", F.rtrim("text", F.lit(_BLANKS))).filter(F.length("closed") > 0)
    rows = rows.select("id", "source", "text", "closed", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"))
    limits = cut_lineage(length_limits(rows))
    known = limits.groupBy("source").agg(F.collect_list(F.when(F.col("unit") == "chars", F.col("size"))).alias("lc"), F.collect_list(F.when(F.col("unit") == "bytes", F.col("size"))).alias("lb"))
    if limits.count() <= BROADCAST_LIMITS:
        known = F.broadcast(known)
    met = rows.join(known, "source", "left")
    in_chars = F.coalesce(F.array_contains("lc", F.col("chars")), F.lit(False)).cast("int")
    in_bytes = F.coalesce(F.exists("lb", lambda b: (F.col("bytes") <= b) & (F.col("bytes") > b - 4)), F.lit(False)).cast("int")
    ready = met.select("id", "source", "text", F.substring("closed", -TAIL, TAIL).alias("tail"), (in_chars + 2 * in_bytes).alias("limits"), _opened(F.col("closed")).alias("opened"))
    weights = docs.sparkSession.sparkContext.broadcast(train(ready, sample, per_source))
    kind = dict(docs.dtypes)[number]
    scored = ready.select("id", "source", "tail", "limits", "opened").mapInArrow(lambda b: _scored(b, weights.value), f"id {kind}, source string, at_limit boolean, p double")
    return scored.select(F.col("id").alias(number), F.col("source").alias(source), "at_limit", "p", (F.col("p") >= threshold).alias("cut"))
