"""Token ids of whole texts by a public byte-level vocabulary, long texts in pieces.

A long text is cut into overlapping chunks that are pre-tokenised in parallel. A chunk
may start in the middle of a pre-token, but from the first boundary that it has in
common with the chunk before it, both go on alike; there the text is cut for good, and
the pieces are encoded independently. Merges never cross pre-token boundaries, so the
ids are those of the whole text, and decoding joins raw bytes.

Defined cases: null and empty texts have an empty list; blanks are text and have ids;
bytes that are not UTF-8 count as U+FFFD; strings that look like special tokens are
ordinary text. A text whose chunks share no boundary within an overlap (such as a
pre-token longer than that) is encoded in one piece, so the result is always exact.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.session import cut_lineage

#: Folder of the public vocabulary files; the same on every machine.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The published pre-token pattern of that vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a chunk and of the overlap with the next one.
CHUNK, OVERLAP = 1 << 16, 1 << 11
#: Boundaries this close to the end of a chunk may depend on what follows.
MARGIN = 4
#: Ends of up to so many chunks (some 40 bytes each) are broadcast; beyond it they are joined by shuffle.
BROADCAST_CHUNKS = 200_000
#: Texts handed to the encoder at once.
BATCH = 512


@lru_cache(maxsize=4)
def encoding(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    """The encoder, made once in each worker."""
    import tiktoken

    with open(f"{folder}/{vocabulary}", "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("tessella", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _pattern():
    import regex

    return regex.compile(PATTERN)


def boundaries(text: str) -> list[int]:
    """Ends of the pre-tokens of a text."""
    return [m.end() for m in _pattern().finditer(text)]


def decode(ids: list[int], folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> str:
    """The text of ids, by joining the tokens' bytes."""
    return encoding(folder, vocabulary).decode_bytes(list(ids)).decode("utf-8", errors="replace")


def _encoded(batches: Iterator[pa.RecordBatch], keep: list[str], folder: str, vocabulary: str, count: bool) -> Iterator[pa.RecordBatch]:
    coder = encoding(folder, vocabulary)
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH):
            batch = whole.slice(at, BATCH)
            texts = [t or "" for t in batch.column(batch.schema.get_field_index("__text")).to_pylist()]
            lists = coder.encode_ordinary_batch(texts, num_threads=1)
            lengths = np.fromiter(map(len, lists), dtype=np.int32, count=len(lists))
            if count:
                out = pa.array(lengths)
            else:
                flat = np.fromiter((i for ids in lists for i in ids), dtype=np.int32, count=int(lengths.sum()))
                out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(k)) for k in keep], out], [*keep, "ids"])


def _chunked(batches: Iterator[pa.RecordBatch], chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for k, start in enumerate(range(0, max(1, len(text) - overlap), chunk)):
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([k], pa.int32()), pa.array([text[start : start + chunk + overlap]], pa.string()), pa.array([start + chunk + overlap >= len(text)])], ["__id", "k", "piece", "final"])


def _marked(batches: Iterator[pa.RecordBatch], chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        numbers, ks, heads, tails = [], [], [], []
        for number, k, piece in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            ends = [b for b in boundaries(piece) if b <= len(piece) - MARGIN]
            numbers.append(number)
            ks.append(k)
            heads.append([b + k * chunk for b in ends if b < overlap])
            tails.append([b + k * chunk for b in ends if b >= chunk])
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(ks, pa.int32()), pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], ["__id", "k", "head", "tail"])


def encode(docs: DataFrame, number: str, text: str, keep: list[str] | None = None, count: bool = False, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(number, *keep, ids) of each document, or its number of tokens as n_tokens.

    `number` must be unique. Texts of up to chunk + overlap characters are encoded where
    they lie, without a shuffle; only longer ones are cut and spread. A first scan of the
    lengths tells whether there are any, which spares the others half a dozen scans.
    """
    if chunk < overlap + MARGIN or overlap <= MARGIN:
        raise ValueError("chunks must be longer than their overlap, and that longer than the margin")
    kept = [number, *(keep or [])]
    kinds = {f.name: f.dataType for f in docs.schema}
    rows = docs.select(*[F.col(k) for k in kept], F.make_valid_utf8(F.col(text)).alias("__text"))
    result = T.IntegerType() if count else T.ArrayType(T.IntegerType())
    schema = T.StructType([*[T.StructField(k, kinds[k]) for k in kept], T.StructField("ids", result)])
    long = F.length("__text") > chunk + overlap
    plain = rows.filter(~F.coalesce(long, F.lit(False))).mapInArrow(lambda b: _encoded(b, kept, folder, vocabulary, count), schema)

    texts = rows.filter(long)
    if texts.isEmpty():
        return plain.withColumnRenamed("ids", "n_tokens") if count else plain
    source = texts.select(F.col(number).cast("long").alias("__id"), F.col("__text"))
    chunks = source.mapInArrow(lambda b: _chunked(b, chunk, overlap), "__id long, k int, piece string, final boolean").repartition("__id", "k")
    chunks = cut_lineage(chunks)
    marks = cut_lineage(chunks.select("__id", "k", "piece").mapInArrow(lambda b: _marked(b, chunk, overlap), "__id long, k int, head array<long>, tail array<long>"))
    before = marks.select("__id", (F.col("k") + 1).alias("k"), "tail")
    cuts = marks.select("__id", "k", "head").filter("k > 0").join(before, ["__id", "k"], "left").select("__id", "k", F.array_min(F.array_intersect("head", F.coalesce("tail", F.array().cast("array<long>")))).alias("cut"))
    cuts = cut_lineage(cuts)
    stuck = cuts.filter("cut IS NULL").select("__id").distinct()
    none = F.lit(None).cast("long")
    ends = cuts.select("__id", "k", "cut", none.alias("upto")).unionByName(cuts.select("__id", (F.col("k") - 1).alias("k"), none.alias("cut"), F.col("cut").alias("upto")))
    ends = ends.groupBy("__id", "k").agg(F.max("cut").alias("cut"), F.max("upto").alias("upto")).join(stuck, "__id", "left_anti")
    few = chunks.count() <= BROADCAST_CHUNKS
    placed = chunks.join(F.broadcast(ends) if few else ends, ["__id", "k"])  # a long text has two chunks at least, so each has an end
    start = F.coalesce("cut", F.lit(0)) - F.col("k") * chunk
    stop = F.coalesce(F.col("upto") - F.col("k") * chunk, F.length("piece").cast("long"))
    pieces = placed.select("__id", "k", F.col("piece").substr((start + 1).cast("int"), (stop - start).cast("int")).alias("__text"))
    coded = pieces.mapInArrow(lambda b: _encoded(b, ["__id", "k"], folder, vocabulary, count), T.StructType([T.StructField("__id", T.LongType()), T.StructField("k", T.IntegerType()), T.StructField("ids", result)]))
    joined = F.sum("ids").cast("int") if count else F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "ids"))), lambda s: s["ids"]))
    whole = coded.groupBy("__id").agg(joined.alias("ids"))
    stitched = texts.select(*kept).join(whole, F.col(number).cast("long") == F.col("__id")).select(*kept, "ids")
    rest = texts.join(stuck, F.col(number).cast("long") == F.col("__id"), "left_semi").mapInArrow(lambda b: _encoded(b, kept, folder, vocabulary, count), schema)
    out = plain.unionByName(stitched).unionByName(rest)
    return out.withColumnRenamed("ids", "n_tokens") if count else out
