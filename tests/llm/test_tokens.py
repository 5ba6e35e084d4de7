import random

import pytest
from pyspark.sql import functions as F

from tessella.llm.mixing import emitted, mix_rates
from tessella.llm.text_queries import p8_joined
from tessella.llm.tokens import CHUNK, TOKENIZERS, boundaries, decode, encode, encoding

PIECES = ["mô đệm ", "tuyến\n", "  ", "\t\n ", "I've ", "don't", "'s", "12345", " 3.5", "ng/ml.", "🔬🔬", "é", "ééé", "<|endoftext|>", "    ", "aaaaaaaaaaaaaaaaaaaaaaaa", "!?!?", "​", "漢字", " "]


def texts(seed, n):
    draw = random.Random(seed)
    return [None, "", " ", "\r\n", "x"] + ["".join(draw.choices(PIECES, k=draw.randint(1, 60))) for _ in range(n)]


def frame(spark, values):
    return spark.createDataFrame([(i, v, "s", 7, "q") for i, v in enumerate(values)], "no long, body string, source string, ids int, piece string")


@pytest.mark.parametrize("chunk,overlap", [(1 << 16, 1 << 11), (40, 20), (25, 8), (64, 60)])
def test_pieces_give_the_ids_of_the_whole(spark, chunk, overlap):
    values = texts(chunk, 120) + ["a" * 900, "x" * 50 + " " * 500 + "y", "word " * 300]
    want = {i: encoding().encode_ordinary(v or "") for i, v in enumerate(values)}
    got = {r.no: list(r.ids) for r in encode(frame(spark, values), "no", "body", chunk=chunk, overlap=overlap).collect()}
    assert got == want
    counts = {r.no: r.n_tokens for r in encode(frame(spark, values), "no", "body", ["source"], count=True, chunk=chunk, overlap=overlap).collect()}
    assert counts == {i: len(v) for i, v in want.items()}


def test_another_library_agrees_and_decoding_restores():
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    for text in texts(9, 200)[1:]:
        ids = encoding().encode_ordinary(text)
        assert other.encode(text, add_special_tokens=False).ids == ids and decode(ids) == text


def test_boundaries_cover_the_text():
    for text in texts(3, 50)[1:]:
        assert boundaries(text)[-1:] == ([len(text)] if text else [])


def test_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: encoding().encode_ordinary(r.text or "") for r in docs.collect()}
    assert {r.doc_id: list(r.ids) for r in encode(docs, "doc_id", "text").collect()} == want
    assert {r.doc_id: list(r.ids) for r in encode(docs, "doc_id", "text", chunk=64, overlap=32).collect()} == want


def test_joined_documents_go_through_chunks(spark):
    """Blocks of the real documents are longer than a chunk, so they are cut, stitched and joined."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    got = {r.block: list(r.ids) for r in p8_joined(spark, "/root/testdata/sf0.01").collect()}
    for block, ids in got.items():
        text = "\n".join(docs[i] for i in sorted(docs) if i // 1024 == block)
        assert len(text) > 2 * CHUNK and encoding().encode_ordinary(text) == ids


def test_chunks_must_exceed_the_overlap(spark):
    with pytest.raises(ValueError):
        encode(frame(spark, ["x"]), "no", "body", chunk=10, overlap=20)


def test_mixing_rates_and_copies(spark):
    sizes = spark.createDataFrame([(i, "big", 10) for i in range(900)] + [(1000 + i, "small", 10) for i in range(50)] + [(2000, "none", 0)], "no long, source string, n_tokens int")
    goals = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("none", 0.05, 2), ("absent", 0.05, 4)], "source string, target_weight double, max_repeats int")
    rates = {r.source: r for r in mix_rates(sizes, goals).collect()}
    assert rates["big"].tokens == 9000 and rates["big"].rate == pytest.approx(4750 / 9000) and not rates["big"].short
    assert rates["small"].rate == 3.0 and rates["small"].short and rates["none"].short and rates["absent"].n_docs == 0
    used = emitted(sizes, mix_rates(sizes, goals), "no")
    assert {r.copies for r in used.filter("source = 'small'").collect()} == {3}
    assert abs(used.filter("source = 'big'").count() - 475) < 60 and {r.copies for r in used.filter("source = 'big'").collect()} == {1}
    assert used.exceptAll(emitted(sizes.repartition(5), mix_rates(sizes, goals), "no")).isEmpty()


def test_a_source_that_just_suffices_is_not_short(spark):
    sizes = spark.createDataFrame([(1, "a", 1), (2, "b", 9)], "no long, source string, n_tokens int")
    goals = spark.createDataFrame([("a", 0.3, 3), ("b", 0.7, 1)], "source string, target_weight double, max_repeats int")
    assert not any(r.short for r in mix_rates(sizes, goals).collect())
