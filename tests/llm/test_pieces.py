"""SentencePiece encoding and decoding against the sentencepiece library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from playtrail.llm import pieces, queries
from tests.llm.helpers import DOCS, SF, odd_documents, sorted_rows

PIECES = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def plain(docs):
    rows = []
    for d, text in docs:
        ids = PIECES.encode(text or "", add_eos=True)
        back = PIECES.decode(ids)
        rows.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    return sorted(rows, key=lambda r: tuple((v is not None, v) for v in r))


def encoded(texts):
    return [np.frombuffer(b, "<i4").tolist() for b in pieces.piece_model(pieces.public_model()).encode(texts)]


def test_piece_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted_rows(queries.QUERIES["op11_piece_round_trip"](spark, SF)) == plain(docs)


def test_pieces_of_odd_rows(spark):
    docs = spark.createDataFrame(odd_documents(), DOCS).withColumn("ids", F.lit("x")).withColumn("decoded", F.lit(None).cast("string"))
    got, ids = pieces.encode_documents(docs)
    assert ids == "ids_" and got.columns == ["doc_id", "lang", "source", "n_chars", "ids", "decoded", "ids_"]
    back, text = pieces.decode_documents(got, ids)
    assert text == "decoded_"
    want = sorted((tuple(PIECES.encode(r[1] or "", add_eos=True)), r[1] or "") for r in odd_documents())
    # U+2581 aside, decoding gives the text back.
    assert sorted((tuple(r[ids]), r[text]) for r in back.collect()) == want
    assert pieces.encode_documents(docs.limit(0))[0].count() == 0
    bare = pieces.encode_documents(docs, end=False, keep=[])[0].agg(F.sum(F.size("ids_"))).scalar()
    assert bare is not None
    assert got.agg(F.sum(F.size("ids_"))).collect()[0][0] == sum(len(w[0]) for w in want)


def test_decoding_null_ids(spark):
    df = spark.createDataFrame([(1, [264, 287]), (2, None), (3, [])], "k int, ids array<int>")
    assert sorted_rows(pieces.decode_documents(df)[0].select("k", "decoded")) == [(1, PIECES.decode([264, 287])), (2, None), (3, "")]


@pytest.mark.parametrize("seed", range(6))
def test_rounds_equal_the_library(seed):
    """Letters, spaces and marks that tie, runs of spaces around the longest piece, and pieces put together at random."""
    rng = random.Random(seed)
    alphabets = ["abcdefghij ", "the and of ing tion re", "▁ ab", "日本語中文字🙂é ", "0123456789.,", "\x00\n\t ax", "aA ", "▁", "abc"]
    known = [PIECES.id_to_piece(i) for i in range(len(PIECES))]
    texts = ["", " ", *[" " * n + tail for n in (1, 2, 15, 16, 17, 31, 32, 33, 48, 49, 100) for tail in ("", "the", "日", "\n", "\x00")]]
    texts += ["x" + t for t in texts] + ["a" * 1000, "the" * 500, "<s> </s> <unk> <0x41>", "é" * 300]
    for i in range(600):
        some = rng.choice(alphabets)
        texts.append("".join(rng.choices(some, k=rng.choice([1, 3, 10, 63, 64, 65, 200, 500]))))
        text = "".join(rng.choices(known, k=rng.choice([2, 5, 20, 60])))
        texts.append(text.replace("▁", " ") if i % 2 else text)
    for t, got in zip(texts, encoded(texts), strict=True):
        assert got == PIECES.encode(t), t


def test_long_words_equal_the_library():
    rng = random.Random(7)
    texts = ["".join(rng.choices(some, k=60_000)) for some in ("abcdefghijklmnopqrstuvwxyz", "ab", "日本語中文字漢", " a", "the", " ")]
    for t, got in zip(texts, encoded(texts), strict=True):
        assert got == PIECES.encode(t)


def test_decoding_any_ids():
    rng = random.Random(3)
    model = pieces.piece_model(pieces.public_model())
    for _ in range(3000):
        ids = [rng.choice([0, 1, 2, 28705, 259, rng.randrange(3, 259), rng.randrange(len(PIECES))]) for _ in range(rng.randrange(9))]
        assert model.decode(ids) == PIECES.decode(ids), ids


def test_memory_of_words_is_bounded():
    model = pieces.PieceModel(pieces.public_model(), remembered=50)
    rng = random.Random(5)
    for _ in range(30):
        texts = [" ".join("".join(rng.choices("abcdef", k=6)) for _ in range(40)) + "\n  two" for _ in range(3)]
        assert [np.frombuffer(b, "<i4").tolist() for b in model.encode(texts)] == PIECES.encode(texts)
        assert len(model.spaced) + len(model.others) <= 50


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(PIECES.serialized_model_proto())
    proto.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m").write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError):
        pieces.PieceModel(str(tmp_path / "m"))
