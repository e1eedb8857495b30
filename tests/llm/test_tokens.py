"""Byte-level BPE and token-id files against the libraries and exact round trips."""

import hashlib
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessellar.llm import bpe, queries, token_files

RANKS, LIBRARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["'", "s", "t", "re", "ve", "m", "ll", "d", " ", "  ", "\n", "\t", "a", "é", "Z", "1", "٣", "!", " ", "　", "don't", "😀", "\x1c", "\r\n", "'re", "''", "_", "中"]
SCHEMA = "doc_id long, text string, ids string, offsets string, part string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)


def odd_texts(n, seed=6):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(ODD, rng.integers(0, 14))) for _ in range(n)] + ["a" * 5000, " " * 900 + "x", "'" * 300, "", "\0", "a\0b"]


def of_tiktoken(v):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})


def test_boundaries_and_ids_are_the_librarys():
    v = bpe.Vocabulary(RANKS)
    library, texts = of_tiktoken(v), odd_texts(3000)
    for text, ids in zip(texts, v.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text) and v.decode(ids) == text.encode()
        assert v.token_offsets(ids)[-1] == len(text.encode())


def test_classes_of_all_code_points():
    kinds = bpe._classes()
    for c in range(0, 0x110000, 7):
        assert (kinds[c] == bpe.LETTER) == (unicodedata.category(chr(c))[0] == "L") and (kinds[c] == bpe.NUMBER) == (unicodedata.category(chr(c))[0] == "N")
    assert not any(unicodedata.category(chr(c))[0] in "LNZ" for c in range(0x40000, 0x110000))


def test_merges_are_the_librarys():
    v = bpe.Vocabulary(RANKS)
    library, rng = tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=v.ranks, special_tokens={}), np.random.default_rng(3)
    pieces = list({"".join(rng.choice(list(" aabcdeehinorstué中"), rng.integers(1, 30))).encode() for _ in range(2000)})
    ids, sizes = v.merge(pieces)
    for piece, own in zip(pieces, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
        assert own.tolist() == library.encode_ordinary(piece.decode())


def test_pieces_of_equal_hash_and_a_full_cache(monkeypatch):
    v, texts = bpe.Vocabulary(RANKS), [f" wordnumber{i} other{i}" for i in range(200)]
    want = v.encode(texts)
    monkeypatch.setattr(bpe, "mixed", lambda x: x & np.uint64(3))  # nearly all pieces clash
    clashing = bpe.Vocabulary(RANKS)
    assert clashing.encode(texts) == want == clashing.encode(texts)
    monkeypatch.setattr(bpe, "CACHED", 5)
    assert [bpe.Vocabulary(RANKS).encode([t])[0] for t in texts] == want


def test_encode_and_decode(spark):
    coded = bpe.encode(docs(spark, [(1, "naïve 中 text"), (2, None), (3, "")]), RANKS, offsets=True)
    assert {r["doc_id"]: r["text"] for r in bpe.decode(coded, RANKS).collect()} == {1: "naïve 中 text", 2: "", 3: ""}
    assert {r["doc_id"]: r["text"] for r in bpe.decode(coded.drop("offsets"), RANKS).collect()} == {1: "naïve 中 text", 2: "", 3: ""}


@pytest.mark.parametrize("rows", [[], [(1, "it's 中 a text"), (1, "it's 中 a text"), (1, "other"), (None, "no id"), (2, None), (3, ""), (4, "word " * 60_000)]])
def test_queries_by_the_libraries(spark, tmp_path, rows):
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    library, packed = of_tiktoken(bpe.vocabulary(RANKS)), lambda ids: np.array(ids, "<u4").tobytes()
    want = [(i, len(e := library.encode_ordinary(t or "")), hashlib.sha256(packed(e)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows]
    assert sorted(map(tuple, queries.op5_byte_bpe(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)

    other, got = Tokenizer.from_file(LIBRARY), queries.op6_token_files(spark, str(tmp_path)).collect()
    coded = [(i, len(e := [*other.encode(t or "", add_special_tokens=False).ids, 0]), zlib.crc32(packed(e))) for i, t in rows]
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=str) == sorted(coded, key=str)
    in_order = sorted(got, key=lambda r: (r["start"], r["n_tokens"]))
    assert [r["start"] for r in in_order] == [0, *np.cumsum([r["n_tokens"] for r in in_order])][: len(got)]
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in in_order]
    assert ids == sorted(ids)


@pytest.mark.parametrize("n", [0, 1, 7, 511, 513, 30_000, 270_000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    x = np.minimum(rng.zipf(1.3, n) - 1, 50256)
    x = np.where(rng.random(n) < 0.3, np.roll(x, 3), x)
    blocks = token_files.compress(x, 50257)
    assert (token_files.expand(blocks, n, 50257) == x).all()


def test_blocks_are_read_alone():
    n = 3 * token_files.STRIPES * token_files.STEPS
    x = np.random.default_rng(1).integers(0, 900, n)
    blocks = token_files.compress(x, 900)
    assert len(blocks) == 3
    assert (token_files.expand(blocks[1:2], n // 3, 900) == x[n // 3 : 2 * n // 3]).all()


def test_large_vocabularies_and_carries():
    rng = np.random.default_rng(2)
    for x, size in ((rng.integers(0, 300_000, 20_000), 300_001), (np.zeros(200_000, int), 50_257), (np.arange(70_000) % 70_000, 70_000)):
        assert (token_files.expand(token_files.compress(x, size), len(x), size) == x).all()


def test_each_order_predicts():
    """Ids drawn unevenly, pairs and triples that recur: fewer bits than the order below could reach."""
    rng = np.random.default_rng(4)
    bits = lambda x: 8 * sum(map(len, token_files.compress(x, 50_257))) / len(x)
    uneven = rng.choice(50_257, 400, replace=False)[np.minimum(rng.zipf(1.5, 260_000) - 1, 399)]
    assert bits(uneven) < 8 < np.log2(50_257)
    after = rng.permutation(50_257)
    x = rng.integers(0, 1000, 130_000)
    assert bits(np.stack([x, after[x]], 1).ravel()) < 0.75 * bits(rng.integers(0, 1000, 260_000))
    y = rng.integers(0, 30, 90_000)
    triples = np.stack([y, np.roll(y, 7), after[y * 30 + np.roll(y, 7)]], 1).ravel()
    assert bits(triples) < 8


def test_token_files(spark, tmp_path):
    rows = [(5, "hello there"), (2, None), (9, "é <|endoftext|> 中"), (1, ""), (7, "x" * 3000)]
    token_files.write(docs(spark, rows), str(tmp_path / "f"), LIBRARY)
    library, start = Tokenizer.from_file(LIBRARY), 0
    got = {r["doc_id"]: r for r in token_files.read(spark, str(tmp_path / "f")).collect()}
    for i, text in sorted(rows):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        assert (got[i]["start"], np.frombuffer(got[i]["ids"], "<u4").tolist()) == (start, ids)
        start += len(ids)
    token_files.remove(spark, str(tmp_path / "f"))
    assert not (tmp_path / "f").exists()


def test_a_damaged_block_is_an_error(spark, tmp_path):
    token_files.write(docs(spark, [(i, f"some text {i}") for i in range(50)]), str(tmp_path / "f"), LIBRARY)
    spoilt = F.concat(F.expr("substring(payload, 1, octet_length(payload) - 4)"), F.expr("unhex('0BADBEEF')"))
    spark.read.parquet(str(tmp_path / "f")).withColumn("payload", spoilt).write.parquet(str(tmp_path / "g"))
    with pytest.raises(Exception, match="is damaged"):
        token_files.read(spark, str(tmp_path / "g")).collect()
