"""Token alignment against the libraries and a plain loop over links."""

import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
import tokenizers

from tessellar.llm import alignment

A, B = P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, chunk long, slot int, part int, n_best long, lists string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, "l") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def libraries():
    a = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def to_bytes():
    """The byte of each sign of the byte-level alphabet."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, more = {chr(b): b for b in plain}, 256
    for b in range(256):
        if b not in plain:
            table[chr(more)] = b
            more += 1
    return table


def brute(libraries, rows):
    a, b = libraries
    table = to_bytes()
    out, count = [], Counter()
    for i, t in rows:
        line = (" " + t).encode() if t else b""
        ids_a = a.encode(" " + t, add_special_tokens=False) if t else None
        tokens_a = [(x, bytes(table[c] for c in s)) for x, s in zip(ids_a.ids, ids_a.tokens)] if t else []
        piece = lambda x: bytes([int(b.id_to_piece(x)[3:-1], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode()
        tokens_b = [(x, piece(x)) for x in b.encode(t)] if t else []
        if b"".join(x[1] for x in tokens_a) != line or b"".join(x[1] for x in tokens_b) != line:
            tokens_a = tokens_b = []
        spans = []
        for tokens in (tokens_a, tokens_b):
            at, of = 0, []
            for x, data in tokens:
                of.append((x, at, at + len(data)))
                at += len(data)
            spans.append(of)
        links, j = [], 0
        for x, s, e in spans[0]:
            while j and spans[1][j][1] > s:
                j -= 1
            while spans[1][j][2] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][1] < e:
                links.append((x, spans[1][k][0]))
                k += 1
        cuts = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups, lo, pa, pb = [], 0, 0, 0
        for hi in cuts:
            xs, ys = [], []
            while pa < len(spans[0]) and spans[0][pa][2] <= hi:
                xs.append(str(spans[0][pa][0]))
                pa += 1
            while pb < len(spans[1]) and spans[1][pb][2] <= hi:
                ys.append(str(spans[1][pb][0]))
                pb += 1
            groups.append(",".join(xs) + "|" + ",".join(ys))
            lo = hi
        count.update(links)
        out.append((i, len(tokens_a), len(tokens_b), len(groups), links, ";".join(groups)))
    best = Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    digest = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    return sorted(((i, na, nb, ng, len(ls), sum(count[x] == best[x[1]] for x in ls), sum(count[x] for x in ls), digest(g)) for i, na, nb, ng, ls, g in out), key=str)


def found(spark, rows):
    return sorted((tuple(r) for r in alignment.align(docs(spark, rows), A, B).collect()), key=str)


ODD = [None, "", " ", "  ", "   x", "a ", "a  b", "a\nb", "a\n\n b", " \n x", "x \n", "\n", "\t\tx y", "a\r\nb c\r", "one;\r two", "nb\xa0sp \xa0 x", "wide　space", "mark▁in", "é ﬁ ① 漢字 かな", "🙂🙂 x", "a\x00b", "\x1c, \x1d x", "<s> <0x41> </s> <unk>", "<|endoftext|> x<|endoftext|>", "don't we'll I'D", "x" * 300, "1234567 89", "Ünï cödé, тест; ½", "  two  spaces   three    four", "tab\tand space\t ", "a.b,c!d?e", " ", "\x85next", "--- *** ///"]


@pytest.mark.parametrize(("chunk", "cached", "slots", "held"), [(1 << 20, 200_000, (64, 1024), 1 << 21), (60, 10, (3, 3), 4)])
def test_alignment(spark, monkeypatch, libraries, chunk, cached, slots, held):
    for name, value in (("CHUNK", chunk), ("CACHED", cached), ("SLOTS", slots), ("HELD", held)):
        monkeypatch.setattr(alignment, name, value)
    rng = random.Random(2)
    rows = list(enumerate(ODD)) + [(None, "no id"), (3, "repeated id"), (7, ODD[7]), (7, ODD[7])]
    signs = [" ", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", " \n ", ", ", ".", "'s ", "\xa0", ""]
    words = ["hello", "World", "straße", "naïve", "12", "3456", "(x)", "漢", "и", "https://a.b/c", "ß", "token", "☃", "don't"]
    for i in range(120):
        rows.append((100 + i, "".join(rng.choice(words) + rng.choice(signs) for _ in range(rng.randint(1, 60)))))
    assert found(spark, rows) == brute(libraries, rows)


def test_long_text_and_empty_table(spark, libraries):
    assert found(spark, []) == [] and found(spark, [(1, None)]) == [(1, 0, 0, 0, 0, 0, 0, "")]
    rows = [(1, "some words and more, " * 60_000), (2, "some other text")]
    assert found(spark, rows) == brute(libraries, rows)


def test_packed_lists():
    import numpy as np

    arrays = [np.array([], np.int64), np.array([0, 255]), np.array([256, 1]), np.array([1 << 40, 3]), np.array([70_000])]
    assert [x.tolist() for x in alignment.unpack(alignment.pack(*arrays))] == [x.tolist() for x in arrays]
