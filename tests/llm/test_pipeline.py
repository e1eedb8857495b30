"""The corpus pipeline, each stage by a brute-force version on the rows that the stage before kept."""

import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tessellar.llm import bpe, mixing, neardup, secrets, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made():
    rng = np.random.default_rng(2)
    word = lambda: f"w{rng.integers(0, 3000)}"
    rows = []
    for i in range(240):
        words = [word() for _ in range(rng.integers(30, 90))]
        if i % 6 == 0:
            words.insert(10, "foulword")
        if i % 10 == 1:
            words[5] = "token=abcdefgh" + str(i)
        rows.append((i, " ".join(words), "en", f"s{i % 3}" if i % 7 else None, None))
    rows += [(1000 + i, rows[i][1], "en", "s1", None) for i in range(1, 20)]
    near = [(2000 + i, rows[i][1] + " end", "en", "s2", None) for i in range(25, 45)]
    return rows + near + [(3000, None, None, "s0", None), (3001, "", "en", None, 0), (None, "no id here", "en", "s0", 3), (5, rows[5][1], "en", "s2", None), (3002, "long " * 40_000, "en", "s1", None)]


def shingles(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups(rows):
    """The components of rows by place: linked at a similarity of 0.8."""
    sets, of = [shingles(r["text"]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = of[i], of[j]
                of = [min(a, b) if x in (a, b) else x for x in of]
    return of, sets


@pytest.fixture
def folder(spark, tmp_path):
    rows = made()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int("foulword" in (t or ""))) for i, t, *_ in rows if i is not None and i < 240]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages_by_brute_force(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, folder)
    judged = toxicity.judge(docs, toxicity.fit(docs, labels)).collect()
    bad = Counter(r["doc_id"] for r in judged if r["predicted"] == 1)
    assert clean.columns == docs.columns and set(bad) and all("foulword" in (r["text"] or "") for r in docs.collect() if bad[r["doc_id"]] and r["doc_id"] != 5)
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(r["doc_id"] for r in docs.collect() if not bad[r["doc_id"]])

    rows = clean.collect()
    of, sets = groups(rows)
    kept = stages["near_duplicates"](spark, clean, folder)
    got = kept.collect()
    want = len({c for c, s in zip(of, sets, strict=True) if s}) + sum(not s for s in sets)
    assert kept.columns == docs.columns and len(got) == want
    least = {}
    for r, c in zip(rows, of, strict=True):
        least[c] = min(least.get(c, (True, 0)), (r["doc_id"] is None, r["doc_id"] or 0))
    assert Counter((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == Counter(least.values())

    masked = stages["secrets"](spark, kept, folder)
    after = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert masked.columns == docs.columns and len(after) == len(got)
    for r in got:
        assert after[r["doc_id"]] == (None if r["text"] is None else re.sub(r"token=abcdefgh[0-9]*", "token=[SECRET]", r["text"]))

    mixed = stages["mixing"](spark, masked, folder)
    taken, target = Counter(), {}
    for r in mixed.collect():
        taken[r["source"]] += len(r["text"].split())
    for r in mixing.mix_report(masked).collect():
        target[r["source_size"]] = r["target"]
    sizes = defaultdict(int)
    for r in masked.collect():
        sizes[r["source"]] += len((r["text"] or "").split())
    assert mixed.columns == docs.columns
    for s, n in sizes.items():
        assert abs(taken[s] - target[n]) <= 0.02 * target[n] + 10 or n > 40_000

    coded = stages["byte_bpe"](spark, mixed, folder)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).ranks, special_tokens={})
    by_id = Counter((r["doc_id"], r["source"], tuple(library.encode_ordinary(r["text"] or ""))) for r in mixed.collect())
    assert Counter((r["doc_id"], r["source"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in coded.collect()) == by_id


def test_run_of_whole_and_empty_tables(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 0
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "e" / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "e" / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "e")).collect() == []
    assert secrets.redact(spark.createDataFrame([], SCHEMA)).collect() == neardup.distinct(spark.createDataFrame([], SCHEMA)).collect() == []
