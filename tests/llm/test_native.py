"""Secrets, mixing and sharding against brute force, and their edge cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

from tessellar.llm import mixing, secrets, sharding

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block string, trigram string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, "x", "y") for i, t, s in rows], SCHEMA)


def brute(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    kinds = ("assign", "access", "hex")
    joined = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(found))
    return (*(sum(k == i for _, k, _ in found) for i in range(3)), hashlib.sha256(joined.encode()).hexdigest())


TEXTS = [
    "token=token:abcdefgh", "é😀 API_KEY = 'abc.def=' AKIA" + "A" * 20 + "b" * 30, None, "", "token=token=abcdef", "password=short", "PassWD:\"longer-1 secret : 'x'", "AKIAAKIA" + "0" * 10,
    "x" * 50_000 + " secret=abcdefg " + "0" * 24, "tok ken oke", "api_key=abc123 apikey=abc123",
]


def test_secret_spans(spark):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)] + [(None, "token=abcdefg", "s"), (1, TEXTS[1], None)]
    got = secrets.find(docs(spark, rows)).collect()
    want = Counter((i, *brute(t)) for i, t, _ in rows)
    assert Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == want


def test_redaction_keeps_rows_and_columns(spark):
    d = docs(spark, [(1, "my token = 'abcdefgh' ok", "s"), (2, None, None)])
    out = {r["doc_id"]: r for r in secrets.redact(d).collect()}
    assert out[1]["text"] == "my token = '[SECRET]' ok" and out[2]["text"] is None and secrets.redact(d).columns == d.columns


def test_redaction_masks_what_is_found(spark):
    texts = [*TEXTS, "password=abcdef0123456789abcdef0123456789 and AKIA" + "0123456789ABCDEF" * 2, "secret: " + "a1" * 20 + "/x"]
    clash = "doc_id long, text string, _kinds string, _cid long, n_chars int, row string, _s0 string, `a b` string"
    rows = [(i, t, "k", 5, None, "r", "s", "t") for i, t in enumerate(texts)] + [(None, "token=abcdefgh", "k", 5, None, "r", "s", "t")]
    d = spark.createDataFrame(rows, clash)
    spans = {r["doc_id"]: r["spans"] for r in secrets.find(d).collect()}
    for r in secrets.redact(d).collect():
        text = "token=abcdefgh" if r["doc_id"] is None else texts[r["doc_id"]]
        values = []
        for kind, a, b in (x.split(":") for x in spans[r["doc_id"]].split(",") if x):
            rule = next(x for x in secrets.RULES if x.kind == kind)
            m = re.compile(rule.pattern).match(text, int(a))
            values.append((m.start(rule.group) if rule.group else int(a), int(b)))
        want, at = "", 0
        for a, b in sorted(values):
            if a >= at:
                want += text[at:a] + "[SECRET]"
            at = max(at, b)
        want = None if text is None else want + text[at:] if values else text
        assert (r["text"], r["_kinds"], r["_cid"], r["a b"]) == (want, "k", 5, "t") and r["n_chars"] == (None if want is None else len(want))
    assert secrets.redact(d).columns == d.columns


def test_trigram_queries_hold_for_matches():
    def holds(q, text):
        return True if q is None else q in text if isinstance(q, str) else (all if q[0] == "and" else any)(holds(x, text) for x in q[1])

    for text in ("PASSWORD=abcdef", "api_key:abcdef", "apikey=abcdef", "token = x12345", "passwd=abcdefg", "SeCrEt=abcdefg"):
        assert holds(secrets.trigram_query(secrets.RULES[0].pattern), text.lower())
    assert secrets.trigram_query("[0-9a-f]+") is None and secrets.trigram_query("a|bcd") is None
    assert holds(secrets.trigram_query("ab?cde+f"), "acdef") and not holds(secrets.trigram_query("xyzzy"), "xyz")


def water_filling(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] >= 3 * sizes[s]}
        if not full:
            return target | {s: unit * weight[s] for s in open_}
        target |= {s: 3.0 * sizes[s] for s in full}
        left -= sum(3.0 * sizes[s] for s in full)
        open_ -= full
    return target


def test_mix_meets_targets(spark):
    rows = [(i, "w " * (i % 17 + 1), f"s{i % 5 if i % 3 else 0}" if i % 11 else None) for i in range(600)] + [(900, "", "s1"), (901, None, "s9"), (3, "w " * 4, "s0")]
    got = mixing.mix_report(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    source = {i: s for i, _, s in rows}
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        s = source[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"] and len(r["shards"]) == r["copies"]
    want = water_filling(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= max(2, 0.01 * want[s])
    assert sorted(map(str, mixing.mix_report(docs(spark, rows)).collect())) == sorted(map(str, got))


def test_long_documents_do_not_stop_the_fill(spark):
    # each of three sources is one block; long documents overshoot, short ones still fit
    sizes = [[20] * 45 + [900], [15] * 60 + [1000], [20] * 60]
    rows = [(100 * s + i, "w " * n, f"s{s}") for s, of in enumerate(sizes) for i, n in enumerate(of)]
    taken, target = defaultdict(int), {}
    for r in mixing.mix_report(docs(spark, rows), weights=(1, 1, 9)).collect():
        taken[r["doc_id"] // 100] += r["taken"]
        target[r["doc_id"] // 100] = r["target"]
    assert all(target[s] < max(sizes[s]) for s in (0, 1))
    assert all(abs(taken[s] - target[s]) <= 10 for s in target), (taken, target)


MIXED = "doc_id long, text string, source string, _id long, _h string, shards string, `row` string"


def mixed_docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "h", "x", "r") for i, t, s in rows], MIXED)


def test_mix_takes_what_is_planned_of_equal_rows(spark):
    rows = [(7, "w " * 10, "a")] * 40 + [(i, "w " * 10, "b") for i in range(20)] + [(7, "w " * 10, "c"), (None, "v w", "c"), (None, "v w", "c"), (9, None, "c"), (10, "", None)]
    planned, taken = Counter(), Counter()
    report = mixing.mix_report(docs(spark, [(i, t, s) for i, t, s in rows])).collect()
    of = {(i, len((t or "").split())): s for i, t, s in rows if s != "a"}
    for r in report:
        planned[r["doc_id"], r["size"]] += r["taken"]
    for r in mixing.mix(mixed_docs(spark, rows)).collect():
        taken[r["doc_id"], len(r["text"].split())] += len(r["text"].split())
    assert +planned == +taken and of
    by_source = Counter()
    for r in mixing.mix(mixed_docs(spark, rows)).collect():
        by_source[r["source"]] += 10 if r["source"] in "ab" else 0
    target = {r["source_size"]: r["target"] for r in report}
    assert abs(by_source["a"] - target[400]) <= 10 and abs(by_source["b"] - target[200]) <= 10


def test_mix_shuffles_inside_shards(spark):
    rows = [(i, "w " * (i % 9 + 1), f"s{i % 3}") for i in range(500)]
    out = mixing.mix(mixed_docs(spark, rows).coalesce(1), order="place").collect()
    assert mixing.mix(mixed_docs(spark, rows), shard=None).columns == mixed_docs(spark, []).columns
    shards = defaultdict(list)
    for r in out:
        shards[r["mix_shard"]].append(r)
    assert len(shards) > 3
    for of in shards.values():
        ids = [r["doc_id"] for r in of]
        assert [r["place"] for r in of] == sorted(r["place"] for r in of) and (len(ids) < 5 or ids != sorted(ids))
    copies = Counter(r["doc_id"] for r in out)
    assert copies == Counter({r["doc_id"]: r["copies"] for r in mixing.mix_report(mixed_docs(spark, rows)).collect() if r["copies"]})


def test_split_tree_is_exact(spark):
    drawn = spark.createDataFrame([(0, 40), (1, 0), (2, 7), (3, 300)], "place int, n long")
    leaves = mixing.split_tree(drawn, 6).collect()
    by_source, by_shard = Counter(), Counter()
    for r in leaves:
        by_source[r["place"]] += r["n"]
        by_shard[r["shard"]] += r["n"]
    assert dict(by_source) == {0: 40, 1: 0, 2: 7, 3: 300} and sorted(by_shard.values()) == [57, 58, 58, 58, 58, 58]


def test_sharding(spark):
    rows = [(i, "é" * (i % 40), "s") for i in range(800)] + [(None, None, None), (5, "é" * 5, "s"), (5, "é" * 5, "s")]
    got = sharding.shard_documents(docs(spark, rows), shards=7, slots=512).collect()
    assert len(got) == len(rows)
    places, sizes = defaultdict(list), Counter()
    for r in got:
        places[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and max(sizes.values()) - min(sizes.values()) < 100
    one = next(r for r in got if r["doc_id"] == 7)
    assert one["size"] == 14 + 16 and one["text_crc32"] == zlib.crc32(("é" * 7).encode())


def test_equal_rows_do_not_fill_a_shard(spark, tmp_path):
    rows = [(5, "same text", "s")] * 600 + [(None, "none", "s")] * 300 + [(i, "x" * (i % 30), "s") for i in range(900)] + [(1, "long " * 1_000, "s")]
    got = sharding.shard_documents(docs(spark, rows), shards=6, slots=256, path=str(tmp_path / "map")).collect()
    assert len(got) == len(rows)
    sizes, places = Counter(), defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and max(sizes.values()) - min(sizes.values()) < 0.1 * max(sizes.values())
    versions = spark.read.parquet(str(tmp_path / "map"))
    assert {r["version"] for r in versions.select("version").distinct().collect()} == {1, 2}
    first, second = ({r["vslot"]: r["shard"] for r in sharding.load_map(spark, str(tmp_path / "map"), v).collect()} for v in (1, 2))
    assert {(r["shard"], r["next_shard"]) for r in got} == {(first[r["vslot"]], second[r["vslot"]]) for r in got}
    assert any(x == 6 for x in second.values()) and sum(first[s] != second[s] for s in first) < 0.5 * len(first)
    # the map and the record say where each of the equal rows lies
    nth, records = Counter(), []
    for i, t, _ in rows:
        crc = zlib.crc32((t or "").encode())
        records.append((i, crc, nth[i, crc]))
        nth[i, crc] += 1
    where = sharding.located(spark.createDataFrame(records, "doc_id long, text_crc32 long, nth long"), sharding.load_map(spark, str(tmp_path / "map"), 1), 256).collect()
    assert Counter((r["doc_id"], r["text_crc32"], r["shard"]) for r in where) == Counter((r["doc_id"], r["text_crc32"], r["shard"]) for r in got)


def test_reruns_share_a_map_and_agree(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 50)
    rows = [(5, "same text", "s")] * 400 + [(i, "x" * (i % 30), "s") for i in range(500)] + [(None, None, None)] * 3 + [(7, "long " * 300_000, "s")]
    kind = "doc_id long, text string, at long, spread boolean, vslot int, nth long, salt int"
    table = lambda order, n: spark.createDataFrame([(i, t, 1, True, 2, 3, 4) for i, t, _ in order], kind).repartition(n)
    found = [Counter(tuple(r) for r in sharding.shard_documents(table(order, n), 6, 128).collect()) for order, n in ((rows, 3), (rows[::-1], 7))]
    assert found[0] == found[1] and sum(found[0].values()) == len(rows)


def test_rebalancing_moves_little(spark):
    stats = spark.createDataFrame([(i, 100 + i % 7, 3) for i in range(256)], "vslot int, bytes long, n long")
    old = sharding.first_map(stats, 4)
    new = sharding.rebalanced(old, stats, 5)
    before = {r["vslot"]: r["shard"] for r in old.collect()}
    after = {r["vslot"]: (r["shard"], r["version"]) for r in new.collect()}
    assert len(after) == 256 and {v for _, v in after.values()} == {2}
    moved = [s for s, (x, _) in after.items() if before[s] != x]
    assert all(after[s][0] == 4 for s in moved) or len(moved) < 80
    loads = Counter()
    for s, (x, _) in after.items():
        loads[x] += 100 + s % 7
    assert max(loads.values()) - min(loads.values()) < 250


def test_empty_tables(spark):
    d = docs(spark, [])
    assert secrets.find(d).count() == mixing.mix_report(d).count() == sharding.shard_documents(d).count() == 0
