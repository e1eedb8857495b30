"""The language model against a one-by-one sampler and by its own laws."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessellar.llm import language_model as lm
from tessellar.llm.seating import Restaurants, Tables

SCHEMA = "doc_id long, text string, chunk string, data string, receiver string, held string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "c", "d", "r", "h") for i, t in rows], SCHEMA)


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def made(n, seed=0, vocabulary=400):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{x}" for x in np.minimum(rng.zipf(1.4, rng.integers(1, 80)), vocabulary)) for _ in range(n)]


class OneByOne:
    """Both levels, each customer taken out and seated again in turn."""

    def __init__(self, events, seed=1):
        self.rng = np.random.default_rng(seed)
        self.words = {w for _, w in events}
        self.child, self.root = defaultdict(lambda: defaultdict(list)), defaultdict(lambda: defaultdict(list))
        self.tables, self.customers = Counter(), Counter()
        self.events = list(events)
        for u, w in self.events:
            self.seat(u, w)

    def p(self, u, w):
        level = u is not None
        d, s = lm.DISCOUNT[level], lm.STRENGTH[level]
        below = self.p(None, w) if level else 1 / (len(self.words) + 1)
        t = self.child[u][w]
        return (sum(t) - d * len(t) + (s + d * self.tables[u]) * below) / (s + self.customers[u])

    def seat(self, u, w):
        level = u is not None
        d, s = lm.DISCOUNT[level], lm.STRENGTH[level]
        t = self.child[u][w]
        new = (s + d * self.tables[u]) * (self.p(None, w) if level else 1 / (len(self.words) + 1))
        weights = np.array([*(c - d for c in t), new])
        k = self.rng.choice(len(weights), p=weights / weights.sum())
        self.customers[u] += 1
        if k < len(t):
            t[k] += 1
            return
        t.append(1)
        self.tables[u] += 1
        if level:
            self.seat(None, w)

    def leave(self, u, w):
        t = self.child[u][w]
        k = self.rng.choice(len(t), p=np.array(t) / sum(t))
        t[k] -= 1
        self.customers[u] -= 1
        if not t[k]:
            t.pop(k)
            self.tables[u] -= 1
            if u is not None:
                self.leave(None, w)

    def sweep(self):
        for u, w in self.events:
            self.leave(u, w)
            self.seat(u, w)


def test_one_restaurant_as_one_by_one():
    """Tables of a single restaurant settle where those of a one-by-one sampler do."""
    rng = np.random.default_rng(5)
    count = np.bincount(np.minimum(rng.zipf(1.5, 4000), 300))[1:]
    count = count[count > 0]
    n, d, s = len(count), 0.75, 20.0
    parent = (count + 1) / (count + 1).sum()
    tables = [[1] * c for c in count]
    total, means = sum(map(len, tables)), []
    for sweep in range(25):
        for w in range(n):
            for _ in range(count[w]):
                t = tables[w]
                k = rng.choice(len(t), p=np.array(t) / sum(t)) if len(t) > 1 else 0
                t[k] -= 1
                if not t[k]:
                    t.pop(k)
                    total -= 1
                new = (s + d * total) * parent[w]
                have = sum(t) - d * len(t)
                if rng.random() * (new + have) < new:
                    t.append(1)
                    total += 1
                else:
                    t[rng.choice(len(t), p=(np.array(t) - d) / have)] += 1
        means.append(total)
    level = Restaurants(np.zeros(n, int), parent, np.array([n]), d, s, np.random.default_rng(6))
    state = level.arrive(Tables(np.arange(n), np.ones(n, int)), count)
    own = []
    for _ in range(45):
        state = level.reseat(state, n, 16)
        customers, of = state.counts(n)
        assert (customers == count).all() and level.tables[0] == of.sum() == len(state.size) and (state.size > 0).all()
        own.append(of.sum())
    assert abs(np.mean(own[5:]) / np.mean(means[8:]) - 1) < 0.05, (np.mean(own[5:]), np.mean(means[8:]))
    assert abs(np.mean(own[5:25]) / np.mean(own[25:]) - 1) < 0.03


def test_customers_leave_and_come():
    rng = np.random.default_rng(8)
    level = Restaurants(np.zeros(50, int), np.full(50, 0.02), np.array([0.0]), 0.6, 5.0, rng)
    state = Tables(np.empty(0, int), np.empty(0, int))
    for _ in range(6):
        target = rng.integers(0, 500, 50) * (rng.random(50) < 0.8)
        state = level.arrive(state, target)
        assert (state.counts(50)[0] == target).all() and level.tables[0] == len(state.size) and (np.diff(state.dish) >= 0).all()


def test_scores_as_one_by_one(spark):
    """Scores of held-out texts are near those of a one-by-one sampler over many sweeps."""
    rows = list(enumerate(made(150, vocabulary=60)))
    events = [e for i, t in rows if not held(i) for e in zip(["<s>", *words(t)], [*words(t), "</s>"], strict=True)]
    model, sums = OneByOne(events), defaultdict(float)
    for sweep in range(12):
        model.sweep()
        if sweep >= 4:
            for u, w in {e for _, t in rows for e in zip(["<s>", *words(t)], [*words(t), "</s>"], strict=True)}:
                sums[u, w] += model.p(u, w) / 8
    got = {r["doc_id"]: r["score"] for r in lm.score(docs(spark, rows), sweeps=6, kept=3).collect()}
    want = {i: sum(math.log10(sums[e]) for e in zip(["<s>", *words(t)], [*words(t), "</s>"], strict=True)) for i, t in rows}
    apart = np.array([got[i] / want[i] - 1 for i, _ in rows])
    assert abs(apart.mean()) < 0.01 and (abs(apart) < 0.05).all(), (apart.mean(), abs(apart).max())


def test_a_contexts_probabilities_sum_to_one(spark):
    """Over all training words and one unseen, for contexts of one bucket and one that is spread over two."""
    rng, v = np.random.default_rng(3), 300
    pairs = [(u, w) for u in (5, 6, 9, lm.START) for w in range(v + 1)]  # the word v is not in training
    times = [0 if w == v or u == 9 else int(rng.zipf(1.5)) % 900 if rng.random() < 0.3 or u == 5 else 0 for u, w in pairs]
    times = [t + (w != v and u == 6) for (u, w), t in zip(pairs, times, strict=True)]  # each word occurs
    keys, times, hot = np.array([u << 32 | w for u, w in pairs], np.uint64), np.array(times), np.array([u in (6, lm.START) for u, _ in pairs])
    of = np.where(hot, keys % np.uint64(2), 0)
    requests = lm._mail([("pairs", 0, b, lm._packed_pairs(keys[of == b], hot[of == b], times[of == b])) for b in (0, 1)])
    buckets = [lm._Bucket(requests.slice(b, 1), 2) for b in (0, 1)]
    frame = lambda mail: spark.createDataFrame([tuple(r.values()) for r in mail.to_pylist()], lm.MAIL)
    asked, none = frame(requests), spark.createDataFrame([], lm.MAIL)
    first = frame(lm._mail([r for b in buckets for r in b.to_owners((b.count > 0).astype(int))]))
    replies, parent = lm._parents(first, none, lm._Parent(0, v, v), 0, 16)
    seated, settled = none, []
    for sweep in range(1, 4):
        seated = lm._seated(asked, replies.filter("kind = 'parent'").unionByName(seated.filter("kind = 'seating'")), parent, sweep, 2, 16)
        replies, parent = lm._parents(seated.filter("kind = 'tables'"), replies.filter("kind = 'words'"), parent, sweep, 16)
        mail, law = seated.filter("kind = 'seating'").unionByName(replies).toArrow(), Counter()
        for b in buckets:
            own = mail.filter(np.array(mail["receiver"].to_numpy() == b.number))
            state = Tables(*lm._unpacked(lm._letters(own, "seating")[0][1], np.int64, np.int64))
            for key, p in zip(b.keys.tolist(), b.predictive(state, *b.read(own, "parent", parent)).tolist(), strict=True):
                law[key >> 32] += p
        assert len(law) == 4 and all(abs(x - 1) < 1e-9 for x in law.values()), law
        settled.append(parent.customers)
    assert max(settled) / min(settled) < 1.1


def test_packs_of_pairs():
    rng = np.random.default_rng(1)
    keys = np.unique(np.concatenate([rng.integers(0, 9, 500) << 32 | rng.integers(0, 2**31, 500), np.array([lm.START << 32 | 4, 0])]).astype(np.uint64))
    hot, times = (keys >> np.uint64(32)) % np.uint64(2) == 0, rng.integers(0, 9, len(keys))
    got = lm._open_pairs(lm._packed_pairs(keys, hot, times))
    assert (got[0] == keys).all() and (got[1] == hot).all() and (got[2] == times).all()


def test_base_scores(spark):
    rows = list(enumerate(made(60))) + [(60, None), (61, ""), (62, "The THE É"), (None, "w1 w2"), (3, "w1"), (3, "w1"), (64, "long " * 150_000)]
    got = lm.score(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    c = Counter(w for i, t in rows if not held(i) for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(words(t)) + 1, sum(c[w] > 0 for w in [*words(t), None]), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*words(t), None]), 5)) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert all(r["score"] < 0 for r in got)


def test_parts_change_no_scores_but_by_chance(spark, monkeypatch):
    rows = list(enumerate(made(150, vocabulary=60)))
    whole = {r["doc_id"]: r for r in lm.score(docs(spark, rows)).collect()}
    for name, x in (("BUCKET_CHARS", 3000), ("OWNER_CHARS", 5000), ("CHUNK", 4000), ("HASHED", 1000)):
        monkeypatch.setattr(lm, name, x)
    apart = []
    for r in lm.score(docs(spark, rows), hot=200).collect():
        of = whole[r["doc_id"]]
        apart.append(r["score"] / of["score"] - 1)
        assert (r["n_tokens"], r["n_known"], round(r["base_score"], 9)) == (of["n_tokens"], of["n_known"], round(of["base_score"], 9))
    assert abs(np.mean(apart)) < 0.01 and np.abs(apart).max() < 0.06


def test_model_learns_order(spark):
    rows = [(i, " ".join(["a b c d e f g h"] * 6 if i % 2 else ["h f d b g e c a"] * 6)) for i in range(80)]
    got = lm.score(docs(spark, rows)).collect()
    assert all(r["score"] > r["base_score"] for r in got if r["held_out"])


def test_rare_words_are_contexts(spark):
    rng = np.random.default_rng(11)
    rows = [(i, " ".join(f"a{k} b{k}" for k in rng.integers(0, 200, 40))) for i in range(200)]
    got = lm.score(docs(spark, rows)).collect()
    assert max(r["perplexity"] for r in got if r["held_out"]) < 60


@pytest.mark.parametrize("rows", [[], [(i, "only held out") for i in range(40) if held(i)]])
def test_without_training_texts(spark, rows):
    got = lm.score(docs(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in got) == [i for i, _ in rows] and all(abs(r["score"]) < 1e-6 and r["train_tokens"] == 0 for r in got)
