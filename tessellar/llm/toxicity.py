"""Toxicity by a learned lexicon, Levenshtein automata over its trie, and context windows.

Learning, on a bounded hash sample of labelled rows (``SAMPLE_ROWS``): prefixes and whole words are counted by document
and label; those that toxic documents hold significantly more often (a binomial test, corrected for the number of terms)
become entries, each as long as it keeps its coverage. An entry is a whole word or a stem. Documents that only quote a term
are counted apart from those that use it, so quotation by clean documents keeps no term out; a whole word that some clean
documents use is an entry if its uses are significantly more often toxic than not. For this count, copies of a
document in the sample count once (two min-wise sketches of its words), or else any word of a copied text would pass.

Scoring: the trie of the entries is intersected with the Levenshtein automaton of one edit at any place (of a stem, up to
its end), determinised lazily as words are read; each word costs a few look-ups. Whole words of five letters or more may be
misspelled; a shorter entry or a stem may if the sample's words one edit away from it bear that out. A word one edit away that
clean documents of the sample use is an ordinary word, no misspelling. Around each hit a window of the text tells
quotation (between quotation marks, or by a word of reporting) from use. A logistic regression on the numbers of
exact, misspelled and quoted hits gives the score. It is fitted on the same sample, but each half's misspelled hits are counted by
the ordinary words of the other half, as those of a new text will be; what the sample tells nothing about stays at ``PRIOR``.

Cases: a null or empty text has no hits and the base score; null or repeated labels: rows without a label are left out, of
several labels the highest counts; without any labelled row of both kinds the score is 0.1 for all; repeated rows get equal
scores; a null id is scored like any other; an empty table gives an empty result; other columns are ignored or carried.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, trimmed

#: Labelled rows that learning looks at, at most: those with the smallest hash of their id.
SAMPLE_ROWS = 12_000
STEM = range(3, 13)
LEAST_FUZZY = 5
WINDOW = 60
CACHED = 200_000
THRESHOLD = 0.3
#: Weights before any evidence: of the constant, exact, misspelled and quoted hits, and of two hits that are sure. A quotation tells little.
PRIOR = (0.0, 2.0, 1.0, 0.3, 1.0)

WORD = re.compile(r"\w+")
#: Words of reporting in the languages of the corpora.
REPORTING = re.compile(r"\b(said|says|say|called|calls|wrote|quote|quoted|quotes|word|term|insult|dit|disait|cite|mot|sagte|sagt|nannte|zitat|wort|dijo|dice|llamó|cita|palabra)\b", re.I)
OPENING, CLOSING = "\"“«„‘", "\"”»“’"

# --- automaton ---


class Lexicon:
    """Entries (term, is_stem, or also whether it may be misspelled); ``look`` gives 0 (none), 1 (as it is) or 2 (misspelled) for a lower-cased word.

    Words of ``plain`` are ordinary ones that no entry stands behind.
    """

    def __init__(self, entries: list[tuple], plain: frozenset[str] = frozenset()):
        self.plain = plain
        self.children: list[dict[str, int]] = [{}]
        # a misspelled term lies below; a term ends here, as a word or stem; it may be misspelled itself
        self.fuzzy, self.word, self.stem, self.loose = [False], [False], [False], [False]
        self.terms: dict[int, str] = {}
        for term, is_stem, *may in entries:
            loose, node = may[0] if may else len(term) >= LEAST_FUZZY, 0
            self.fuzzy[0] |= loose
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    for flags in (self.fuzzy, self.word, self.stem, self.loose):
                        flags.append(False)
                node = self.children[node][c]
                self.fuzzy[node] |= loose
            (self.stem if is_stem else self.word)[node] = True
            self.loose[node] |= loose
            self.terms[node] = term
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.ends: list[int] = []
        self.done: list[int] = []
        self.cached: dict[str, int] = {}
        self.start = self._state({(0, 0)})

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        """The number of a set of (node, edits), closed under a letter that the word lacks."""
        pairs = set(pairs)
        for node, e in list(pairs):
            if e == 0:
                pairs |= {(x, 1) for x in self.children[node].values() if self.fuzzy[x]}
        key = frozenset(p for p in pairs if p[1] == 0 or (p[0], 0) not in pairs)
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            best = lambda flags: min((e + 1 for n, e in key if flags[n] and (e == 0 or self.loose[n])), default=0)
            self.done.append(best(self.stem))
            self.ends.append(min((x for x in (best(self.stem), best(self.word)) if x), default=0))
        return self.ids[key]

    def _move(self, state: int, c: str) -> int:
        out = set()
        for node, e in self.sets[state]:
            if c in self.children[node]:
                out.add((self.children[node][c], e))
            if e == 0:
                out |= {(x, 1) for x in self.children[node].values() if self.fuzzy[x]}  # another letter
                if self.fuzzy[node]:
                    out.add((node, 1))  # one letter more
        self.moves[state][c] = new = self._state(out)
        return new

    def look(self, word: str) -> int:
        state, found = self.start, 0
        for c in word:
            new = self.moves[state].get(c)
            state = self._move(state, c) if new is None else new
            if self.done[state] == 1:
                return 1
            found = found or self.done[state]
            if not self.sets[state]:
                return found
        end = self.ends[state]
        return end if end == 1 else found or end

    def near(self, word: str) -> set[str]:
        """The terms that a word misses by one edit."""
        state, out = self.start, set()
        for c in word:
            new = self.moves[state].get(c)
            state = self._move(state, c) if new is None else new
            out |= {self.terms[n] for n, e in self.sets[state] if e and self.stem[n] and self.loose[n]}
        return out | {self.terms[n] for n, e in self.sets[state] if e and self.word[n] and self.loose[n]}

    def kinds(self, words: list[str]) -> list[int]:
        cached, out = self.cached, []
        for w in words:
            k = cached.get(w)
            if k is None:
                if len(cached) >= CACHED:
                    cached.clear()
                k = self.look(w)
                k = cached[w] = 0 if k == 2 and w in self.plain else k
            out.append(k)
        return out


def _quoted(text: str, begin: int, end: int) -> bool:
    """Whether a hit is reported: between quotation marks of its own line and window, or near a word of reporting."""
    before, after = text[max(0, begin - WINDOW) : begin].rpartition("\n")[2], text[end : end + WINDOW].partition("\n")[0]
    opened = max((before.rfind(q) for q in OPENING), default=-1)
    if opened >= 0 and any(q in after for q in CLOSING) and not any(q in before[opened + 1 :] for q in CLOSING):
        return True
    return bool(REPORTING.search(before) or REPORTING.search(after))


def hits(lexicon: Lexicon, text: str) -> tuple[int, int, int]:
    """Numbers of exact, misspelled and quoted hits."""
    low = text.lower()
    kinds = lexicon.kinds(WORD.findall(low))
    if not any(kinds):
        return 0, 0, 0
    n = [0, 0, 0]
    for k, m in zip(kinds, WORD.finditer(low), strict=True):
        if k:
            n[2 if _quoted(low, m.start(), m.end()) else k - 1] += 1
    return n[0], n[1], n[2]


# --- learning ---


@dataclass(frozen=True)
class Model:
    entries: tuple[tuple[str, bool, bool], ...]
    weights: tuple[float, ...]
    plain: frozenset[str] = frozenset()


def _features(counts: np.ndarray) -> np.ndarray:
    logs = np.log1p(counts)
    sure = counts[:, 0] + 0.5 * counts[:, 1]
    return np.column_stack([np.ones(len(counts)), logs, sure >= 2])


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Newton steps of a logistic regression that is shrunk to ``PRIOR``; the constant isn't shrunk."""
    prior, penalty = np.array(PRIOR), np.full(x.shape[1], ridge)
    w = prior.copy()
    penalty[0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad, hess = x.T @ (p - y) + penalty * (w - prior), (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w = w - step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
    return w


def _used(text: str) -> tuple[set[str], set[str]]:
    """All words of a lower-cased text, and those that occur outside of quotations."""
    words, used = set(), set()
    for m in WORD.finditer(text):
        words.add(m[0])
        if m[0] not in used and not _quoted(text, m.start(), m.end()):
            used.add(m[0])
    return words, used


def _terms(words: set[str]) -> set[str]:
    return {w[:n] for w in words for n in STEM if n <= len(w)} | {w + "$" for w in words if len(w) >= STEM[0] - 1}


COUNTS = ("clean", "toxic", "clean_used", "toxic_used")


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [Counter() for _ in COUNTS]
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words, used = _used((text or "").lower())
            counts[1 if toxic else 0].update(_terms(words))
            counts[3 if toxic else 2].update(_terms(used))
        terms = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in counts)], names=["term", *COUNTS])


def _entries(rows: list[tuple[str, int, int, int, int]], tested: int, clean: int, toxic: int) -> list[tuple[str, bool]]:
    """Significant terms, each lengthened while one continuation keeps nearly all of its toxic documents."""
    share, found = toxic / (toxic + clean), {t: (b, a, b_used, a_used) for t, a, b, a_used, b_used in rows}
    need = math.log(max(tested, 2))

    def beyond(b: int, a: int, share: float) -> bool:
        if b < 3:
            return False
        tail = sum(math.exp(math.lgamma(a + b + 1) - math.lgamma(k + 1) - math.lgamma(a + b - k + 1) + k * math.log(share) + (a + b - k) * math.log(1 - share)) for k in range(b, a + b + 1))
        return -math.log(max(tail, 1e-300)) > need

    def significant(t: str) -> bool:
        b, a, b_used, a_used = found[t]
        return (a <= 0.03 * b and beyond(b, a, share)) or (a_used <= 0.03 * b_used and beyond(b_used, a_used, share))

    below: dict[str, list[str]] = {}
    for t in found:
        below.setdefault(t[:-1], []).append(t)
    out, covered = {}, set()
    for t in sorted(found, key=lambda t: (len(t.rstrip("$")), t)):
        if any(t[:n] in covered for n in range(STEM[0], len(t))) or not significant(t):
            continue
        covered.add(t)
        while (best := max(below.get(t, []), key=lambda x: found[x][0], default=None)) and found[best][0] >= 0.85 * found[t][0]:
            t = best
        out[t.rstrip("$")] = not t.endswith("$")
    stems = {t for t, is_stem in out.items() if is_stem}
    for t in found:
        word = t.rstrip("$")
        # no stem by this rule: one that clean documents use is more likely a start of other words
        if t.endswith("$") and word not in out and not any(word[:n] in stems for n in range(STEM[0], len(word))) and beyond(*found[t][2:], max(share, 0.5)):
            out[word] = False
    return sorted(out.items())


def _misspelled(terms: DataFrame, entries: list[tuple[str, bool]]) -> list[tuple[str, bool, bool]]:
    """Entries with whether they may be misspelled: long whole words; others if the sample's words one edit away are toxic but for a tenth.

    Without any such word, long stems may and short entries may not.
    """
    exact, unsure = Lexicon([(t, is_stem, False) for t, is_stem in entries]), [(t, is_stem, True) for t, is_stem in entries if is_stem or len(t) < LEAST_FUZZY]
    near = Lexicon(unsure)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean, toxic = Counter(), Counter()
        for batch in batches:
            for word, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                word = word.rstrip("$")
                for t in () if exact.look(word) else near.near(word):
                    clean[t] += a
                    toxic[t] += b
        found = sorted(clean)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *(pa.array([c[t] for t in found], pa.int64()) for c in (clean, toxic))], names=["term", "clean", "toxic"])

    words = terms.filter("term like '%$'").select("term", "clean_used", "toxic_used")
    sums = words.mapInArrow(trimmed(work), "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean"), F.sum("toxic")).collect() if unsure else []  # an entry a row
    seen = {t: (a, b) for t, a, b in sums}

    def may(t: str, is_stem: bool) -> bool:
        a, b = seen.get(t, (0, 0))
        return (a <= 0.1 * b and (b > 0 or len(t) >= LEAST_FUZZY)) if is_stem or len(t) < LEAST_FUZZY else True

    return [(t, is_stem, may(t, is_stem)) for t, is_stem in entries]


FOLDS = 2


def _near_words(sample: DataFrame, entries: list[tuple[str, bool]]) -> list[tuple[str, int, int, int]]:
    """word, fold, clean and toxic documents of the sample that use it, of the words one edit away from an entry."""
    exact, near = Lexicon([(t, is_stem, False) for t, is_stem in entries]), Lexicon([(t, is_stem, True) for t, is_stem in entries])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text, toxic, fold in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts.update((w, fold, int(bool(toxic))) for w in _used((text or "").lower())[1] if not exact.look(w) and near.look(w))
        rows = [(w, f, n * (1 - t), n * t) for (w, f, t), n in sorted(counts.items())]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["word", "fold", "clean", "toxic"])

    found = sample.select("text", "toxic", "fold").mapInArrow(trimmed(work), "word string, fold int, clean long, toxic long").groupBy("word", "fold").agg(F.sum("clean"), F.sum("toxic"))
    return [tuple(r) for r in found.collect()]  # words of a bounded sample


def _plain(seen: list[tuple[str, int, int, int]], folds: set[int]) -> frozenset[str]:
    """The ordinary words of some folds: clean documents use them, and toxic ones not much more often."""
    clean, toxic = Counter(), Counter()
    for word, fold, a, b in seen:
        if fold in folds:
            clean[word] += a
            toxic[word] += b
    return frozenset(w for w, a in clean.items() if a > 0.1 * toxic[w])


def _distinct(sample: DataFrame) -> DataFrame:
    """The first document of each sketch: the least hash of its words by two hashes; few near copies stay."""
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+")
    for k in (1, 2):
        sample = sample.withColumn("sketch", F.array_min(F.transform(words, lambda w: F.xxhash64(F.lit(k), w))))
        order = Window.partitionBy("sketch").orderBy(F.desc("toxic"), "text")
        sample = sample.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth", "sketch")
    return sample


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on labelled documents; ``labels`` (doc_id, toxic) holds the rows that may be learnt from."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # a bounded number of rows, so it may be broadcast
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    fold = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(FOLDS)).cast("int").alias("fold")
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"), fold)
    whole, sample = sample, _distinct(sample)
    n = {bool(r["toxic"]): r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return Model((), (math.log(1 / 9), 0.0, 0.0, 0.0, 0.0))
    sample = cut(sample)
    counts = sample.select("text", "toxic").mapInArrow(trimmed(_term_counts), "term string, " + ", ".join(f"{c} long" for c in COUNTS))
    every = cut(counts.groupBy("term").agg(*(F.sum(c).alias(c) for c in COUNTS)))
    # words shorter than any term are counted for ``_misspelled`` only
    terms = every.filter(f"toxic >= 3 and length(replace(term, '$', '')) >= {STEM[0]}")
    excess = F.greatest(*(F.col(b) - n[True] / (n[True] + n[False]) * (F.col(a) + F.col(b)) for a, b in (COUNTS[:2], COUNTS[2:])))
    tested, top = terms.count(), terms.filter("clean <= 0.1 * toxic or clean_used < toxic_used").orderBy(excess.desc(), "term").collect()  # terms of a bounded sample that clean documents of it hardly have
    entries = _entries([tuple(r) for r in top], tested, n[False], n[True])
    seen, entries = _near_words(sample, entries), _misspelled(every, entries)
    folds = set(range(FOLDS))
    parts = [_counted(whole.filter(F.col("fold") == k).select("text", "toxic"), entries, ("toxic",), _plain(seen, folds - {k})) for k in folds]
    counted = parts[0].unionByName(parts[1]).select("exact", "fuzzy", "quoted", "toxic").toPandas()  # sample_rows rows at most
    w = _fit(_features(counted[["exact", "fuzzy", "quoted"]].to_numpy(float)), counted["toxic"].to_numpy(float))
    # more hits never make a text less toxic
    return Model(tuple(entries), (float(w[0]), *(max(0.0, float(x)) for x in w[1:])), _plain(seen, folds))


# --- scoring ---


def _counted(docs: DataFrame, entries: list[tuple[str, bool, bool]], keep: tuple[str, ...], plain: frozenset[str] = frozenset()) -> DataFrame:
    schema = docs.select(*[docs[c] for c in keep]).schema
    for name in ("exact", "fuzzy", "quoted"):
        schema = schema.add(name, "integer")
    entries, kept = list(entries), len(keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(entries, plain)
        for batch in batches:
            n = [hits(lexicon, t.as_py() or "") for t in batch.column(kept)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *(pa.array([x[i] for x in n], pa.int32()) for i in range(3))], names=schema.names)

    return docs.select(*[docs[c] for c in keep], docs["text"]).mapInArrow(trimmed(work), schema)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, numbers of exact, misspelled and quoted hits, and ``score``."""
    d = _counted(docs, list(model.entries), keep, model.plain)
    w = [F.lit(x) for x in model.weights]
    logit = w[0] + w[1] * F.log1p("exact") + w[2] * F.log1p("fuzzy") + w[3] * F.log1p("quoted") + w[4] * (F.col("exact") + 0.5 * F.col("fuzzy") >= 2).cast("double")
    return d.withColumn("score", 1 / (1 + F.exp(-logit)))


def held_out(name: str = "doc_id"):
    """Rows that nothing is learnt from: a quarter by the crc32 of the id as text."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the rows that aren't held out."""
    return learn(docs, labels.filter(~held_out()))


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted; then the numbers of hits."""
    s = score(docs, model)
    return s.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "exact", "fuzzy", "quoted")


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` below the threshold, with their columns."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # own names may clash with those of the hits
    scored = score(docs.toDF(*names).withColumn("text", F.col(names[docs.columns.index("text")])), model, keep=tuple(names))
    return scored.filter(F.col("score") < THRESHOLD).select(*names).toDF(*docs.columns)
