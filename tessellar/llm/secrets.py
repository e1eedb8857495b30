"""Secret scans by a trigram inverted index.

1. From every rule's regex a Boolean query over trigrams is derived: what any match must contain. A rule without
   mandatory trigrams (hex runs) has none and scans every text.
2. The index: for every block of 4096 neighbouring ids and every trigram that some query names, the posting list of
   the documents whose lower-cased text has it. Blocks bound the lists, whatever the corpus holds.
3. A query is evaluated on posting lists by intersection and union, block by block; the candidates are joined back
   (broadcast if few by count, else shuffled) and the regex itself verifies them in the text.

Only built-in functions run. Spans are code point offsets, end exclusive, leftmost non-overlapping per rule; a rule may
ask for a least length of its whole match or a group, and matches failing it are dropped after matching.

Cases: a null text counts as empty and has no spans; a null id is always verified; repeated ids share postings and are
each verified on their own text; an empty table gives an empty result; other columns are ignored (``find``) or kept
(``redact``, which needs no names of its own in the result).
"""

from __future__ import annotations

import re
from functools import reduce
from dataclasses import dataclass
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, text_or_empty

BLOCK = 4096


@dataclass(frozen=True)
class Rule:
    """``pattern`` in the dialect that Java and Python share; ``least`` characters of ``group`` are needed."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The contract's three kinds, in its order; runs of one class are matched with their least length at once.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Kinds that the method adds.
EXTRA = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}"),
)
RULES = BASE + EXTRA

# --- trigram queries: None (anything), a string (one trigram), or ("and" | "or", frozenset of queries) ---

_FEW = 64


#: Letters from frequent to rare in many languages: of a literal, the trigrams of the rarest letters are asked for.
_FREQUENT = " etaonisrhldcumfpgwybvkxjqz"
_PER_LITERAL = 2


def _all_of(parts) -> object:
    found = set()
    for p in parts:
        found |= p[1] if isinstance(p, tuple) and p[0] == "and" else {p} - {None}
    return None if not found else next(iter(found)) if len(found) == 1 else ("and", frozenset(found))


def _any_of(parts) -> object:
    parts = set(parts)
    if None in parts:
        return None
    needs = {p: p[1] if isinstance(p, tuple) and p[0] == "and" else frozenset([p]) for p in parts}
    kept = {p for p in parts if not any(needs[q] < needs[p] for q in parts)}  # A or (A and B) is A
    return next(iter(kept)) if len(kept) == 1 else ("or", frozenset(kept))


def _grams(text: str) -> object:
    """The trigrams of a string that rule out most, two at most: fewer posting lists, the regex verifies anyway."""
    rarity = lambda t: sum(_FREQUENT.find(c) if c in _FREQUENT else len(_FREQUENT) for c in t)
    return _all_of(sorted({text[i : i + 3] for i in range(len(text) - 2)}, key=lambda t: (-rarity(t), t))[:_PER_LITERAL])


def _run_query(run: set[str]) -> object:
    """What one of some strings asks for; a string that holds another one adds nothing."""
    return _any_of(_grams(x) for x in run if not any(y != x and y in x for y in run))


def _strings(op, arg) -> set[str] | None:
    """All lower-cased strings that a part of a pattern matches, if they are few."""
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN and all(k is sre.LITERAL for k, _ in arg):
        return {chr(v).lower() for _, v in arg}
    if op is sre.SUBPATTERN:
        return _sequence_strings(arg[-1])
    if op is sre.BRANCH:
        each = [_sequence_strings(x) for x in arg[1]]
        return None if None in each else set().union(*each)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] is not sre.MAXREPEAT and arg[1] <= 4:
        one, out = _sequence_strings(arg[2]), {""}
        if one is None or len(one) ** arg[1] > _FEW:
            return None
        total = set() if arg[0] else {""}
        for n in range(1, arg[1] + 1):
            out = {a + b for a in out for b in one}
            total |= out if n >= arg[0] else set()
        return total
    return None


def _sequence_strings(parts) -> set[str] | None:
    out = {""}
    for op, arg in parts:
        each = _strings(op, arg)
        if each is None or len(out) * len(each) > _FEW:
            return None
        out = {a + b for a in out for b in each}
    return out


def _sequence_query(parts) -> object:
    needs, run = [], {""}
    for op, arg in parts:
        each = _strings(op, arg)
        if each is not None and len(run) * len(each) <= _FEW:
            run = {a + b for a in run for b in each}
            continue
        needs.append(_run_query(run))
        run = each if each is not None else {""}
        if each is None:
            if op is sre.SUBPATTERN:
                needs.append(_sequence_query(arg[-1]))
            elif op is sre.BRANCH:
                needs.append(_any_of(_sequence_query(x) for x in arg[1]))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
                needs.append(_sequence_query(arg[2]))
    return _all_of([*needs, _run_query(run)])


def trigram_query(pattern: str) -> object:
    """The Boolean query that every text with a match fulfils; None if the pattern has no mandatory trigrams."""
    return _sequence_query(_parser.parse(pattern))


def _named(query: object) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(_named, query[1]))


# --- index and candidates ---


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """block, trigram, ids: the inverted index of the trigrams that are asked for."""
    block = F.floor(F.col("doc_id") / BLOCK)
    # an array of one, so that a text is lower-cased once for all trigrams
    has = F.element_at(F.transform(F.array(F.lower(text_or_empty())), lambda low: F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(low, t))), 1)
    # outer, as a plain explode is optimised into a filter that computes the array once more
    rows = docs.filter("doc_id is not null").select(block.alias("block"), "doc_id", F.explode_outer(has).alias("trigram")).filter("trigram is not null")
    return rows.groupBy("block", "trigram").agg(F.collect_set("doc_id").alias("ids"))


def _evaluate(query: object) -> Column:
    """The ids of a block that fulfil a query, from its map of posting lists."""
    if isinstance(query, str):
        return F.coalesce(F.element_at("lists", F.lit(query)), F.expr("cast(array() as array<bigint>)"))
    parts = [_evaluate(q) for q in sorted(query[1], key=repr)]
    return reduce(F.array_intersect if query[0] == "and" else F.array_union, parts)


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """id and kinds for which the index can't rule a document out; only rules with mandatory trigrams."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    index = postings(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), sorted(set().union(*map(_named, queries.values()))))
    lists = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "ids"))).alias("lists"))
    found = lists.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), _evaluate(q).alias("ids")) for k, q in queries.items()])).alias("x"))
    return found.select("x.kind", F.explode("x.ids").alias("_cid")).groupBy("_cid").agg(F.collect_set("kind").alias("_kinds"))


def _spans(text: Column, rule: Rule) -> Column:
    """Spans of one rule: the pieces between matches give the offsets."""
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    tests = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else F.expr("cast(null as array<string>)")
    found = F.struct(F.split(text, rule.pattern, -1).alias("pieces"), hits.alias("hits"), tests.alias("tests"))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,value:int>>)").alias("out"))

    def step(s: Column, x: Column) -> Column:
        begin, end = s["at"] + x["gap"], s["at"] + x["gap"] + x["len"]
        span = F.array(F.struct(begin.alias("start"), end.alias("end"), (end - x["test"]).alias("value")))  # what is tested ends the match
        return F.struct(end.alias("at"), F.when(x["test"] >= rule.least, F.concat(s["out"], span)).otherwise(s["out"]).alias("out"))

    def walk(x: Column) -> Column:
        lengths = [F.transform(F.slice(x["pieces"], 1, F.size(x["hits"])), F.length).alias("gap"), F.transform(x["hits"], F.length).alias("len"), F.transform(F.coalesce(x["tests"], x["hits"]), F.length).alias("test")]
        return F.aggregate(F.arrays_zip(*lengths), start, step, lambda s: s["out"])

    return F.element_at(F.transform(F.array(found), walk), 1)  # an array of one, so that the regex runs once


def _flagged(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``docs`` with ``_kinds``: for each document, the indexed kinds that need verifying (null: none)."""
    found = cut(candidates(docs, rules))
    few = found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    found = F.broadcast(found) if few else found.hint("shuffle_hash")
    return docs.join(found, docs["doc_id"].cast("long") == found["_cid"], "left").drop("_cid")


def _verify(rule: Rule) -> Column | None:
    if trigram_query(rule.pattern) is None:
        return None
    return F.col("doc_id").isNull() | F.coalesce(F.array_contains("_kinds", rule.kind), F.lit(False))


def _with_spans(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``rows`` (with doc_id and text) with the spans of each rule: _s0, _s1, ..."""
    none = F.expr("cast(array() as array<struct<start:int,end:int,value:int>>)")
    d = _flagged(rows, rules)
    for i, r in enumerate(rules):
        spans, verify = _spans(F.col("text"), r), _verify(r)
        d = d.withColumn(f"_s{i}", spans if verify is None else F.when(verify, spans).otherwise(none))
    return d.drop("_kinds")


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[str, ...] = ("assign", "access", "hex")) -> DataFrame:
    """doc_id, number of spans of each base kind, sha256 of the base spans, and all spans as ``kind:start:end``."""
    d = _with_spans(docs.select("doc_id", text_or_empty().alias("text")), rules).drop("text")
    kinds = F.array(*[F.lit(r.kind) for r in rules])

    def joined(which: list[int]) -> Column:
        tag = lambda i: F.transform(f"_s{i}", lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("rule"), s["end"].alias("end")))
        tagged = F.concat(*map(tag, which))
        return F.array_join(F.transform(F.array_sort(tagged), lambda s: F.concat_ws(":", F.element_at(kinds, s["rule"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    of = {r.kind: i for i, r in enumerate(rules)}
    counts = [F.size(f"_s{of[k]}").cast("long").alias(f"n_{k}") for k in base]
    return d.select("doc_id", *counts, F.sha2(joined([of[k] for k in base]), 256).alias("base_sha256"), joined(list(range(len(rules)))).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret that ``find`` reports masked, and ``n_chars`` (if there) set anew; no row goes.

    Of an assignment only the value is masked; values that overlap get one mask; a null text stays null.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), "doc_id", text_or_empty().alias("text"))
    d = _with_spans(rows, rules)
    values = F.array_sort(F.concat(*[F.transform(f"_s{i}", lambda s: F.struct(s["value"].alias("from"), s["end"].alias("to"))) for i in range(len(rules))]))
    piece = lambda a, b: F.substring(F.col("text"), a + 1, b - a)

    def cover(s: Column, x: Column) -> Column:
        out = F.when(x["from"] >= s["at"], F.concat(s["out"], piece(s["at"], x["from"]), F.lit(mask))).otherwise(s["out"])
        return F.struct(F.greatest(s["at"], x["to"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    masked = F.aggregate("values", start, cover, lambda s: F.concat(s["out"], piece(s["at"], F.length("text"))))
    d = d.withColumn("values", values).withColumn("text", F.when(F.size("values") > 0, masked).otherwise(F.col("row.text")))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return d.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
