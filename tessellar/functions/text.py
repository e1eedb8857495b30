"""Column functions over text, sets and vectors; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon


def blank(c: Column) -> Column:
    """The empty string for null."""
    return F.coalesce(c, F.lit(""))


def or_default(c: Column, default: str) -> Column:
    """``default`` for null or blank."""
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(default))


def first_filled(*cs: Column) -> Column:
    """The first of several columns that isn't null or blank; else the empty string."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cs], F.lit(""))


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores of any script."""
    return F.filter(F.split(F.lower(blank(c)), r"[^\pL\pN_]+"), lambda t: t != "")


def token_set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(tokens(c)))


def ascii_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(blank(c)), F.lit("[a-z0-9]+"), F.lit(0))


def squeeze(c: Column) -> Column:
    """White space runs become a space; ends are trimmed."""
    return F.trim(F.regexp_replace(blank(c), r"[\s ]+", " "))


def title_key(c: Column) -> Column:
    """Titles compared without case, brackets, ampersands and dashes."""
    t = F.regexp_replace(F.replace(F.lower(blank(c)), F.lit("&"), F.lit("and")), r"[-_/]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[\[\]():,]", ""), r"\s+", " "))


def query_text(c: Column) -> Column:
    """A search text without operators and signs of the query language."""
    t = F.regexp_replace(F.regexp_replace(blank(c), r"""["'()*:^{}\[\]<>=!?+~&|\\]""", " "), r"(?i)\b(AND|OR|NOT|NEAR)\b", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def lexicon_hits(c: Column, words: Sequence[str]) -> Column:
    """The words of a lexicon that occur as tokens, sorted."""
    return F.array_sort(F.array_intersect(F.array_distinct(tokens(c)), F.array(*map(F.lit, words))))


def params(c: Column, pattern: str = lexicon.PARAM) -> Column:
    """Array of (value, unit) of a text."""
    p = F.lit("(?iu)" + pattern)
    pairs = F.arrays_zip(F.regexp_extract_all(blank(c), p, F.lit(1)).alias("value"), F.regexp_extract_all(blank(c), p, F.lit(2)).alias("unit"))
    return F.transform(pairs, lambda x: F.struct(x["value"].cast("double").alias("value"), x["unit"].alias("unit")))


def unit(c: Column) -> Column:
    """A unit by its common name."""
    u = F.replace(F.lower(blank(c)), F.lit(" "), F.lit(""))
    names = F.create_map(*[F.lit(x) for kv in lexicon.UNITS.items() for x in kv])
    return F.coalesce(F.element_at(names, u), u)


def steps(c: Column, least: int = 20) -> Column:
    """Sentences of each line that have at least ``least`` characters."""
    parts = F.flatten(F.transform(F.split(blank(c), r"\n"), lambda x: F.split(x, r"(?<=[.:;])\s+(?=[A-Z0-9(])")))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda s: F.length(s) >= least)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 for two empty ones."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; 0 where undefined."""
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit_length(v: Column, eps: float = 1e-12) -> Column:
    norm = F.sqrt(dot(v, v)) + eps
    return F.transform(v, lambda x: x / norm)


def dotted_key(c: Column) -> Column:
    """Sorts dotted keys by number: 1 < 1.2 < 1.10 < 2."""
    return F.transform(F.split(c, "[.]"), lambda p: F.when(p.rlike("^[0-9]+$"), F.lpad(p, 12, "0")).otherwise(F.concat(F.lit("~"), p)))


def windows(c: Column, width: int, step: int) -> Column:
    """Character windows; a text no longer than ``width`` is its only window."""
    t = blank(c)
    starts = F.sequence(F.lit(0), F.greatest(F.length(t) - 1, F.lit(0)), F.lit(step))
    return F.when(F.length(t) <= width, F.array(t)).otherwise(F.transform(starts, lambda i: F.substring(t, i + 1, F.lit(width))))


def host(c: Column) -> Column:
    return F.lower(F.regexp_extract(blank(c), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))


def unit_tokens(c: Column) -> Column:
    """Lower-cased runs of letters, digits and the signs that numbers and units have."""
    return F.regexp_extract_all(F.lower(blank(c)), F.lit(r"[a-z0-9+\-./%°µ]+"), F.lit(0))


def title_tokens(c: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased."""
    return F.transform(F.regexp_extract_all(blank(c), F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)


def doi_tail(url: Column) -> Column:
    """What follows the resolver's host in a DOI link, lower-cased; empty without it."""
    u = F.lower(blank(url))
    return F.when(F.contains(u, F.lit("doi.org/")), F.substring_index(u, "doi.org/", -1)).otherwise("")


def numbered_id(c: Column, before: str, prefix: str) -> Column:
    """``prefix`` and the digits that end a text after ``before`` (a pattern); empty if there are none."""
    digits = F.regexp_extract(blank(c), before + r"([0-9]+)$", 1)
    return F.when(digits != "", F.concat(F.lit(prefix), digits)).otherwise("")


def last_number(c: Column) -> Column:
    """The digits that end a text as a number; -1 if there are none, or too many for a long."""
    return F.coalesce(F.nullif(F.regexp_extract(blank(c), "([0-9]+)$", 1), F.lit("")).try_cast("long"), F.lit(-1).cast("long"))


def scaled_params(c: Column, units: bool = True) -> Column:
    """Array of (value, unit): numbers with a unit and perhaps a power of ten, ``1.5 x 10^3 ml``; units by their common names.

    With ``units`` off the unit is empty, or the power's digits, and values alone are compared.
    """
    pattern = F.lit("(?iu)" + lexicon.SCALED_PARAM)
    part = lambda i: F.regexp_extract_all(blank(c), pattern, F.lit(i))
    rows = F.arrays_zip(part(1).alias("value"), part(2).alias("power"), part(3).alias("unit"))
    power = lambda x: F.when(x["power"] == "", 1.0).otherwise(F.pow(F.lit(10.0), x["power"].try_cast("int")))
    return F.transform(rows, lambda x: F.struct((x["value"].cast("double") * power(x)).alias("value"), (unit(x["unit"]) if units else x["power"]).alias("unit")))


def param_strings(c: Column) -> Column:
    """The distinct strings of a number and a unit, lower-cased; a unit may be the start of a longer word."""
    return F.array_distinct(F.transform(F.regexp_extract_all(blank(c), F.lit("(?iu)" + lexicon.LOOSE_PARAM), F.lit(0)), F.lower))


def procedural(c: Column, actions: Sequence[str] = lexicon.ACTIONS) -> Column:
    """Whether a text has an action anywhere, also inside a word, or a parameter."""
    return F.lower(blank(c)).rlike("|".join(actions)) | blank(c).rlike("(?iu)" + lexicon.PARAM)


def task_lines(c: Column, most: int = 8) -> Column:
    """Of a list in a text: its distinct lines of 2 to 10 words without bullets and numbers, the first ``most``."""
    bare = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(x), r"^(?:- |\* ){0,2}", ""), r"^[0-9. )(]+", ""), r"^[ \-–—\t]+|[ \-–—\t]+$", "")
    words = lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))
    lines = F.transform(F.split(blank(c), r"\r?\n"), bare)
    return F.slice(F.array_distinct(F.filter(lines, lambda x: (words(x) >= 2) & (words(x) <= 10))), 1, most)


def query_lines(c: Column, n: int, ending: str = "protocol", pad: bool = False, default: str | None = None) -> Column:
    """The first n lines of a text without final dots, each ending in ``ending``.

    ``pad`` repeats the first line up to n; ``default`` stands for a text without lines.
    """
    lines = F.filter(F.transform(F.split(blank(c), r"\r?\n"), lambda x: F.regexp_replace(F.trim(x), r"\.+$", "")), lambda x: x != "")
    ended = F.transform(lines, lambda x: F.when(F.lower(x).endswith(ending), x).otherwise(F.concat(x, F.lit(" " + ending))))
    first = F.slice(ended, 1, n)
    if pad:
        first = F.when(F.size(first) > 0, F.slice(F.concat(first, F.array_repeat(F.get(first, F.lit(0)), n)), 1, n)).otherwise(first)
    return F.when(F.size(first) > 0, first).otherwise(F.array(F.lit(default))) if default else first


def keyword_text(c: Column, is_list: bool = False) -> Column:
    """Keywords as one text: a text squeezed, or a list's trimmed items that aren't blank, joined by semicolons."""
    if not is_list:
        return squeeze(c)
    items = F.filter(F.transform(c, lambda x: F.trim(x.cast("string"))), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(F.array_join(items, "; "), F.lit(""))


def filled(c: Column, is_array: bool = False) -> Column:
    """Whether a value is there and isn't the empty text or array."""
    return F.coalesce(F.size(c) > 0 if is_array else c.cast("string") != "", F.lit(False))


def assembled(*cs: Column, between: str = "\n\n") -> Column:
    """The columns that aren't blank, joined."""
    return F.concat_ws(between, *[F.nullif(F.trim(blank(c)), F.lit("")) for c in cs])


def title_matches(c: Column, targets: Sequence[str], mode: str = "contains") -> Column:
    """Whether a normalised title equals, starts with, contains or matches (``regex``) any of the targets."""
    tests = {
        "exact": lambda t: c == F.lit(t),
        "startswith": lambda t: F.startswith(c, F.lit(t)),
        "contains": lambda t: F.contains(c, F.lit(t)),
        "regex": lambda t: c.rlike(t),
    }
    hits = [tests[mode](t) for t in targets]
    return F.coalesce(F.greatest(*hits) if len(hits) > 1 else hits[0], F.lit(False)) if hits else F.lit(False)


def run_date(day: Column | None = None) -> Column:
    """The day of a run, as folders are named by it."""
    return F.date_format(F.current_date() if day is None else day, "yyyy-MM-dd")


def fixed(c: Column, digits: int = 3) -> Column:
    """A number with a fixed number of decimals, as text."""
    return F.format_string(f"%.{digits}f", c.cast("double"))


def is_article(c: Column) -> Column:
    """Whether a text is a whole article element."""
    return F.contains(blank(c), F.lit("<article")) & F.contains(blank(c), F.lit("</article>"))


def snippet(c: Column, terms: Column, width: int = 120, mark: tuple[str, str] = ("[", "]")) -> Column:
    """The part of a text from its first term on, terms marked; from the start where none occurs. ``terms``: an array of words."""
    words = F.array_join(F.transform(terms, lambda t: F.regexp_replace(t, r"([^\pL\pN_])", r"\\$1")), "|")
    pattern = F.concat(F.lit(r"(?iu)\b("), words, F.lit(r")\b"))
    at = F.regexp_instr(blank(c), pattern)
    part = F.substring(blank(c), F.greatest(at, F.lit(1)), F.lit(width))
    return F.when(F.size(terms) > 0, F.regexp_replace(part, pattern, F.lit(mark[0] + "$1" + mark[1]))).otherwise(part)


def long_enough(steps: Column, least: int, is_title: Callable[[Column], Column] | None = None) -> Column:
    """The steps of an array of ``least`` characters, and titles of any length."""
    return F.filter(steps, lambda s: (F.length(s) >= least) | (is_title(s) if is_title else F.lit(False)))
