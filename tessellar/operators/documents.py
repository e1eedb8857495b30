"""Chunks of hierarchical documents, sections of pages, pair consistency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicon
from ..functions import text as T


def flatten_hierarchy(entries: DataFrame, key: str, path: str, text: str, heading: Column | None = None) -> DataFrame:
    """The texts of a document's dotted paths in numeric order, a line each; headings get a mark."""
    line = F.when(heading, F.concat(F.lit("## "), F.col(text))).otherwise(F.col(text)) if heading is not None else F.col(text)
    lines = F.array_sort(F.collect_list(F.struct(T.dotted_key(F.col(path)).alias("o"), line.alias("t"))))
    return entries.groupBy(key).agg(F.array_join(F.transform(lines, lambda x: x["t"]), "\n").alias("text"))


def section_chunks(entries: DataFrame, key: str, path: str, text: str, least: int) -> DataFrame:
    """A chunk per top section; a document whose chunks are all shorter than ``least`` is one chunk, section full."""
    e = entries.withColumn("section", F.split(path, "[.]")[0])
    lines = F.array_sort(F.collect_list(F.struct(T.dotted_key(F.col(path)).alias("o"), F.col(text).alias("t"))))
    chunks = e.groupBy(key, "section").agg(F.array_join(F.transform(lines, lambda x: x["t"]), "\n").alias("text")).filter(F.length("text") >= least)
    whole = flatten_hierarchy(entries, key, path, text).join(chunks.select(key).distinct(), key, "left_anti")
    return chunks.unionByName(whole.select(key, F.lit("full").alias("section"), "text"))


def pack(steps: DataFrame, key: str, pos: str, text: str, size: int) -> DataFrame:
    """``size`` steps a chunk, in order."""
    n = F.floor((F.row_number().over(Window.partitionBy(key).orderBy(pos)) - 1) / size)
    lines = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("o"), F.col(text).alias("t"))))
    return steps.withColumn("chunk", n).groupBy(key, "chunk").agg(F.array_join(F.transform(lines, lambda x: x["t"]), "\n").alias("text"))


def paragraphs_until(rows: DataFrame, key: str, pos: str, text: str, enough: int) -> DataFrame:
    """Leading paragraphs of each document until they have ``enough`` characters; documents that never do are left out."""
    upto = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    r = rows.withColumn("_n", F.length(text)).withColumn("_upto", F.sum("_n").over(upto)).withColumn("_all", F.sum("_n").over(Window.partitionBy(key)))
    return r.filter((F.col("_upto") - F.col("_n") < enough) & (F.col("_all") >= enough)).drop("_n", "_upto", "_all")


def without_tags(html: Column) -> Column:
    """The text of markup."""
    return T.squeeze(F.regexp_replace(T.blank(html), r"<[^>]+>", " "))


def page_sections(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Paragraphs of pages that needn't be well formed: key, pos, text."""
    parts = F.split(F.regexp_replace(T.blank(F.col(html)), r"(?is)<(script|style)\b.*?</\1>", " "), r"(?i)<(?:p|h[1-6]|div|li|br)\b[^>]*>")
    texts = F.filter(F.transform(parts, without_tags), lambda t: t != "")
    return pages.select(key, F.posexplode(texts).alias("pos", "text"))


def first_link(html: Column, own: Column, marker: str, near: int = 2000) -> Column:
    """The first DOI near a marker that isn't the page's own, else the first elsewhere; empty if there is none."""
    dois = lambda t: F.filter(F.regexp_extract_all(t, F.lit(r"10\.[0-9]{4,9}/[^\s\"'<>]+"), F.lit(0)), lambda x: x != T.blank(own))
    at = F.instr(html, marker)
    close = F.substring(html, F.greatest(at - near, F.lit(1)), F.lit(2 * near))
    return F.coalesce(F.when(at > 0, F.get(dois(close), F.lit(0))), F.get(dois(html), F.lit(0)), F.lit(""))


def linked_id(url: Column, prefix: str = "PMC") -> Column:
    """An id of digits after a prefix in a URL; empty if there is none."""
    return F.upper(F.regexp_extract(T.blank(url), f"(?i)({prefix}[0-9]+)", 1))


def consistency(pairs: DataFrame, a: str, b: str, title_a: str, title_b: str, suspect_below: float = 0.15, actions: Sequence[str] = lexicon.ACTIONS, materials: Sequence[str] = lexicon.MATERIALS) -> DataFrame:
    """Overlaps of two texts and titles, and whether all of a pair's overlaps are low."""
    hits = lambda w: T.jaccard(T.lexicon_hits(F.col(a), w), T.lexicon_hits(F.col(b), w))
    wanted = F.array_distinct(F.regexp_extract_all(T.blank(F.col(b)), F.lit("(?iu)" + lexicon.PARAM), F.lit(0)))
    found = F.filter(wanted, lambda p: F.contains(F.lower(T.blank(F.col(a))), F.lower(p)))
    d = pairs.withColumns({"title_sim": T.jaccard(T.token_set(F.col(title_a)), T.token_set(F.col(title_b))), "action_overlap": hits(actions), "material_overlap": hits(materials), "param_coverage": F.when(F.size(wanted) > 0, F.size(found) / F.size(wanted)).otherwise(0.0)})
    low = (F.col("action_overlap") < suspect_below) & (F.col("material_overlap") < suspect_below) & (F.col("param_coverage") < suspect_below)
    return d.withColumn("suspect", low.cast("int"))


def valid_steps(steps: Column, actions: Sequence[str]) -> Column:
    """Of an array of (action, inputs, outputs): those whose action is known and that have inputs or outputs."""
    known = F.array(*map(F.lit, actions))
    return F.filter(steps, lambda s: F.array_contains(known, F.lower(F.trim(s["action"]))) & ((F.size(s["inputs"]) > 0) | (F.size(s["outputs"]) > 0)))


def parsed(c: Column, schema: str) -> Column:
    """JSON of a text, or of its first braces to its last; null where neither is JSON."""
    within = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    is_json = lambda x: F.get_json_object(x, "$").isNotNull()
    return F.when(is_json(c), F.from_json(c, schema)).when(is_json(within), F.from_json(within, schema))


def titled_chunks(entries: DataFrame, key: str, path: str, text: str, title: str, least: int) -> DataFrame:
    """Chunks by top section, with titles: a chunk of the whole document says so."""
    titles = entries.groupBy(key).agg(F.first(title, ignorenulls=True).alias("title"))
    full = F.when(F.col("section") == "full", F.concat(T.blank(F.col("title")), F.lit(" (fallback: full)"))).otherwise(T.blank(F.col("title")))
    return section_chunks(entries, key, path, text, least).join(titles, key).withColumn("title", full)


def unchunked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A document as its only chunk."""
    return docs.select(key, F.lit("full").alias("section"), T.blank(F.col(text)).alias("text"))


def record_id(namespace: str, source: Column, key: Column, kind: str | None = None, part: Column | None = None) -> Column:
    """``namespace::source::key``, and of a chunk ``::kind:part``."""
    base = F.concat_ws("::", F.lit(namespace), source, key.cast("string"))
    return base if part is None else F.when(part.isNull(), base).otherwise(F.concat(base, F.lit(f"::{kind}:"), part.cast("string")))


def own_sections(which: Sequence[str], columns: dict[str, Column]) -> Column:
    """The text of an article's own sections, in a fixed order if ``full`` is asked, else methods, abstract and introduction."""
    names = [k for k in columns if k in lexicon.SECTION_KEYS] if "full" in which else [f"{k}_text" for k in ("methods", "abstract", "intro") if k in which]
    return F.trim(T.assembled(*[columns[n] for n in names if n in columns])) if names else F.lit("")


def own_evidence(docs: DataFrame, key: str, text: str, width: int, step: int, k: int, cut: int) -> DataFrame:
    """key, evidence, preview: the first k windows of a document's own text, for documents that no search helps."""
    windows = F.slice(T.windows(F.col(text), width, step), 1, k)
    rows = docs.filter(T.blank(F.col(text)) != "").select(key, F.posexplode(windows).alias("pos", "t"))
    return rows.select(key, F.concat(F.lit("self:"), (F.col("pos") + 1).cast("string")).alias("evidence"), F.left("t", F.lit(cut)).alias("preview"))


def with_evidence(found: DataFrame, own: DataFrame, key: str) -> DataFrame:
    """Search hits (key, evidence, preview), and own evidence of the documents that have none."""
    hits = found.filter(T.filled(F.col("preview")))
    return hits.unionByName(own.join(hits.select(key).distinct(), key, "left_anti"))


def mean_vectors(segments: DataFrame, key: str, vector: str) -> DataFrame:
    """key, embedding: the mean of a document's segment vectors at unit length; sums of places, no lists of vectors."""
    places = segments.select(key, F.posexplode(vector).alias("at", "x"))
    mean = places.groupBy(key, "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    packed = mean.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("v"))
    return packed.select(key, T.unit_length(F.col("v")).alias("embedding"))
