"""Sections of articles in XML: each article is parsed once, all choices are column expressions over its parts."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as st
from pyspark.sql.window import Window

from ..functions import lexicon
from ..functions import text as T
from .documents import paragraphs_until

#: Elements whose text isn't the section's.
ASIDE = ("table-wrap", "fig", "caption")
#: Articles, and characters of XML, whose parts are held at a time.
ARTICLES, CHARS = 256, 1 << 20
SECTION = st.StructType([st.StructField(n, st.StringType()) for n in ("type", "title", "text", "merged")])
PARTS = (
    st.StructType()
    .add("error", st.StringType())
    .add("has_body", st.BooleanType())
    .add("sections", st.ArrayType(SECTION))
    .add("paragraphs", st.ArrayType(st.StringType()))
    .add("title", st.StringType())
    .add("journal", st.StringType())
    .add("year", st.StringType())
    .add("doi", st.StringType())
)


def _name(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def _text(e: ET.Element | None, aside: Sequence[str] = ()) -> str:
    """The words of an element, without those of the elements named in ``aside`` and what follows these directly.

    Elements may be nested to any depth: those that are open stand in a list.
    """
    if e is None:
        return ""
    out, open_ = [e.text or ""], [iter(e)]
    tails = [""]
    while open_:
        child = next(open_[-1], None)
        if child is None:
            open_.pop()
            out.append(tails.pop())
        elif _name(child) not in aside:
            if isinstance(child.tag, str):
                out.append(child.text or "")
                open_.append(iter(child))
                tails.append(child.tail or "")
            else:
                out.append(child.tail or "")
    return " ".join("".join(out).split())


def _parts(xml: str | None) -> dict:
    """The parts of an article; of a text that isn't XML, the error."""
    try:
        root = ET.fromstring(xml or "")
    except (ET.ParseError, RecursionError, MemoryError) as e:  # whatever the parser meets belongs to its article
        return {"error": str(e), "has_body": False, "sections": [], "paragraphs": []}
    every = [(e, _name(e)) for e in root.iter()]
    first = lambda name: next((e for e, n in every if n == name), None)
    sections = []
    for e in (e for e, n in every if n == "sec"):
        own = [x for x in e if _name(x) == "p"]
        below = [p for sub in e.iter() if _name(sub) == "subsec" for p in sub if _name(p) == "p"]
        title = next((x for x in e if _name(x) == "title"), None)
        merged = " ".join(t for t in (_text(p, ASIDE) for p in own + below) if t)
        sections.append({"type": (e.get("sec-type") or "").strip().lower(), "title": _text(title), "text": _text(e, ASIDE), "merged": merged})
    body = first("body")
    dates = (y for e, n in every if n == "pub-date" for y in e if _name(y) == "year")
    doi = next((e for e, _ in every if e.get("pub-id-type") == "doi"), None)
    paragraphs = [] if body is None else [t for t in (_text(p) for p in body.iter() if _name(p) == "p") if t]
    meta = {"title": _text(first("article-title")), "journal": _text(first("journal-title")), "year": _text(next(dates, None)), "doi": _text(doi)}
    return {"error": None, "has_body": body is not None, "sections": sections, "paragraphs": paragraphs} | meta


def parsed(articles: DataFrame, key: str, xml: str) -> DataFrame:
    """key, blocked, and the parts of each article: error, has_body, sections, paragraphs, title, journal, year, doi."""
    blocked = F.lower(T.blank(F.col(xml))).rlike("(?s)<!--(?:(?!-->).)*" + lexicon.BLOCKED)
    rows = articles.select(key, blocked.alias("blocked"), F.col(xml).alias("xml"))
    schema = st.StructType([*rows.schema.fields[:2], *PARTS.fields])
    arrow = pa.struct([pa.field("error", pa.string()), pa.field("has_body", pa.bool_()), pa.field("sections", pa.list_(pa.struct([pa.field(n, pa.string()) for n in SECTION.names]))), pa.field("paragraphs", pa.list_(pa.string())), *[pa.field(n, pa.string()) for n in ("title", "journal", "year", "doi")]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < len(batch):  # the parts of some articles are held at a time, however many come at once
                few, size = [], 0
                while at + len(few) < len(batch) and len(few) < ARTICLES and size < CHARS:
                    xml = batch.column(2)[at + len(few)].as_py()
                    few.append(_parts(xml))
                    size += len(xml or "")
                found, part = pa.array(few, arrow), batch.slice(at, len(few))
                at += len(few)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *found.flatten()], names=schema.names)

    return rows.mapInArrow(work, schema)


def _wanted(section: Column, targets: Sequence[str], types: Sequence[str], mode: str) -> Column:
    title = T.title_key(section["title"])
    by_type = section["type"].isin(*types) if types else F.lit(False)
    return by_type | ((title != "") & T.title_matches(title, targets, mode))


def sections(parts: DataFrame, key: str, targets: Sequence[str], types: Sequence[str], mode: str = "contains", least: int = 160, merge: int = 220, heuristic: int = 300) -> DataFrame:
    """key, section, text, source: the wanted sections of each article.

    Regular ones are whole sections of ``least`` characters, by type or title. Sections whose own and sub-section paragraphs
    have ``merge`` characters fill titles that are still missing. An article with neither has its leading procedural
    paragraphs, up to ``heuristic`` characters, if there are as many. Of equal titles the last section counts.
    """
    rows = parts.select(key, F.posexplode("sections").alias("pos", "s")).filter(_wanted(F.col("s"), targets, types, mode))
    named = lambda default: F.coalesce(F.nullif(F.col("s.title"), F.lit("")), F.nullif(F.col("s.type"), F.lit("")), F.lit(default))
    regular = rows.filter(F.length("s.text") >= least).select(key, named("UNTITLED").alias("section"), F.col("s.text").alias("text"), F.lit("regular").alias("source"), "pos")
    merged = rows.filter(F.length("s.merged") >= merge).select(key, named("MERGED_SECTION").alias("section"), F.col("s.merged").alias("text"), F.lit("merged").alias("source"), "pos")
    order = Window.partitionBy(key, "section").orderBy(F.desc("source"), F.desc("pos"))
    found = regular.unionByName(merged).withColumn("_n", F.row_number().over(order)).filter("_n = 1").select(key, "section", "text", "source")
    lone = parts.join(found.select(key).distinct(), key, "left_anti")
    steps = lone.select(key, F.posexplode("paragraphs").alias("pos", "text")).filter(T.procedural(F.col("text")))
    kept = paragraphs_until(steps, key, "pos", "text", heuristic).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("kept"))
    text = F.array_join(F.transform("kept", lambda x: x["text"]), "\n\n")
    return found.unionByName(kept.select(key, F.lit("Heuristic Methods").alias("section"), text.alias("text"), F.lit("heuristic").alias("source")))


def outcomes(parts: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """key, result: ok, or why an article has no sections: not XML, blocked by its publisher, no body, none matched."""
    has = found.select(key).distinct().withColumn("_ok", F.lit(True))
    result = F.when(F.col("error").isNotNull(), "parse_error").when(F.col("_ok"), "ok").when(F.col("blocked"), "publisher_blocked_xml").when(~F.col("has_body"), "no_body").otherwise("no_sections_matched")
    return parts.join(has, key, "left").select(key, result.alias("result"))


def statistics(found: DataFrame, key: str) -> DataFrame:
    """key, section, source, chars, tokens of each section."""
    return found.select(key, "section", "source", F.length("text").cast("long").alias("chars"), F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")).cast("long").alias("tokens"))
