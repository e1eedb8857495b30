"""Protocol steps as records: reading, cleaning, dependencies, plans and their rendering.

A step (``IR``) is a struct of action, material, value, unit, condition, depends_on, evidence_id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicon
from ..functions import text as T
from ..session import cut
from . import graph

CONDITION = ("speed", "g", "rpm", "time", "temp")
IR = "struct<action:string,material:string,value:double,unit:string,condition:struct<" + ",".join(f"{c}:string" for c in CONDITION) + ">,depends_on:array<int>,evidence_id:string>"


def _or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _record(action: Column, material: Column, value: Column | None = None, unit: Column | None = None, condition: dict[str, Column] | None = None, depends_on: Column | None = None, evidence: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    conditions = F.struct(*[(condition or {}).get(c, none).alias(c) for c in CONDITION])
    fields = [action.alias("action"), _or_null(T.blank(material)).alias("material"), (F.lit(None) if value is None else value).cast("double").alias("value"), (none if unit is None else unit).alias("unit"), conditions.alias("condition")]
    return F.struct(*fields, F.coalesce(F.lit(None) if depends_on is None else depends_on, F.array()).cast("array<int>").alias("depends_on"), (none if evidence is None else evidence).alias("evidence_id")).cast(IR)


def from_text(c: Column, verbs: Sequence[str] = lexicon.VERBS) -> Column:
    """A step from a sentence: a known first word is its action, the rest its material; quantities by patterns. Null for a blank."""
    find = lambda t, pattern, group: F.regexp_extract(t, "(?iu)" + pattern, group)

    def found(t: Column) -> Column:
        first = F.regexp_replace(F.lower(F.regexp_extract(t, r"^(\S+)", 1)), r"^[,.]+|[,.]+$", "")
        parts = {"first": first, "value": find(t, lexicon.VALUE_UNIT, 1), "unit": find(t, lexicon.VALUE_UNIT, 2), "time": find(t, lexicon.TIME, 0), "temp": find(t, lexicon.TEMPERATURE, 0), "rpm": find(t, lexicon.RPM, 1), "g": find(t, lexicon.GRAVITY, 1)}
        return F.struct(t.alias("text"), *[v.alias(k) for k, v in parts.items()])

    def step(x: Column) -> Column:
        t, known = x["text"], x["first"].isin(*verbs)
        rest = T.squeeze(F.regexp_replace(t, r"^\S+", ""))
        condition = {k: _or_null(x[k]) for k in ("time", "rpm", "g")} | {"temp": F.replace(_or_null(x["temp"]), F.lit(" "), F.lit(""))}
        return F.when(t != "", _record(F.when(known, x["first"]).otherwise("step"), F.when(known, rest).otherwise(t), _or_null(x["value"]), _or_null(x["unit"]), condition))

    # the text and what is found in it stand in arrays of one, so that they are made once and then known by a name
    return F.transform(F.transform(F.array(F.trim(T.blank(c))), found), step)[0]


def from_json(c: Column) -> tuple[Column, Column]:
    """A step from JSON, and whether it was coerced: a record with an action as it is, a record or list of subject, predicate
    and object by these, other records by their nearest fields, a text by ``from_text``. Null where there is no step."""
    t, get = F.trim(T.blank(c)), lambda path: F.get_json_object(c, path)
    either = lambda *paths: F.coalesce(*[_or_null(get(x)) for x in paths])
    rest = {"value": get("$.value"), "unit": get("$.unit"), "condition": {k: get(f"$.condition.{k}") for k in CONDITION}, "depends_on": F.from_json(get("$.depends_on"), "array<int>"), "evidence": get("$.evidence_id")}
    is_record, is_list = F.startswith(t, F.lit("{")), F.startswith(t, F.lit("["))
    whole = get("$.action").isNotNull()
    record = _record(F.when(whole, get("$.action")).otherwise(F.lower(F.coalesce(either("$.predicate", "$.verb"), F.lit("step")))), either("$.material", "$.object", "$.target"), **rest)
    triple = _record(F.lower(get("$[1]")), get("$[2]"))
    is_triple = F.json_array_length(F.when(is_list, t)) == 3
    bare = F.when(F.startswith(t, F.lit('"')), F.get_json_object(F.concat(F.lit('{"t":'), t, F.lit("}")), "$.t")).otherwise(t)
    step = F.when(is_record, record).when(is_list, F.when(is_triple, triple)).otherwise(from_text(bare))
    return step, step.isNotNull() & ~(is_record & whole)


def collected(items: DataFrame, key: str, pos: str, json: str) -> tuple[DataFrame, DataFrame]:
    """key, idx, ir: the steps of each protocol, numbered from 0; and per key how many items were coerced and skipped."""
    step, coerced = from_json(F.col(json))
    rows = items.select(key, pos, step.alias("ir"), coerced.alias("coerced"))
    idx = (F.row_number().over(Window.partitionBy(key).orderBy(pos)) - 1).cast("long")
    counts = rows.groupBy(key).agg(F.count_if("coerced").alias("coerced"), F.count_if(F.col("ir").isNull()).alias("skipped"))
    return rows.filter("ir is not null").select(key, idx.alias("idx"), "ir"), counts


def valid(step: Column, actions: Sequence[str] = lexicon.STEP_ACTIONS) -> Column:
    """Whether a step (action, inputs, outputs, params: map of texts) has a known action that is no heading, and anything to act on."""
    action = F.lower(F.trim(T.blank(step["action"])))
    some = lambda a: F.coalesce(F.exists(a, lambda x: x.isNotNull() & (x != "")), F.lit(False))
    return action.isin(*actions) & ~action.isin(*lexicon.HEADERS) & (some(step["inputs"]) | some(step["outputs"]) | some(F.map_values(step["params"])))


def cleaned(records: DataFrame, steps: str, lists: Sequence[str] = (), edges: str | None = None) -> DataFrame:
    """Invalid steps, blank list items and edges without two ends are dropped; what is left empty is null."""
    keep = lambda a: F.when(F.size(a) > 0, a)
    out = {steps: keep(F.filter(steps, lambda s: valid(s)))}
    out |= {c: keep(F.filter(c, lambda x: x.isNotNull() & (x != ""))) for c in lists}
    if edges:
        out[edges] = keep(F.filter(edges, lambda e: (F.size(e) == 2) & F.forall(e, lambda x: x.isNotNull() & (x != ""))))
    return records.withColumns(out)


# --- categories and dependencies ---


def _action(ir: Column) -> Column:
    return F.lower(F.trim(T.blank(ir["action"])))


def category(ir: Column, preparing: Sequence[str] = (), analysing: Sequence[str] = ()) -> Column:
    """0 for preparing steps, 2 for analysing ones, else 1; the lexicons can be extended."""
    a = _action(ir)
    return F.when(a.isin(*lexicon.PREPARING, *preparing), 0).when(a.isin(*lexicon.ANALYSING, *analysing), 2).otherwise(1)


def dependencies(steps: DataFrame, key: str, preparing: Sequence[str] = (), analysing: Sequence[str] = ()) -> DataFrame:
    """key, u, v: stated dependencies, what prepares a material before what uses it, and earlier categories before later ones."""
    ir, material = F.col("ir"), F.lower(F.trim(T.blank(F.col("ir.material"))))
    made = F.filter(F.array(material), lambda m: (m != "") & (_action(ir).isin(*lexicon.PREPARING, *preparing) | F.startswith(_action(ir), F.lit("prepare"))))
    nodes = steps.select(F.col(key).alias("key"), "idx", category(ir, preparing, analysing).alias("cat"), made.alias("outputs"), F.filter(F.array(material), lambda m: m != "").alias("inputs"), F.col("ir.depends_on").alias("stated"))
    last = nodes.groupBy("key").agg(F.max("idx").alias("last"))
    stated = nodes.select("key", F.explode("stated").alias("u"), F.col("idx").alias("v")).withColumn("u", F.col("u").cast("long")).join(last, "key").filter("u >= 0 and u <= last and u <> v").select("key", "u", "v")
    edges = stated.unionByName(graph.material_edges(nodes)).unionByName(graph.category_edges(nodes)).distinct()
    return edges.withColumnRenamed("key", key)


def ordered(steps: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """key, idx, pos: the steps in an order that keeps all dependencies, stored, as plans and names read it more than once."""
    return cut(graph.topological_order(steps.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), "idx"), edges.withColumnRenamed(key, "key")).withColumnRenamed("key", key))


def relabelled(order: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """key, u, v: edges by the names n1, n2, ... of the nodes in their order."""
    name = lambda c: order.select(key, F.col("idx").alias(c), F.concat(F.lit("n"), (F.col("pos") + 1).cast("string")).alias(f"n{c}"))
    return edges.join(name("u"), [key, "u"]).join(name("v"), [key, "v"]).select(key, F.col("nu").alias("u"), F.col("nv").alias("v"))


# --- rendering ---


def _number(c: Column) -> Column:
    return c.cast("string")


def label(ir: Column) -> Column:
    """A node's text: action, material, quantity and conditions."""
    c = ir["condition"]
    quantity = F.when(ir["value"].isNotNull(), F.concat(F.lit("("), F.concat_ws(" ", _number(ir["value"]), _or_null(ir["unit"])), F.lit(")")))
    marks = {"speed": "", "g": " × g", "rpm": " rpm", "time": "", "temp": ""}
    conditions = F.concat_ws(", ", *[F.concat(_or_null(c[k]), F.lit(end)) for k, end in marks.items()])
    return F.concat_ws(" ", _capital(F.trim(F.coalesce(_or_null(ir["action"]), F.lit("step")))), ir["material"], quantity, _or_null(conditions))


def _capital(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def sentence(ir: Column) -> Column:
    """A step as an instruction."""
    c, action = ir["condition"], F.coalesce(_or_null(_action(ir)), F.lit("step"))
    head = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in lexicon.HEADINGS.items() for x in kv]), action), _capital(action))
    quantity = F.when(ir["value"].isNotNull() & _or_null(ir["unit"]).isNotNull(), F.concat_ws(" ", _number(ir["value"]), ir["unit"]))
    tail = F.concat_ws(", ", *[F.concat(_or_null(c[k]), F.lit(end)) for k, end in {"g": " × g", "rpm": " rpm", "temp": "", "time": ""}.items()])
    timed = F.when(_or_null(c["time"]).isNotNull(), F.concat(F.lit("for "), tail)).otherwise(tail)
    end = F.when(tail == "", F.lit(None)).when(action.isin(*lexicon.TIMED), timed).otherwise(F.concat(F.lit("("), tail, F.lit(")")))
    return F.concat(F.regexp_replace(F.trim(F.concat_ws(" ", head, ir["material"], quantity, end)), r"\.+$", ""), F.lit("."))


def plan(steps: DataFrame, order: DataFrame, protocols: DataFrame, key: str) -> DataFrame:
    """key, sid, title, text, idx: preparation, procedure and analysis in order, titles numbered 1, 2, ..., their steps 1.1, 1.2, ...

    The procedure's title is always there; a protocol of ``protocols`` without steps has all three titles.
    """
    rows = steps.join(order, [key, "idx"]).select(key, category(F.col("ir")).alias("cat"), F.lit(None).cast("string").alias("title"), sentence(F.col("ir")).alias("text"), "idx", "pos")
    none = protocols.select(key).distinct().join(steps.select(key).distinct(), key, "left_anti")
    some = rows.select(key, "cat").unionByName(rows.select(key, F.lit(1).alias("cat"))).distinct().unionByName(none.select(key, F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("cat")))
    titles = F.array(*map(F.lit, lexicon.PLAN_TITLES))
    heads = some.select(key, "cat", F.get(titles, F.col("cat")).alias("title"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("long").alias("idx"), F.lit(-1).cast("long").alias("pos"))
    running = Window.partitionBy(key).orderBy("cat", "pos")
    numbered = heads.unionByName(rows).withColumn("section", F.count("title").over(running))
    within = F.row_number().over(Window.partitionBy(key, "section").orderBy("pos")) - 1
    sid = F.concat_ws(".", F.col("section").cast("string"), F.when(F.col("title").isNull(), within.cast("string")))
    return numbered.select(key, sid.alias("sid"), "title", "text", "idx")


def statistics(protocols: DataFrame, steps: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Per protocol, one without a key included: steps, edges, steps without quantity or condition, and the share of those with."""
    c = F.col("ir.condition")
    valued = F.col("ir.value").isNotNull() | F.greatest(*[T.filled(c[k]) for k in CONDITION])
    counted = lambda df, **of: df.select(key, *[of.get(c, F.lit(0)).cast("long").alias(c) for c in ("asked", "n", "valued", "edges")])
    one = F.lit(1)
    rows = counted(protocols, asked=one).unionByName(counted(steps, n=one, valued=valued)).unionByName(counted(edges, edges=one))
    sums = rows.groupBy(key).agg(F.max("asked").alias("asked"), F.sum("n").alias("num_ir"), F.sum("valued").alias("valued"), F.sum("edges").alias("num_edges")).filter("asked = 1")
    share = F.round(F.col("valued") / F.greatest("num_ir", F.lit(1)), 4)
    return sums.select(key, "num_ir", "num_edges", (F.col("num_ir") - F.col("valued")).alias("unresolved"), share.alias("pct_with_values"))


def hierarchy(materials: Column, solutions: Column, steps: Column) -> Column:
    """Materials, solutions and steps as dotted paths and lines, in order: an array of (path, line).

    Of materials (name, concentration, amount, catalog, supplier), solutions (name, recipe of name and amount) and steps
    (action, reagent, params: map), quantities being (value, unit) of texts.
    """
    amount = lambda q: F.concat(q["value"], T.blank(q["unit"]))
    told = lambda mark, c: T.blank(F.concat(F.lit(mark), _or_null(c)))
    material = lambda m: F.concat(F.trim(F.concat(F.lit("Prepare "), T.blank(m["name"]))), T.blank(F.concat(F.lit(" ("), amount(m["concentration"]), F.lit(")"))), T.blank(F.concat(F.lit(", amount "), amount(m["amount"]))), told(", Catalog: ", m["catalog"]), told(", Supplier: ", m["supplier"]))
    part = lambda x: F.concat(F.lit(" - Add "), T.blank(x["name"]), F.lit(": "), F.coalesce(x["amount"]["value"], F.lit("None")), T.blank(x["amount"]["unit"]))
    none = F.array().cast("array<string>")
    solution = lambda x: F.concat(F.array(F.concat(F.lit("Prepare solution: "), T.blank(x["name"]))), F.coalesce(F.transform(x["recipe"], part), none))
    kinds = ("time", "temperature", "volume", "speed", "g", "concentration")
    bits = lambda x: F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), amount(F.element_at(x["params"], F.lit(k)))) for k in kinds])
    step = lambda x: F.trim(F.concat(F.concat_ws(" ", F.coalesce(x["action"], F.lit("Do")), _or_null(x["reagent"])), F.when(bits(x) != "", F.concat(F.lit(" ("), bits(x), F.lit(")"))).otherwise("")))
    lines = lambda items, f: F.coalesce(F.transform(items, f), none)
    first = F.concat(lines(materials, material), F.flatten(F.coalesce(F.transform(solutions, solution), F.array(none))))
    section = lambda n, title, rows: F.concat(F.array(F.struct(F.lit(str(n)).alias("path"), F.lit(title).alias("line"))), F.transform(rows, lambda x, i: F.struct(F.concat(F.lit(f"{n}."), (i + 1).cast("string")).alias("path"), x.alias("line"))))
    return F.concat(section(1, lexicon.PLAN_TITLES[0], first), section(2, lexicon.PLAN_TITLES[1], lines(steps, step)))


def or_minimal(text: Column, title: Column) -> Column:
    """A protocol's text, or a minimal one of its title."""
    return F.coalesce(_or_null(F.trim(T.blank(text))), F.concat(F.lit(lexicon.PLAN_TITLES[1] + "\n"), T.blank(title)))
