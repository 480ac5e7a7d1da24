"""Constraint validation of graphs.

A shape frame has one row per constraint: ``shape, target_class, path, component,
value, severity, message``. ``value`` is text; the members of an ``in`` list are joined by U+001F.

``hasValue`` and ``in`` compare whole terms, as ``term`` writes them: an IRI in angle brackets, a literal in quotes
with its datatype or language. A value without such marks is a plain literal.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from govgraph.operators.inference import (
    axioms_of,
    infer_domain,
    infer_range,
    infer_types,
    subclass_closure,
    type_rules,
    with_predicates,
)
from govgraph.operators.triples import RDF_TYPE, TRIPLE, XSD
from govgraph.operators.violations import union_all
from govgraph.session import grown, local_frame, settled, small_join, stored

LIST_SEPARATOR = "\x1f"
COUNT_COMPONENTS = ("minCount", "maxCount", "hasValue")
VALUE_COMPONENTS = (
    "datatype",
    "class",
    "nodeKind",
    "minExclusive",
    "minInclusive",
    "maxInclusive",
    "pattern",
    "in",
)
REPORT = ["severity", "focus_node", "path", "component", "value", "message", "source_shape"]


def term(value: str, kind: str = "literal", datatype: str | None = None, lang: str | None = None) -> str:
    """A term as ``hasValue`` and ``in`` compare it."""
    if kind == "iri":
        return f"<{value}>"
    if kind == "bnode":
        return value if value.startswith("_:") else f"_:{value}"
    if lang:
        return f'"{value}"@{lang.lower()}'
    return f'"{value}"' if datatype in (None, XSD + "string") else f'"{value}"^^<{datatype}>'


def _term_of(value: Column) -> Column:
    """The same for a row's value with its ``o_kind``, ``o_datatype`` and ``o_lang``."""
    text = F.concat(F.lit('"'), value, F.lit('"'))
    typed = F.concat(text, F.lit("^^<"), F.col("o_datatype"), F.lit(">"))
    literal = (
        F.when(F.coalesce(F.col("o_lang"), F.lit("")) != "", F.concat(text, F.lit("@"), F.lower("o_lang")))
        .when(F.coalesce(F.col("o_datatype"), F.lit(XSD + "string")) != XSD + "string", typed)
        .otherwise(text)
    )
    blank = F.when(value.startswith("_:"), value).otherwise(F.concat(F.lit("_:"), value))
    return F.when(F.col("o_kind") == "iri", F.concat(F.lit("<"), value, F.lit(">"))).when(F.col("o_kind") == "bnode", blank).otherwise(literal)


def _asked_term(text: Column) -> Column:
    return F.when(text.rlike('^(<.*>|".*"(@.+|\\^\\^<.*>)?|_:.*)$'), text).otherwise(F.concat(F.lit('"'), text, F.lit('"')))


@dataclass(frozen=True)
class Constraint:
    shape: str
    target_class: str
    path: str
    component: str
    value: str
    severity: str = "Violation"
    message: str | None = None


def shape_frame(spark: SparkSession, constraints: list[Constraint]) -> DataFrame:
    schema = (
        "shape string, target_class string, path string, component string, value string, "
        "severity string, message string"
    )
    rows = [
        (c.shape, c.target_class, c.path, c.component, c.value, c.severity, c.message) for c in constraints
    ]
    return local_frame(spark, rows, schema)


def types_of(triples: DataFrame, supers: DataFrame | None = None) -> DataFrame:
    """``(node, cls)`` with superclasses when the closure is given."""
    direct = triples.filter(F.col("p") == RDF_TYPE).select(F.col("s").alias("node"), F.col("o").alias("cls"))
    if supers is None:
        return direct.distinct()
    wider = small_join(direct.withColumnRenamed("cls", "subclass"), supers, "subclass")
    return direct.unionByName(wider.select("node", F.col("superclass").alias("cls"))).distinct()


def targets(types: DataFrame, shapes: DataFrame) -> DataFrame:
    """``(shape, focus)`` for every instance of a target class, dealt by focus."""
    return _instances(types, shapes).repartition("focus").distinct()


def _instances(types: DataFrame, shapes: DataFrame) -> DataFrame:
    """The same with repeats, where they do no harm."""
    wanted = shapes.select("shape", F.col("target_class").alias("cls")).distinct()
    return small_join(_of_classes(types, wanted), wanted, "cls").select("shape", F.col("node").alias("focus"))


def _of_classes(types: DataFrame, wanted: DataFrame) -> DataFrame:
    """Types of the classes that shapes name (``wanted(cls)``), as literals: they reach the scans, below all shuffles."""
    names = sorted(r[0] for r in wanted.select("cls").distinct().collect() if r[0] is not None)
    return types.filter(F.col("cls").isin(*names)) if names else types.filter(F.lit(False))


def _default_message(component: Column, value: Column) -> Column:
    return F.concat(component, F.lit(" "), F.replace(value, F.lit(LIST_SEPARATOR), F.lit(", ")), F.lit(" is not met"))


def _report(broken: DataFrame) -> DataFrame:
    text = F.coalesce("message", _default_message(F.col("component"), F.col("limit")))
    return broken.select(
        "severity",
        F.col("focus").alias("focus_node"),
        "path",
        "component",
        "value",
        text.alias("message"),
        F.col("shape").alias("source_shape"),
    )


def _facts(triples: DataFrame, shapes: DataFrame) -> DataFrame:
    return _values(with_predicates(triples, shapes, "path"))


def _facts_of(triples: DataFrame, paths: list[str]) -> DataFrame:
    return _values(triples.filter(F.col("p").isin(*paths) if paths else F.lit(False)))


def _values(used: DataFrame) -> DataFrame:
    return used.select(
        F.col("s").alias("focus"), F.col("p").alias("path"), F.col("o").alias("value"), "o_kind", "o_datatype", "o_lang"
    )


def count_violations(triples: DataFrame, types: DataFrame, shapes: DataFrame) -> DataFrame:
    """minCount, maxCount and hasValue; focus nodes without any value are seen too."""
    rows = shapes.filter(F.col("component").isin(*COUNT_COMPONENTS)).withColumnRenamed("value", "limit")
    component, limit = F.col("component"), F.col("limit").try_cast("bigint")
    # What shapes ask for reaches the driver: paths whose values are counted, paths that need one value, required constants.
    counted = (component == "maxCount") | ((component == "minCount") & (limit > 1))
    several = F.max(F.coalesce(counted, F.lit(False))).alias("several")
    paths = rows.filter((component != "hasValue") & F.col("path").isNotNull()).groupBy("path").agg(several).orderBy("path").collect()
    wanted = rows.filter(component == "hasValue").select("path", "limit").dropna().distinct()
    constants = wanted.orderBy("path", "limit").collect()
    # One value is enough where no more are asked for; only the others need be told apart before they are counted.
    single = _facts_of(triples, [r["path"] for r in paths if not r["several"]])
    many = _facts_of(triples, [r["path"] for r in paths if r["several"]]).distinct()
    required = small_join(_facts_of(triples, sorted({r["path"] for r in constants})), wanted, "path")
    present = required.filter(_term_of(F.col("value")) == _asked_term(F.col("limit")))
    none = F.lit(None).cast("string").alias("limit")
    seen = union_all([single.select("focus", "path", none), many.select("focus", "path", none), present.select("focus", "path", "limit")])

    def entry(path: str, constant: str | None) -> Column:
        return (F.col("path") == path) & (F.col("limit").isNull() if constant is None else F.col("limit") == constant)

    # All that is known of a focus node is one row, so it meets its shapes by one dealing; constraints multiply it afterwards.
    entries = [(r["path"], None) for r in paths] + [(r["path"], r["limit"]) for r in constants]
    numbers = [F.count_if(entry(*e)).alias(f"_n{i}") for i, e in enumerate(entries)] or [F.count(F.lit(1)).alias("_n0")]
    found = seen.groupBy("focus").agg(*numbers)
    met_nodes = targets(types, rows).join(found, "focus", "left").select(
        "shape", "focus", F.array(*[F.coalesce(c, F.lit(0)) for c in found.columns if c != "focus"]).alias("_n")
    )
    place = F.lit(None).cast("int")
    for i, (path, constant) in enumerate(entries):
        own = (component == "hasValue") & (F.col("limit") == constant) if constant is not None else component != "hasValue"
        place = F.when(own & (F.col("path") == path), i).otherwise(place)
    asked = small_join(met_nodes, rows.drop("target_class").withColumn("_at", place), "shape")
    n = F.coalesce(F.get("_n", F.col("_at")), F.lit(0))
    met = F.when(component == "minCount", n >= limit).when(component == "maxCount", n <= limit).otherwise(n > 0)
    return _report(asked.filter(~met).withColumn("value", F.lit(None).cast("string")))


def _castable(value: Column, datatype: Column) -> Column:
    return (
        F.when(datatype == XSD + "decimal", value.try_cast("decimal(38,18)").isNotNull())
        .when(datatype == XSD + "integer", value.try_cast("decimal(38,0)").isNotNull())
        .when(datatype == XSD + "dateTime", value.try_cast("timestamp").isNotNull())
        .when(datatype == XSD + "boolean", value.isin("true", "false", "1", "0"))
        .otherwise(F.lit(True))
    )


def value_violations(triples: DataFrame, types: DataFrame, shapes: DataFrame) -> DataFrame:
    """datatype, class, nodeKind, bounds, pattern and in, from one pass over the values."""
    wanted = shapes.filter(F.col("component").isin(*VALUE_COMPONENTS))
    # Values meet the limits where they are read; only those that break one are moved to be looked for among the targets.
    limits = wanted.drop("target_class").withColumnRenamed("value", "limit").distinct()
    rows = small_join(_facts(triples, wanted), limits, "path")
    component, limit, value = F.col("component"), F.col("limit"), F.col("value")
    literal = F.col("o_kind") == "literal"
    number = F.when(literal, value.try_cast("decimal(38,18)"))
    bound = limit.try_cast("decimal(38,18)")
    datatype = F.coalesce("o_datatype", F.lit(XSD + "string"))
    kinds = {"IRI": "iri", "Literal": "literal", "BlankNode": "bnode"}
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    met = (
        F.when(component == "datatype", literal & (datatype == limit) & _castable(value, limit))
        .when(component == "nodeKind", F.col("o_kind") == F.try_element_at(kind, limit))
        .when(component == "minExclusive", number > bound)
        .when(component == "minInclusive", number >= bound)
        .when(component == "maxInclusive", number <= bound)
        .when(component == "pattern", F.rlike(value, limit))
        .when(component == "in", F.array_contains(F.transform(F.split(limit, LIST_SEPARATOR), _asked_term), _term_of(value)))
    )
    plain = rows.filter(component != "class").filter(~F.coalesce(met, F.lit(False)))
    classes = rows.filter(component == "class")
    asked = wanted.filter("component = 'class'").select(F.col("value").alias("cls"))
    members = _of_classes(types, asked).select(F.col("node").alias("value"), F.col("cls").alias("limit"))
    outside = classes.join(members, ["value", "limit"], "left_anti")
    columns = ["severity", "focus", "path", "component", "value", "message", "shape", "limit"]
    # A value stated twice is reported once. The join deals by shape and focus, so that the set needs no further dealing.
    nodes = _instances(types, wanted)
    broken = [f.select(*columns).join(grown(nodes), ["shape", "focus"], "left_semi").select(*columns).distinct() for f in (plain, outside)]
    return _report(union_all(broken))


def validate(
    triples: DataFrame, shapes: DataFrame, axioms: DataFrame | None = None, infer: bool = True
) -> DataFrame:
    """The report rows of all constraints.

    With ``infer`` the class, domain and range rules run first. They add types,
    which can satisfy a class constraint.
    """
    base = triples.select(*TRIPLE)
    # Other classes are neither targets nor asked for by a class constraint.
    asked = shapes.select(F.col("target_class").alias("cls")).unionByName(
        shapes.filter("component = 'class'").select(F.col("value").alias("cls"))
    )
    wanted = sorted(r[0] for r in asked.distinct().collect() if r[0] is not None)
    if infer:
        schema = settled(axioms_of(base) if axioms is None else axioms.select("s", "p", "o"))
        supers = subclass_closure(schema)
        empty = local_frame(schema.sparkSession, [], "p string, q string, flip boolean")
        rules = type_rules(schema, supers, empty)
        types = union_all([
            types_of(base),
            *[
                f.select(F.col("s").alias("node"), F.col("o").alias("cls"))
                for f in (
                    infer_types(base, supers.filter(F.col("superclass").isin(*wanted))),
                    infer_domain(base, rules.filter(F.col("cls").isin(*wanted))),
                    infer_range(base, rules.filter(F.col("cls").isin(*wanted))),
                )
            ],
        ])
    else:
        types = types_of(base)
    # Used for the targets of both passes and for the class constraints. Columns pack better than serialized rows.
    types = stored(types.filter(F.col("cls").isin(*wanted)).distinct(), "types")
    return count_violations(base, types, shapes).unionByName(value_violations(base, types, shapes))


def conforms(report: DataFrame) -> DataFrame:
    """One row: no Violation (Info and Warning are allowed), and rows per severity."""
    return report.agg(
        (F.count_if(F.col("severity") == "Violation") == 0).alias("conforms"),
        F.count_if(F.col("severity") == "Violation").alias("violations"),
        F.count_if(F.col("severity") == "Warning").alias("warnings"),
        F.count_if(F.col("severity") == "Info").alias("infos"),
    )


def first_issues(report: DataFrame, n: int = 250) -> DataFrame:
    """The first issues in a fixed order, for showing."""
    return report.orderBy("source_shape", "focus_node", "path", "component", "value").limit(n)
