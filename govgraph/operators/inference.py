"""Class and property inference.

All rules that chain (subclass of subclass, inverse of symmetric, domain of a
superclass) are closed over the axioms, which are ontology-sized. The data then needs
one join per rule kind, however deep the hierarchy is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govgraph.operators.patterns import path_closure
from govgraph.operators.triples import (
    DOMAIN,
    INVERSE_OF,
    RANGE,
    RDF_TYPE,
    SUBCLASS_OF,
    SYMMETRIC,
    TRIPLE,
    XSD,
)
from govgraph.operators.violations import union_all
from govgraph.session import settled, small_join

# Triples that one task makes a set of, about; a graph has up to as many inferred as stated ones.
PART_ROWS = 500_000

AXIOM_PREDICATES = (SUBCLASS_OF, DOMAIN, RANGE, INVERSE_OF)


def axioms_of(triples: DataFrame) -> DataFrame:
    """The axiom triples of a graph."""
    symmetric = (F.col("p") == RDF_TYPE) & (F.col("o") == SYMMETRIC)
    return triples.filter(F.col("p").isin(*AXIOM_PREDICATES) | symmetric).select("s", "p", "o").distinct()


def with_predicates(triples: DataFrame, declared: DataFrame, column: str = "p") -> DataFrame:
    """Triples of the predicates that rules or shapes declare, as literals.

    The vocabulary is what reaches the driver. A literal lets the scan be pruned to the columns, branches or
    folders of these predicates, where a join would read the whole graph.
    """
    names = sorted(r[0] for r in declared.select(column).distinct().collect() if r[0] is not None)
    return triples.filter(F.col("p").isin(*names)) if names else triples.filter(F.lit(False))


def subclass_closure(axioms: DataFrame) -> DataFrame:
    """Transitive ``(subclass, superclass)`` pairs."""
    pairs = path_closure(axioms.filter(F.col("p") == SUBCLASS_OF).select("s", "o"))
    return pairs.select(F.col("s").alias("subclass"), F.col("o").alias("superclass"))


def property_closure(axioms: DataFrame) -> DataFrame:
    """``(p, q, flip)``: a triple of p gives one of q, with the ends swapped if flip.

    The pair (p, p, false) is left out. A property and its direction is a node; the
    closure of single steps covers any chain of inverse and symmetric properties.
    """
    inverse = axioms.filter(F.col("p") == INVERSE_OF).select(F.col("s").alias("a"), F.col("o").alias("b"))
    symmetric = axioms.filter((F.col("p") == RDF_TYPE) & (F.col("o") == SYMMETRIC)).select(
        F.col("s").alias("a"), F.col("s").alias("b")
    )
    swapped = union_all([inverse, inverse.select(F.col("b").alias("a"), F.col("a").alias("b")), symmetric])

    def node(name: str, flip: int):
        return F.concat(F.lit(f"{flip}|"), F.col(name))

    steps = union_all([
        swapped.select(node("a", f).alias("s"), node("b", 1 - f).alias("o")) for f in (0, 1)
    ])
    reached = path_closure(steps).filter("s LIKE '0|%'")
    pairs = reached.select(
        F.expr("substr(s, 3)").alias("p"),
        F.expr("substr(o, 3)").alias("q"),
        F.col("o").startswith("1|").alias("flip"),
    ).filter("p <> q OR flip")
    return settled(pairs)


def type_rules(axioms: DataFrame, supers: DataFrame, properties: DataFrame) -> DataFrame:
    """``(p, side, cls)``: a triple of p gives that class to its subject or object.

    Closed over superclasses and over the properties p implies.
    """

    def declared(predicate: str, side: str) -> DataFrame:
        # Ranges that are datatypes give no class.
        rows = axioms.filter((F.col("p") == predicate) & ~F.col("o").startswith(XSD))
        return rows.select(
            F.col("s").alias("p"), F.lit(side).alias("side"), F.col("o").alias("cls")
        )

    direct = declared(DOMAIN, "s").unionByName(declared(RANGE, "o"))
    through = properties.join(direct.withColumnRenamed("p", "q"), "q").select(
        "p",
        F.when(~F.col("flip"), F.col("side"))
        .otherwise(F.when(F.col("side") == "s", "o").otherwise("s"))
        .alias("side"),
        "cls",
    )
    rules = direct.unionByName(through)
    wider = rules.join(supers.withColumnRenamed("subclass", "cls"), "cls").select(
        "p", "side", F.col("superclass").alias("cls")
    )
    return settled(rules.unionByName(wider).distinct())


def _typed(df: DataFrame, subject: str, cls: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        F.col(subject).alias("s"),
        F.lit(RDF_TYPE).alias("p"),
        F.col(cls).alias("o"),
        F.lit("iri").alias("o_kind"),
        none.alias("o_datatype"),
        none.alias("o_lang"),
    )


def infer_types(triples: DataFrame, supers: DataFrame) -> DataFrame:
    """Instances of a subclass are instances of its superclasses."""
    typed = triples.filter(F.col("p") == RDF_TYPE).select("s", F.col("o").alias("subclass"))
    return _typed(small_join(typed, supers, "subclass"), "s", "superclass")


def infer_domain(triples: DataFrame, rules: DataFrame) -> DataFrame:
    """Subjects of a property get its domain classes; ``rules(p, side, cls)``. Rows repeat, as in ``infer_types``.

    The set is made once, by whoever takes the rows: its map tasks combine repeats before the shuffle.
    """
    wanted = rules.filter("side = 's'").select("p", "cls")
    used = with_predicates(triples, wanted).select("s", "p")
    return _typed(small_join(used, wanted, "p"), "s", "cls")


def infer_range(triples: DataFrame, rules: DataFrame) -> DataFrame:
    """Objects of a property that are resources get its range classes. Rows repeat."""
    wanted = rules.filter("side = 'o'").select("p", "cls")
    resources = with_predicates(triples, wanted).filter("o_kind <> 'literal'").select("p", "o")
    return _typed(small_join(resources, wanted, "p"), "o", "cls")


def infer_properties(triples: DataFrame, properties: DataFrame) -> DataFrame:
    """Triples implied by inverse and symmetric properties, both directions."""
    # A literal cannot become a subject, so swapped triples need a resource object.
    resources = with_predicates(triples, properties).filter("o_kind <> 'literal'").select("s", "p", "o", "o_kind")
    joined = small_join(resources, properties, "p")
    none = F.lit(None).cast("string")
    subject_kind = F.when(F.col("s").startswith("_:"), "bnode").otherwise("iri")
    return joined.select(
        F.when(F.col("flip"), F.col("o")).otherwise(F.col("s")).alias("s"),
        F.col("q").alias("p"),
        F.when(F.col("flip"), F.col("s")).otherwise(F.col("o")).alias("o"),
        F.when(F.col("flip"), subject_kind).otherwise(F.col("o_kind")).alias("o_kind"),
        none.alias("o_datatype"),
        none.alias("o_lang"),
    )


def infer_inverse(triples: DataFrame, axioms: DataFrame) -> DataFrame:
    only = axioms.filter(F.col("p") == INVERSE_OF)
    return infer_properties(triples, property_closure(only))


def infer_symmetric(triples: DataFrame, axioms: DataFrame) -> DataFrame:
    only = axioms.filter((F.col("p") == RDF_TYPE) & (F.col("o") == SYMMETRIC))
    return infer_properties(triples, property_closure(only))


def materialize(
    triples: DataFrame, axioms: DataFrame | None = None, max_inferred: int | None = None
) -> DataFrame:
    """The graph with everything the axioms imply, as a set, marked by ``inferred``.

    ``max_inferred`` fails the call when more new triples come out.
    """
    base = triples.select(*TRIPLE)
    schema = settled(axioms_of(base) if axioms is None else axioms.select("s", "p", "o"))
    supers, properties = subclass_closure(schema), property_closure(schema)
    rules = type_rules(schema, supers, properties)
    derived = union_all([
        infer_properties(base, properties),
        infer_domain(base, rules),
        infer_range(base, rules),
        infer_types(base, supers),
    ])
    marked = base.withColumn("inferred", F.lit(False)).unionByName(
        derived.withColumn("inferred", F.lit(True))
    )
    # One aggregation makes the set and lets a stated triple win over an inferred one. Most triples are there once, so they
    # are dealt as they are, into parts whose sets fit in the memory of a task however large the graph is.
    least = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, 2 * base.count() // PART_ROWS)
    result = marked.repartition(parts, *TRIPLE).groupBy(*TRIPLE).agg(F.min("inferred").alias("inferred"))
    if max_inferred is not None:
        found = result.filter("inferred").limit(max_inferred + 1).count()
        if found > max_inferred:
            raise ValueError(f"more than {max_inferred} triples are inferred")
    return result
