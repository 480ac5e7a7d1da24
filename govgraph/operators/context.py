"""What the graph says about a concept or a mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from govgraph.operators.resolve import resolve_terms
from govgraph.operators.triples import (
    ALT_LABEL,
    DEFINITION,
    MAPPING_ID,
    MAPPING_PROPOSAL,
    PREF_LABEL,
    PROPOSAL_STATUS,
    RDF_TYPE,
    RDFS_COMMENT,
    RDFS_LABEL,
    VOCAB,
    labels,
    local_name,
)
from govgraph.operators.violations import union_all
from govgraph.session import grown, salted_join, small_join, stored

# Predicates that describe rather than relate.
LABEL_PREDICATES = (RDF_TYPE, RDFS_LABEL, PREF_LABEL, ALT_LABEL, DEFINITION)
MAPS_TO = VOCAB + "mapsToConcept"
FIELD_NAME = VOCAB + "fieldName"
SOURCE_SYSTEM = VOCAB + "sourceSystem"
DERIVED_RELATION = VOCAB + "derivedRelation"
EVIDENCE = VOCAB + "evidence"
LOCATOR = VOCAB + "locator"
COUNTEREXAMPLE = VOCAB + "counterexample"
RATIONALE = VOCAB + "rationale"
CONFIDENCES = {
    name: VOCAB + "confidence" + name.capitalize()
    for name in ("lexical", "structural", "instance", "provenance")
}
STEP_PREDICATES = (FIELD_NAME, MAPS_TO, DERIVED_RELATION, PROPOSAL_STATUS)
DEFAULT_RATIONALE = "The explanation is derived only from the verified graph."


def concept_cards_for(triples: DataFrame, iris: DataFrame) -> DataFrame:
    """Label, definition and sorted types of the asked concepts (``iris(iri)``)."""
    facts = small_join(triples.withColumnRenamed("s", "iri"), iris.distinct(), "iri")

    def one(predicate: str) -> Column:
        return F.min(F.when(F.col("p") == predicate, F.col("o")))

    types = F.array_sort(
        F.collect_set(F.when((F.col("p") == RDF_TYPE) & (F.col("o_kind") == "iri"), F.col("o")))
    )
    return facts.groupBy("iri").agg(
        F.coalesce(
            one(PREF_LABEL), one(RDFS_LABEL), F.translate(local_name(F.first("iri")), "-_", "  ")
        ).alias("label"),
        F.coalesce(one(DEFINITION), one(RDFS_COMMENT)).alias("definition"),
        types.alias("types"),
    )


def concept_context(triples: DataFrame, iris: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` relations of each asked concept, out and in.

    Order is predicate, subject, object. The rank limit is applied in each map task
    before the shuffle, so a concept that most triples point at is no hot task.
    """
    asked = iris.select("iri").distinct()
    outgoing = small_join(
        triples.filter(~F.col("p").isin(*LABEL_PREDICATES)).withColumn("iri", F.col("s")), asked, "iri"
    )
    incoming = small_join(triples.withColumn("iri", F.col("o")), asked, "iri")
    columns = ["iri", "s", "p", "o", "o_kind"]
    # A triple from a concept to itself is listed in both directions.
    both = union_all([
        outgoing.select(*columns, F.lit("out").alias("direction")),
        incoming.select(*columns, F.lit("in").alias("direction")),
    ])
    order = Window.partitionBy("iri").orderBy("p", "s", "o", "direction")
    # At most ``limit`` rows per asked concept, used for the answer and its labels.
    top = stored(both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit), "context")
    # Only the objects that are shown need a label: a few triples are kept before any is moved.
    shown = top.filter("o_kind = 'iri'").select(F.col("o").alias("s")).distinct()
    names = labels(small_join(triples.filter(F.col("p").isin(PREF_LABEL, RDFS_LABEL)), shown, "s", "left_semi")).select(
        F.col("s").alias("o"), F.col("label").alias("_label")
    )
    fallback = F.translate(local_name(F.col("o")), "-_", "  ")
    return top.join(names, "o", "left").select(
        "iri",
        "rank",
        "direction",
        F.col("s").alias("subject"),
        F.col("p").alias("predicate"),
        F.col("o").alias("object"),
        F.when(F.col("o_kind") == "iri", F.coalesce("_label", fallback)).alias("object_label"),
    )


def term_context(terms: DataFrame, triples: DataFrame, limit: int, column: str = "term") -> DataFrame:
    """The context of the concept that each term resolves to best: ``term, status, iri, score`` and the relations.

    A term without a concept gives one row with status CONCEPT_NOT_FOUND. Terms of one concept share its context, which
    is looked up once.
    """
    best = stored(resolve_terms(terms, triples, limit=1, column=column).select("term", "iri", "score"), "term-concepts")
    found = concept_context(triples, best.select("iri"), limit)
    asked = terms.select(F.col(column).alias("term")).filter("term IS NOT NULL").distinct().join(best, "term", "left")
    status = F.when(F.col("iri").isNull(), "CONCEPT_NOT_FOUND").otherwise("OK")
    return salted_join(asked.withColumn("status", status), found, "iri", "left").select(
        "term", "status", "iri", "score", "rank", "direction", "subject", "predicate", "object", "object_label"
    )


def concept_mappings(triples: DataFrame, iris: DataFrame) -> DataFrame:
    """Mapping proposals that point at the asked concepts, with field, source and status."""
    pointing = small_join(
        triples.filter(F.col("p") == MAPS_TO).select(F.col("s").alias("mapping"), F.col("o").alias("iri")),
        iris.select("iri").distinct(),
        "iri",
    )
    wanted = {"field_name": FIELD_NAME, "source_system": SOURCE_SYSTEM, "status": PROPOSAL_STATUS}
    facts = triples.filter(F.col("p").isin(*wanted.values())).groupBy(F.col("s").alias("mapping")).agg(
        *[F.min(F.when(F.col("p") == p, F.col("o"))).alias(n) for n, p in wanted.items()]
    )
    return pointing.join(facts, "mapping", "left")


def mapping_lookup(triples: DataFrame, ids: DataFrame) -> DataFrame:
    """Asked ids to mapping IRIs: by IRI, local name or mapping id; smallest IRI wins."""
    typed = triples.filter((F.col("p") == RDF_TYPE) & (F.col("o") == MAPPING_PROPOSAL)).select("s")
    named = triples.filter(F.col("p") == MAPPING_ID).select("s", F.col("o").alias("id"))
    names = union_all([
        typed.select("s", F.col("s").alias("id")),
        typed.select("s", local_name(F.col("s")).alias("id")),
        named.join(grown(typed.distinct()), "s", "left_semi"),
    ])
    return small_join(names, ids.select("id").distinct(), "id").groupBy("id").agg(F.min("s").alias("s"))


def explain(triples: DataFrame, ids: DataFrame, facts_shown: int | None = None) -> DataFrame:
    """Ordered explanation steps of the asked ids: ``id, step, statement, evidence_iri``.

    Field, concept, derived relation and status come first, then the evidence with
    its locator. A resource without any of these, mapping or not, gives its facts besides labels and
    types, the first ``facts_shown`` of them where that is given.
    """
    mappings = mapping_lookup(triples, ids)
    rest = ids.select("id").distinct().join(grown(mappings), "id", "left_anti")
    # An id that is no subject finds no facts below, so it needs no look at all subjects here.
    asked = stored(mappings.select("id", "s").unionByName(rest.select("id", F.col("id").alias("s"))), "asked")
    # Steps name their predicates, so only their columns or folders are read.
    facts = small_join(triples.filter(F.col("p").isin(*STEP_PREDICATES, EVIDENCE)), asked, "s")
    kind = F.lit(None).cast("int")
    for i, p in enumerate(STEP_PREDICATES):
        kind = F.when(F.col("p") == p, i).otherwise(kind)
    kind = F.when((F.col("p") == EVIDENCE) & (F.col("o_kind") == "iri"), len(STEP_PREDICATES)).otherwise(kind)
    ranked = stored(facts.withColumn("_kind", kind).filter("_kind IS NOT NULL").select("id", "_kind", "p", "o"), "ranked")
    evidence = ranked.filter(F.col("_kind") == len(STEP_PREDICATES))
    described = triples.filter(F.col("p").isin(PREF_LABEL, RDFS_LABEL, LOCATOR))
    cited = small_join(described, evidence.select(F.col("o").alias("s")).distinct(), "s", "left_semi")

    def one(predicate: str) -> Column:
        return F.min(F.when(F.col("p") == predicate, F.col("o")))

    cards = cited.groupBy("s").agg(F.coalesce(one(PREF_LABEL), one(RDFS_LABEL)).alias("label"), one(LOCATOR).alias("locator"))
    fact_text = F.concat(local_name(F.col("p")), F.lit(" = "), F.col("o"))
    none = F.lit(None).cast("string")
    plain = ranked.filter(F.col("_kind") < len(STEP_PREDICATES)).select(
        "id", "_kind", "p", "o", fact_text.alias("statement"), none.alias("evidence_iri")
    )
    cited_rows = small_join(evidence, cards.withColumnRenamed("s", "o"), "o", "left").select(
        "id",
        "_kind",
        "p",
        "o",
        F.concat(
            F.lit("Evidence: "),
            F.coalesce("label", F.translate(local_name(F.col("o")), "-_", "  ")),
            F.coalesce(F.concat(F.lit(" at "), F.col("locator")), F.lit("")),
        ).alias("statement"),
        F.col("o").alias("evidence_iri"),
    )
    steps = plain.unionByName(cited_rows)
    # Only resources without steps are looked up in the whole graph.
    bare = stored(asked.join(grown(ranked.select("id").distinct()), "id", "left_anti"), "bare")
    first = Window.partitionBy("id").orderBy("p", "o")
    other = ~F.col("p").isin(*STEP_PREDICATES, RDF_TYPE, RDFS_LABEL, PREF_LABEL)
    told = small_join(triples.filter(other).select("s", "p", "o"), bare, "s")
    if facts_shown is not None:
        told = told.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= facts_shown)
    others = (
        told.select(
            "id", F.lit(9).alias("_kind"), "p", "o", fact_text.alias("statement"), none.alias("evidence_iri")
        )
    )
    return _numbered(steps.unionByName(others), "id", ["_kind", "p", "o"]).select(
        "id", "step", "statement", "evidence_iri"
    )


def _numbered(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Number the rows of each key in order, without gathering a key in one task.

    Rows are cut into ordered ranges and stored. Each range numbers its own rows and
    adds how many rows of the key lie in the ranges before it.
    """
    ranged = df.repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id())
    kept = stored(ranged, "steps")
    counts = kept.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_n"))
    # One row per key and range it touches.
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(key, "_range").orderBy(*order)
    numbered = kept.withColumn("_local", F.row_number().over(inside))
    return numbered.join(grown(offsets), [key, "_range"]).withColumn(
        "step", (F.col("_offset") + F.col("_local")).cast("int")
    )


def explanation_cards(triples: DataFrame, ids: DataFrame) -> DataFrame:
    """Label, rationale, confidences and number of counterexamples of the asked ids."""
    facts = small_join(triples, mapping_lookup(triples, ids), "s")

    def one(predicate: str) -> Column:
        return F.min(F.when(F.col("p") == predicate, F.col("o")))

    scores = [one(p).try_cast("decimal(9,4)").alias(f"confidence_{n}") for n, p in CONFIDENCES.items()]
    return facts.groupBy("id", "s").agg(
        F.coalesce(one(PREF_LABEL), one(RDFS_LABEL)).alias("_label"),
        F.coalesce(one(RATIONALE), one(DEFINITION), F.lit(DEFAULT_RATIONALE)).alias("rationale"),
        *scores,
        F.count_if(F.col("p") == COUNTEREXAMPLE).alias("counterexamples"),
    ).select(
        "id",
        F.col("s").alias("iri"),
        F.coalesce("_label", F.translate(local_name(F.col("s")), "-_", "  ")).alias("label"),
        "rationale",
        *[f"confidence_{n}" for n in CONFIDENCES],
        "counterexamples",
    )


# Words that route a question, tried from top to bottom; every list of
# a row must have a word in the text.
ROUTES = (
    ("CQ-004", (("cif_no",),)),
    ("CQ-005", (("ubo",), ("impact", "delete", "delet", "elimin"))),
    ("CQ-003", (("duplicate", "duplicad"),)),
    ("CQ-002", (("payment", "pago", "transfer"), ("sanction", "sancion", "beneficial", "ubo"))),
    ("CQ-001", (("account", "cuenta"), ("sanction", "sancion", "beneficial", "ubo"))),
)


def route_questions(df: DataFrame, column: str) -> DataFrame:
    """Question id per free text and OK or ABSTAINED where no route fits."""
    text = F.lower(F.coalesce(F.col(column), F.lit("")))
    route = F.lit(None).cast("string")
    for question, groups in reversed(ROUTES):
        fits = F.lit(True)
        for words in groups:
            fits = fits & text.rlike("|".join(words))
        route = F.when(fits, question).otherwise(route)
    return df.withColumn("question_id", route).withColumn(
        "status", F.when(F.col("question_id").isNull(), "ABSTAINED").otherwise("OK")
    )
