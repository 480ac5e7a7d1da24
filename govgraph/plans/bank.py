"""The given tables as a bank graph.

Region ASIA is a sanctions entry, nations are parties, customers are legal entities,
orders are accounts and line items are payments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govgraph.operators import context as c
from govgraph.operators.triples import (
    ALT_LABEL,
    DEFINITION,
    MAPPING_ID,
    MAPPING_PROPOSAL,
    OWL_THING,
    PREF_LABEL,
    PROPOSAL_STATUS,
    RDF_TYPE,
    RESOURCE,
    VOCAB,
    XSD_DECIMAL,
    Mapping,
    rows_to_triples,
)
from govgraph.operators.violations import union_all
from govgraph.plans import questions as q
from govgraph.plans.registry import table
from govgraph.session import salted_join

SANCTION = RESOURCE + "sanction-{r_regionkey}"
PARTY = RESOURCE + "party-{n_nationkey}"
ENTITY = RESOURCE + "entity-{c_custkey}"
ACCOUNT = RESOURCE + "account-{o_orderkey}"
PAYMENT_ID = RESOURCE + "payment-{l_orderkey}-{l_linenumber}-{l_partkey}-{l_suppkey}"


def payments(spark: SparkSession, sf: str) -> DataFrame:
    """Line items; a supplier divisible by three leaves the beneficiary unknown."""
    known = F.when(F.col("l_suppkey") % 3 != 0, F.col("l_suppkey"))
    return table(spark, sf, "lineitem").withColumn("beneficiary", known)


def bank_graph(spark: SparkSession, sf: str) -> DataFrame:
    """All triples of the bank as a view; nothing is computed until a pattern asks."""
    regions = table(spark, sf, "region").filter("r_name = 'ASIA'")
    entity_of_order = RESOURCE + "entity-{o_custkey}"
    return union_all([
        rows_to_triples(regions, [Mapping(SANCTION, RDF_TYPE, iri=q.SANCTIONS_ENTRY)]),
        rows_to_triples(
            table(spark, sf, "nation"),
            [
                Mapping(RESOURCE + "sanction-{n_regionkey}", q.TARGETS_PARTY, iri=PARTY),
                Mapping(PARTY, RDF_TYPE, iri=VOCAB + "Party"),
                Mapping(PARTY, PREF_LABEL, column="n_name", lang="en"),
            ],
        ),
        rows_to_triples(
            table(spark, sf, "customer"),
            [
                Mapping(RESOURCE + "party-{c_nationkey}", q.BENEFICIAL_OWNER_OF, iri=ENTITY),
                Mapping(ENTITY, RDF_TYPE, iri=VOCAB + "LegalEntity"),
                Mapping(ENTITY, PREF_LABEL, column="c_name", lang="en"),
            ],
        ),
        rows_to_triples(
            table(spark, sf, "orders"),
            [
                Mapping(entity_of_order, q.HAS_ACCOUNT, iri=ACCOUNT),
                Mapping(ACCOUNT, RDF_TYPE, iri=VOCAB + "Account"),
                Mapping(ACCOUNT, VOCAB + "ownedBy", iri=entity_of_order),
                Mapping(ACCOUNT, VOCAB + "accountNumber", column="o_orderkey"),
            ],
        ),
        rows_to_triples(
            payments(spark, sf),
            [
                Mapping(PAYMENT_ID, RDF_TYPE, iri=q.PAYMENT),
                Mapping(PAYMENT_ID, q.FROM_ACCOUNT, iri=RESOURCE + "account-{l_orderkey}"),
                Mapping(PAYMENT_ID, q.TO_ACCOUNT, iri=RESOURCE + "beneficiary-{beneficiary}"),
                Mapping(
                    PAYMENT_ID,
                    q.AMOUNT,
                    column="l_extendedprice",
                    datatype=XSD_DECIMAL,
                    transformation="parse_decimal",
                ),
                Mapping(PAYMENT_ID, q.CURRENCY, column="l_returnflag"),
            ],
        ),
    ])


def text_groups(documents: DataFrame) -> DataFrame:
    """Documents with the hash of their text, runs of white space taken as one blank."""
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    return documents.select("doc_id", "source", "lang", F.sha2(text, 256).alias("text_hash"))


def duplicate_links(hashed: DataFrame) -> DataFrame:
    """Each copy linked to the first document of its text: one link per copy."""
    groups = hashed.groupBy("text_hash").agg(
        F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")
    )
    copies = salted_join(hashed, groups.filter("n > 1").drop("n"), "text_hash")
    return copies.filter("doc_id <> first_id")


def duplicate_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as party records; copies point at the first record of their group."""
    hashed = text_groups(table(spark, sf, "documents"))
    record = RESOURCE + "record-{doc_id}"
    return rows_to_triples(
        hashed,
        [
            Mapping(record, RDF_TYPE, iri=VOCAB + "Party"),
            Mapping(record, c.SOURCE_SYSTEM, column="source"),
            Mapping(record, c.EVIDENCE, iri=RESOURCE + "evidence-{doc_id}"),
        ],
    ).unionByName(
        rows_to_triples(
            duplicate_links(hashed),
            [Mapping(record, q.POSSIBLE_DUPLICATE_OF, iri=RESOURCE + "record-{first_id}")],
        )
    )


def mapping_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as mapping proposals; the orders that use a part depend on its mapping."""
    mapping = RESOURCE + "mapping-{p_partkey}"
    parts = table(spark, sf, "part").withColumn("status", F.lit("HUMAN_REVIEW"))
    lines = table(spark, sf, "lineitem")
    dependency = RESOURCE + "question-{l_orderkey}"
    return union_all([
        rows_to_triples(
            parts,
            [
                Mapping(mapping, RDF_TYPE, iri=MAPPING_PROPOSAL),
                Mapping(mapping, MAPPING_ID, column="p_partkey"),
                Mapping(mapping, c.FIELD_NAME, column="p_type"),
                Mapping(mapping, c.SOURCE_SYSTEM, column="p_brand"),
                Mapping(mapping, PROPOSAL_STATUS, column="status"),
                Mapping(mapping, c.MAPS_TO, iri=VOCAB + "size-{p_size}"),
            ],
        ),
        rows_to_triples(
            lines,
            [
                Mapping(dependency, q.DEPENDS_ON, iri=RESOURCE + "mapping-{l_partkey}"),
                Mapping(dependency, RDF_TYPE, iri=VOCAB + "status-{l_linestatus}"),
                Mapping(dependency, RDF_TYPE, iri=OWL_THING),
            ],
        ),
    ])


def evidence_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as mappings; their line numbers are evidence, return flags counterevidence."""
    mapping = RESOURCE + "mapping-{o_orderkey}"
    orders = table(spark, sf, "orders").select(
        "*",
        F.when(F.col("o_orderkey") % 2 == 0, "0.96").alias("lexical"),
        F.when(F.col("o_orderkey") % 3 == 0, "0.92").alias("structural"),
    )
    lines = table(spark, sf, "lineitem")
    of_line = RESOURCE + "mapping-{l_orderkey}"
    return union_all([
        rows_to_triples(
            orders,
            [
                Mapping(mapping, RDF_TYPE, iri=MAPPING_PROPOSAL),
                Mapping(mapping, MAPPING_ID, column="o_orderkey"),
                Mapping(mapping, c.FIELD_NAME, column="o_orderpriority"),
                Mapping(mapping, c.MAPS_TO, iri=VOCAB + "status-{o_orderstatus}"),
                Mapping(mapping, c.CONFIDENCES["lexical"], column="lexical", datatype=XSD_DECIMAL),
                Mapping(mapping, c.CONFIDENCES["structural"], column="structural", datatype=XSD_DECIMAL),
            ],
        ),
        rows_to_triples(
            lines,
            [
                Mapping(of_line, c.EVIDENCE, iri=RESOURCE + "line-{l_linenumber}"),
                Mapping(of_line, q.COUNTEREVIDENCE, iri=RESOURCE + "flag-{l_returnflag}"),
            ],
        ),
    ])


def concept_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Part names as concepts: one label per name, a second label per name and brand."""
    parts = table(spark, sf, "part")
    named = parts.select(F.replace("p_name", F.lit(" "), F.lit("-")).alias("slug"), "p_name").distinct()
    typed = parts.select(
        F.replace("p_name", F.lit(" "), F.lit("-")).alias("slug"), F.lower("p_type").alias("p_type")
    ).distinct()
    concept = VOCAB + "{slug}"
    return union_all([
        rows_to_triples(
            named,
            [
                Mapping(concept, RDF_TYPE, iri="http://www.w3.org/2004/02/skos/core#Concept"),
                Mapping(concept, PREF_LABEL, column="p_name", lang="en"),
                Mapping(concept, DEFINITION, column="p_name", lang="en"),
            ],
        ),
        rows_to_triples(typed, [Mapping(concept, ALT_LABEL, column="p_type", lang="en")]),
    ])
