"""Rows to triples, graph assembly, labels and evidence coordinates.

A triple frame has ``s, p, o, o_kind`` (iri, literal or bnode), ``o_datatype`` and
``o_lang``, all text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govgraph.operators.violations import union_all
from govgraph.session import scratch_path

# Public vocabulary IRIs and this package's own namespace.
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
RDFS_LABEL = RDFS + "label"
RDFS_COMMENT = RDFS + "comment"
SUBCLASS_OF = RDFS + "subClassOf"
DOMAIN = RDFS + "domain"
RANGE = RDFS + "range"
OWL = "http://www.w3.org/2002/07/owl#"
INVERSE_OF = OWL + "inverseOf"
SYMMETRIC = OWL + "SymmetricProperty"
OWL_THING = OWL + "Thing"
SKOS = "http://www.w3.org/2004/02/skos/core#"
PREF_LABEL = SKOS + "prefLabel"
ALT_LABEL = SKOS + "altLabel"
DEFINITION = SKOS + "definition"
XSD = "http://www.w3.org/2001/XMLSchema#"
XSD_STRING = XSD + "string"
XSD_DECIMAL = XSD + "decimal"
XSD_DATETIME = XSD + "dateTime"
XSD_BOOLEAN = XSD + "boolean"
VOCAB = "urn:govgraph:vocab:"
RESOURCE = "urn:govgraph:resource:"

TRIPLE = ["s", "p", "o", "o_kind", "o_datatype", "o_lang"]


@dataclass(frozen=True)
class Mapping:
    """How one column (or constant) of a row becomes the object of a triple.

    ``subject`` and ``iri`` are templates such as ``urn:x:{id}``. With ``iri`` the
    object is an IRI, else it is the literal value of ``column``. ``transformation``
    is one of ``TRANSFORMATIONS``.
    """

    subject: str
    predicate: str
    column: str | None = None
    iri: str | None = None
    datatype: str = XSD_STRING
    transformation: str = "identity"
    lang: str | None = None


# The transformations a mapping may name.
TRANSFORMATIONS = {
    "identity": lambda c: c.cast("string"),
    "trim": lambda c: F.trim(c.cast("string")),
    "uppercase": lambda c: F.upper(c.cast("string")),
    "lowercase": lambda c: F.lower(c.cast("string")),
    "parse_decimal": lambda c: c.cast("decimal(38,2)").cast("string"),
    "parse_iso8601": lambda c: F.date_format(c.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
}


def fill(template: str) -> Column:
    """A template with ``{column}`` parts as a text column; null if any part is."""
    pieces: list[Column] = []
    for i, part in enumerate(template.replace("}", "{").split("{")):
        if i % 2:
            pieces.append(F.col(f"`{part}`").cast("string"))
        elif part:
            pieces.append(F.lit(part))
    return F.concat(*pieces)


def rows_to_triples(df: DataFrame, mappings: list[Mapping]) -> DataFrame:
    """The triples a row set stands for; rows give none where the value is null.

    Each mapping is its own projection with a literal predicate. A pattern that
    names its predicate is therefore answered by the optimizer with a scan of just
    the columns of that mapping, and the graph never has to be materialised.
    """
    frames = []
    for m in mappings:
        if m.iri is not None:
            value, kind, datatype = fill(m.iri), "iri", None
        else:
            value = TRANSFORMATIONS[m.transformation](F.col(f"`{m.column}`"))
            kind, datatype = "literal", None if m.lang else m.datatype
        frames.append(
            df.select(
                fill(m.subject).alias("s"),
                F.lit(m.predicate).alias("p"),
                value.alias("o"),
                F.lit(kind).alias("o_kind"),
                F.lit(datatype).cast("string").alias("o_datatype"),
                F.lit(m.lang).cast("string").alias("o_lang"),
            ).filter("s IS NOT NULL AND o IS NOT NULL")
        )
    return union_all(frames)


def rows_to_triples_once(df: DataFrame, mappings: list[Mapping]) -> DataFrame:
    """The same triples from a single scan, for writing the whole graph out."""
    structs = []
    for m in mappings:
        if m.iri is not None:
            value, kind, datatype = fill(m.iri), "iri", None
        else:
            value = TRANSFORMATIONS[m.transformation](F.col(f"`{m.column}`"))
            kind, datatype = "literal", None if m.lang else m.datatype
        structs.append(
            F.struct(
                fill(m.subject).alias("s"),
                F.lit(m.predicate).alias("p"),
                value.alias("o"),
                F.lit(kind).alias("o_kind"),
                F.lit(datatype).cast("string").alias("o_datatype"),
                F.lit(m.lang).cast("string").alias("o_lang"),
            )
        )
    exploded = df.select(F.explode(F.array(*structs)).alias("t")).select("t.*")
    return exploded.filter("s IS NOT NULL AND o IS NOT NULL")


def merge_graphs(*graphs: DataFrame) -> DataFrame:
    """Union as a set; graph names are dropped."""
    return union_all([g.select(*TRIPLE) for g in graphs]).distinct()


def write_graph(triples: DataFrame, path: str) -> None:
    """Parquet by predicate, so patterns with a constant predicate prune partitions."""
    # Rows of one predicate go to several files: the salt follows the subject.
    salted = triples.withColumn("_salt", F.pmod(F.xxhash64("s"), F.lit(16)))
    (
        salted.repartition("p", "_salt")
        .drop("_salt")
        .sortWithinPartitions("p", "s")
        .write.mode("errorifexists")
        .partitionBy("p")
        .parquet(path)
    )


def read_graph(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*TRIPLE)


def stored_graph(triples: DataFrame) -> DataFrame:
    """The graph written once to the shared folder: for work with many patterns."""
    path = scratch_path(triples.sparkSession, "graph")
    write_graph(triples.select(*TRIPLE), path)
    return read_graph(triples.sparkSession, path)


def local_name(iri: Column) -> Column:
    """The text after the last colon, then slash, then hash."""
    return F.substring_index(
        F.substring_index(F.substring_index(iri, ":", -1), "/", -1), "#", -1
    )


def labels(triples: DataFrame) -> DataFrame:
    """One label per subject: preferred label, else label, else a name from the IRI.

    Where several values exist the smallest is taken.
    """

    def one(predicate: str) -> Column:
        return F.min(F.when(F.col("p") == predicate, F.col("o")))

    by_subject = triples.groupBy("s").agg(one(PREF_LABEL).alias("_a"), one(RDFS_LABEL).alias("_b"))
    return by_subject.select(
        "s", F.coalesce("_a", "_b", F.translate(local_name(F.col("s")), "-_", "  ")).alias("label")
    )


def pick_one(predicate: str) -> tuple[Column, Column]:
    """Smallest and largest value of a predicate: equal when there is exactly one."""
    value = F.when(F.col("p") == predicate, F.col("o"))
    return F.min(value), F.max(value)


# The coordinates of an evidence artifact.
EVIDENCE_FIELDS = {
    "source_id": VOCAB + "sourceId",
    "snapshot_id": VOCAB + "snapshotId",
    "locator": VOCAB + "locator",
    "content_sha256": VOCAB + "contentSha256",
}
EVIDENCE_ARTIFACT = VOCAB + "EvidenceArtifact"


def evidence_coordinates(triples: DataFrame, wanted: DataFrame) -> DataFrame:
    """Coordinates for ``wanted(evidence_iri, position)``, with a status per IRI.

    Status is DUPLICATE_IRI, NOT_EVIDENCE, NOT_EXACTLY_ONE, BAD_SHA256 or OK.
    """
    needed = [RDF_TYPE, *EVIDENCE_FIELDS.values()]
    facts = triples.filter(F.col("p").isin(*needed)).join(
        wanted.select(F.col("evidence_iri").alias("s")).distinct(), "s", "left_semi"
    )
    bounds = []
    for name, predicate in EVIDENCE_FIELDS.items():
        low, high = pick_one(predicate)
        bounds += [low.alias(name), high.alias(f"_{name}")]
    typed = F.max((F.col("p") == RDF_TYPE) & (F.col("o") == EVIDENCE_ARTIFACT)).alias("_typed")
    found = facts.groupBy("s").agg(typed, *bounds).withColumnRenamed("s", "evidence_iri")
    repeats = wanted.groupBy("evidence_iri").agg(
        F.min("position").alias("position"), F.count(F.lit(1)).alias("_n")
    )
    single = F.lit(True)
    for name in EVIDENCE_FIELDS:
        single = single & F.coalesce(F.col(name) == F.col(f"_{name}"), F.lit(False))
    status = (
        F.when(F.col("_n") > 1, "DUPLICATE_IRI")
        .when(~F.coalesce("_typed", F.lit(False)), "NOT_EVIDENCE")
        .when(~single, "NOT_EXACTLY_ONE")
        .when(~F.col("content_sha256").rlike(r"^[0-9a-f]{64}\z"), "BAD_SHA256")
        .otherwise("OK")
    )
    joined = repeats.join(found, "evidence_iri", "left").withColumn("status", status)
    return joined.select("position", "evidence_iri", *EVIDENCE_FIELDS, "status")


MAPPING_PROPOSAL = VOCAB + "MappingProposal"
MAPPING_ID = VOCAB + "mappingId"
PROPOSAL_STATUS = VOCAB + "proposalStatus"


def mapping_states(triples: DataFrame) -> DataFrame:
    """Id and upper-case status per mapping proposal, with a finding where either fails.

    Finding is NOT_ONE_ID, DUPLICATE_ID, NOT_ONE_STATUS or null.
    """
    id_low, id_high = pick_one(MAPPING_ID)
    upper = triples.withColumn(
        "o", F.when(F.col("p") == PROPOSAL_STATUS, F.upper("o")).otherwise(F.col("o"))
    )
    st_low, st_high = pick_one(PROPOSAL_STATUS)
    per_subject = (
        upper.filter(F.col("p").isin(RDF_TYPE, MAPPING_ID, PROPOSAL_STATUS))
        .groupBy("s")
        .agg(
            F.max((F.col("p") == RDF_TYPE) & (F.col("o") == MAPPING_PROPOSAL)).alias("_typed"),
            id_low.alias("mapping_id"),
            id_high.alias("_id_high"),
            st_low.alias("status"),
            st_high.alias("_st_high"),
        )
        .filter("_typed")
    )
    one_id = F.coalesce(F.col("mapping_id") == F.col("_id_high"), F.lit(False))
    # The first subject in IRI order keeps a shared id; the others are duplicates.
    first = (
        per_subject.filter(one_id)
        .groupBy("mapping_id")
        .agg(F.min("s").alias("_first"))
    )
    finding = (
        F.when(~one_id, "NOT_ONE_ID")
        .when(F.col("s") != F.col("_first"), "DUPLICATE_ID")
        .when(~F.coalesce(F.col("status") == F.col("_st_high"), F.lit(False)), "NOT_ONE_STATUS")
    )
    joined = per_subject.join(first, "mapping_id", "left")
    return joined.select(
        "s",
        F.when(one_id, F.col("mapping_id")).alias("mapping_id"),
        F.when(F.col("status") == F.col("_st_high"), F.col("status")).alias("status"),
        finding.alias("finding"),
    )


def graph_health(triples: DataFrame, version: str, publication_state: str) -> DataFrame:
    """Triple count with the version and state the graph is served under."""
    return triples.agg(F.count(F.lit(1)).alias("triple_count")).select(
        "triple_count",
        F.lit(version).alias("ontology_version"),
        F.lit(publication_state).alias("publication_state"),
    )
