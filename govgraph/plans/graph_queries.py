"""Registered queries: triples, patterns, questions, context."""

from __future__ import annotations

from pyspark.sql import functions as F

from govgraph.operators import context, patterns, resolve, triples
from govgraph.operators.triples import PREF_LABEL, RDF_TYPE, RESOURCE, VOCAB
from govgraph.plans import bank, questions
from govgraph.plans.registry import registered, table
from govgraph.plans.resolution import resolution_sql
from govgraph.session import local_frame

R, V = RESOURCE, VOCAB

# The bank graph in SQL, one branch per predicate that the queries below use.
BANK = f"""
WITH graph AS MATERIALIZED (
  SELECT '{R}sanction-' || r_regionkey AS s, '{RDF_TYPE}' AS p, '{V}SanctionsEntry' AS o, 'iri' AS o_kind FROM region WHERE r_name = 'ASIA'
  UNION SELECT '{R}sanction-' || n_regionkey, '{V}targetsParty', '{R}party-' || n_nationkey, 'iri' FROM nation
  UNION SELECT '{R}party-' || n_nationkey, '{RDF_TYPE}', '{V}Party', 'iri' FROM nation
  UNION SELECT '{R}party-' || n_nationkey, '{PREF_LABEL}', n_name, 'literal' FROM nation
  UNION SELECT '{R}party-' || c_nationkey, '{V}beneficialOwnerOf', '{R}entity-' || c_custkey, 'iri' FROM customer
  UNION SELECT '{R}entity-' || c_custkey, '{RDF_TYPE}', '{V}LegalEntity', 'iri' FROM customer
  UNION SELECT '{R}entity-' || c_custkey, '{PREF_LABEL}', c_name, 'literal' FROM customer
  UNION SELECT '{R}entity-' || o_custkey, '{V}hasAccount', '{R}account-' || o_orderkey, 'iri' FROM orders
  UNION SELECT '{R}account-' || o_orderkey, '{RDF_TYPE}', '{V}Account', 'iri' FROM orders
  UNION SELECT '{R}account-' || o_orderkey, '{V}ownedBy', '{R}entity-' || o_custkey, 'iri' FROM orders
  UNION SELECT '{R}account-' || o_orderkey, '{V}accountNumber', CAST(o_orderkey AS VARCHAR), 'literal' FROM orders
  UNION SELECT '{R}payment-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey, '{RDF_TYPE}', '{V}Payment', 'iri' FROM lineitem
  UNION SELECT '{R}payment-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey, '{V}fromAccount', '{R}account-' || l_orderkey, 'iri' FROM lineitem
  UNION SELECT '{R}payment-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey, '{V}toAccount', '{R}beneficiary-' || l_suppkey, 'iri' FROM lineitem WHERE l_suppkey % 3 <> 0
  UNION SELECT '{R}payment-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey, '{V}amount', CAST(CAST(l_extendedprice AS DECIMAL(38,2)) AS VARCHAR), 'literal' FROM lineitem
  UNION SELECT '{R}payment-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey, '{V}currency', l_returnflag, 'literal' FROM lineitem
)
"""


@registered(
    "rows_to_triples",
    f"""SELECT '{R}payment-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS s,
        t.p AS p, t.o AS o, t.k AS o_kind
    FROM lineitem, LATERAL (VALUES
      ('{V}amount', CAST(CAST(l_extendedprice AS DECIMAL(38,2)) AS VARCHAR), 'literal'),
      ('{V}currency', upper(l_returnflag), 'literal'),
      ('{V}bookingTimestamp', strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ'), 'literal'),
      ('{V}fromAccount', '{R}account-' || l_orderkey, 'iri')) AS t(p, o, k)""",
)
def _(spark, sf):
    mappings = [
        triples.Mapping(bank.PAYMENT_ID, questions.AMOUNT, column="l_extendedprice", transformation="parse_decimal"),
        triples.Mapping(bank.PAYMENT_ID, questions.CURRENCY, column="l_returnflag", transformation="uppercase"),
        triples.Mapping(bank.PAYMENT_ID, V + "bookingTimestamp", column="l_shipdate", transformation="parse_iso8601"),
        triples.Mapping(bank.PAYMENT_ID, questions.FROM_ACCOUNT, iri=R + "account-{l_orderkey}"),
    ]
    rows = triples.rows_to_triples_once(table(spark, sf, "lineitem"), mappings)
    return rows.select("s", "p", "o", "o_kind")


@registered("merge_graphs", BANK + "SELECT p, count(*) AS n FROM graph GROUP BY p")
def _(spark, sf):
    merged = triples.merge_graphs(bank.bank_graph(spark, sf), bank.bank_graph(spark, sf))
    return merged.groupBy("p").agg(F.count(F.lit(1)).alias("n"))


@registered(
    "local_name",
    """SELECT page_id, regexp_extract(regexp_extract(regexp_extract(url, '[^:]*$'), '[^/]*$'), '[^#]*$') AS name FROM pages""",
)
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", triples.local_name(F.col("url")).alias("name"))


@registered(
    "labels",
    BANK
    + f"""SELECT s, coalesce(min(CASE WHEN p = '{PREF_LABEL}' THEN o END),
        replace(regexp_extract(s, '[^:]*$'), '-', ' ')) AS label FROM graph GROUP BY s""",
)
def _(spark, sf):
    return triples.labels(bank.bank_graph(spark, sf))


@registered("graph_health", BANK + "SELECT count(*) AS triple_count, '1.0' AS ontology_version, 'CANDIDATE' AS publication_state FROM graph")
def _(spark, sf):
    graph = triples.merge_graphs(bank.bank_graph(spark, sf))
    return triples.graph_health(graph, "1.0", "CANDIDATE")


@registered(
    "evidence_coordinates",
    f"""WITH facts AS (
      SELECT doc_id, source, text, lang, n_chars FROM documents),
    wanted AS (SELECT doc_id AS position, CASE WHEN doc_id % 10 = 3 THEN 0 ELSE doc_id END AS target FROM documents),
    asked AS (SELECT target, min(position) AS position, count(*) AS n FROM wanted GROUP BY target)
    SELECT position, '{R}evidence-' || target AS evidence_iri,
      CASE WHEN d.doc_id % 11 <> 5 THEN source END AS source_id,
      source || '@sha256:' || sha256(text) AS snapshot_id,
      CASE WHEN d.doc_id % 13 = 7 THEN least('doc/' || d.doc_id, 'also/' || d.doc_id) ELSE 'doc/' || d.doc_id END AS locator,
      CASE WHEN d.doc_id % 17 = 9 THEN 'broken' ELSE sha256(text) END AS content_sha256,
      CASE WHEN n > 1 THEN 'DUPLICATE_IRI' WHEN d.doc_id % 19 = 4 THEN 'NOT_EVIDENCE'
           WHEN d.doc_id % 11 = 5 OR d.doc_id % 13 = 7 THEN 'NOT_EXACTLY_ONE'
           WHEN d.doc_id % 17 = 9 THEN 'BAD_SHA256' ELSE 'OK' END AS status
    FROM asked JOIN facts d ON d.doc_id = asked.target""",
)
def _(spark, sf):
    doc = F.col("doc_id")
    docs = table(spark, sf, "documents").select(
        "doc_id",
        F.when(doc % 11 != 5, F.col("source")).alias("source_id"),
        F.concat("source", F.lit("@sha256:"), F.sha2("text", 256)).alias("snapshot_id"),
        F.concat(F.lit("doc/"), doc).alias("locator"),
        F.when(doc % 13 == 7, F.concat(F.lit("also/"), doc)).alias("second_locator"),
        F.when(doc % 17 == 9, "broken").otherwise(F.sha2("text", 256)).alias("content_sha256"),
        F.when(doc % 19 != 4, "EvidenceArtifact").alias("kind"),
    )
    subject = R + "evidence-{doc_id}"
    graph = triples.rows_to_triples(
        docs,
        [
            triples.Mapping(subject, RDF_TYPE, iri=V + "{kind}"),
            *[triples.Mapping(subject, p, column=n) for n, p in triples.EVIDENCE_FIELDS.items()],
            triples.Mapping(subject, triples.EVIDENCE_FIELDS["locator"], column="second_locator"),
        ],
    )
    target = F.when(doc % 10 == 3, F.lit(0)).otherwise(doc)
    wanted = docs.select(
        doc.alias("position"), F.concat(F.lit(R + "evidence-"), target).alias("evidence_iri")
    )
    return triples.evidence_coordinates(graph, wanted)


@registered(
    "mapping_states",
    f"""WITH m AS (SELECT '{R}mapping-' || p_partkey AS s, p_partkey AS k,
         CASE WHEN p_partkey % 7 = 3 THEN NULL WHEN p_partkey % 11 = 5 THEN CAST(p_partkey - 1 AS VARCHAR) ELSE CAST(p_partkey AS VARCHAR) END AS id,
         CASE WHEN p_partkey % 13 = 6 THEN NULL ELSE 'HUMAN_REVIEW' END AS st FROM part),
    firsts AS (SELECT id, min(s) AS first_s FROM m WHERE id IS NOT NULL GROUP BY id)
    SELECT m.s AS s, m.id AS mapping_id, m.st AS status,
      CASE WHEN m.id IS NULL THEN 'NOT_ONE_ID' WHEN m.s <> first_s THEN 'DUPLICATE_ID'
           WHEN m.st IS NULL THEN 'NOT_ONE_STATUS' END AS finding
    FROM m LEFT JOIN firsts ON firsts.id = m.id""",
)
def _(spark, sf):
    key = F.col("p_partkey")
    parts = table(spark, sf, "part").select(
        "p_partkey",
        F.when(key % 7 == 3, None).when(key % 11 == 5, key - 1).otherwise(key).alias("id"),
        F.when(key % 13 != 6, "human_review").alias("status"),
    )
    subject = R + "mapping-{p_partkey}"
    graph = triples.rows_to_triples(
        parts,
        [
            triples.Mapping(subject, RDF_TYPE, iri=triples.MAPPING_PROPOSAL),
            triples.Mapping(subject, triples.MAPPING_ID, column="id"),
            triples.Mapping(subject, triples.PROPOSAL_STATUS, column="status"),
        ],
    )
    return triples.mapping_states(graph)


@registered(
    "pattern_scan",
    BANK + f"SELECT s AS entity, o AS account FROM graph WHERE p = '{V}hasAccount'",
)
def _(spark, sf):
    return patterns.pattern(bank.bank_graph(spark, sf), "?entity", questions.HAS_ACCOUNT, "?account")


@registered(
    "pattern_join",
    BANK
    + f"""SELECT a.s AS party, a.o AS entity, b.o AS account, c.o AS name FROM graph a
       JOIN graph b ON b.s = a.o AND b.p = '{V}hasAccount' JOIN graph c ON c.s = a.s AND c.p = '{PREF_LABEL}'
       WHERE a.p = '{V}beneficialOwnerOf'""",
)
def _(spark, sf):
    graph = bank.bank_graph(spark, sf)
    found = patterns.bgp(
        patterns.pattern(graph, "?party", questions.BENEFICIAL_OWNER_OF, "?entity"),
        patterns.pattern(graph, "?entity", questions.HAS_ACCOUNT, "?account"),
        patterns.pattern(graph, "?party", PREF_LABEL, "?name"),
    )
    return found.select("party", "entity", "account", "name")


# Payments straight from their rows; a third of them has no beneficiary.
PAYMENTS = f"""WITH pay AS (SELECT DISTINCT '{R}payment-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS payment,
    '{R}account-' || l_orderkey AS account, CASE WHEN l_suppkey % 3 <> 0 THEN '{R}beneficiary-' || l_suppkey END AS beneficiary FROM lineitem) """


@registered("pattern_optional", PAYMENTS + "SELECT payment, beneficiary FROM pay")
def _(spark, sf):
    graph = triples.merge_graphs(bank.bank_graph(spark, sf))
    return patterns.optional(
        patterns.pattern(graph, "?payment", RDF_TYPE, questions.PAYMENT),
        patterns.pattern(graph, "?payment", questions.TO_ACCOUNT, "?beneficiary"),
    )


@registered(
    "pattern_filter",
    BANK
    + f"""SELECT s AS payment, o AS amount FROM graph WHERE p = '{V}amount' AND CAST(o AS DECIMAL(38,2)) > 50000""",
)
def _(spark, sf):
    found = patterns.pattern(triples.merge_graphs(bank.bank_graph(spark, sf)), "?payment", questions.AMOUNT, "?amount")
    return patterns.where(found, F.col("amount").try_cast("decimal(38,2)") > 50000)


@registered("project_distinct", BANK + f"SELECT DISTINCT o AS currency FROM graph WHERE p = '{V}currency'")
def _(spark, sf):
    found = patterns.pattern(bank.bank_graph(spark, sf), "?payment", questions.CURRENCY, "?currency")
    return patterns.project_distinct(found, ["currency"])


@registered(
    "order_by_limited",
    BANK
    + f"""SELECT payment, beneficiary, TRUE AS truncated FROM (
       SELECT a.s AS payment, b.o AS beneficiary FROM graph a LEFT JOIN graph b ON b.s = a.s AND b.p = '{V}toAccount'
       WHERE a.p = '{RDF_TYPE}' AND a.o = '{V}Payment') ORDER BY beneficiary ASC NULLS FIRST, payment LIMIT 250""",
)
def _(spark, sf):
    graph = triples.merge_graphs(bank.bank_graph(spark, sf))
    found = patterns.optional(
        patterns.pattern(graph, "?payment", RDF_TYPE, questions.PAYMENT),
        patterns.pattern(graph, "?payment", questions.TO_ACCOUNT, "?beneficiary"),
    )
    return patterns.limited(found, 250, ["beneficiary", "payment"])


@registered("ask", BANK + f"SELECT count(*) > 0 AS answer FROM graph WHERE p = '{V}targetsParty'")
def _(spark, sf):
    graph = bank.bank_graph(spark, sf)
    return patterns.ask(patterns.pattern(graph, "?s", questions.TARGETS_PARTY, "?o"))


@registered(
    "construct",
    BANK
    + f"""SELECT DISTINCT t.s AS s, t.p AS p, t.o AS o, t.k AS o_kind FROM graph a JOIN graph b ON b.s = a.o AND b.p = '{V}hasAccount',
       LATERAL (VALUES (b.o, '{V}controlledBy', a.s, 'iri'), (a.s, '{RDF_TYPE}', '{V}Controller', 'iri')) AS t(s, p, o, k)
       WHERE a.p = '{V}beneficialOwnerOf'""",
)
def _(spark, sf):
    graph = bank.bank_graph(spark, sf)
    found = patterns.bgp(
        patterns.pattern(graph, "?party", questions.BENEFICIAL_OWNER_OF, "?entity"),
        patterns.pattern(graph, "?entity", questions.HAS_ACCOUNT, "?account"),
    )
    return patterns.construct(
        found,
        [("?account", V + "controlledBy", "?party", "iri"), ("?party", RDF_TYPE, V + "Controller", "iri")],
    )


@registered("describe", BANK + f"SELECT s, p, o, o_kind FROM graph WHERE s = '{R}party-3'")
def _(spark, sf):
    found = patterns.describe(bank.bank_graph(spark, sf), R + "party-3")
    return found.select("s", "p", "o", "o_kind")


@registered(
    "pattern_union",
    BANK
    + f"""SELECT s AS party, o AS entity, NULL AS sanction FROM graph WHERE p = '{V}beneficialOwnerOf'
       UNION ALL SELECT o, NULL, s FROM graph WHERE p = '{V}targetsParty'""",
)
def _(spark, sf):
    graph = bank.bank_graph(spark, sf)
    return patterns.pattern_union(
        patterns.pattern(graph, "?party", questions.BENEFICIAL_OWNER_OF, "?entity"),
        patterns.pattern(graph, "?sanction", questions.TARGETS_PARTY, "?party"),
    )


@registered("not_exists", PAYMENTS + "SELECT payment FROM pay WHERE beneficiary IS NULL")
def _(spark, sf):
    graph = triples.merge_graphs(bank.bank_graph(spark, sf))
    return patterns.not_exists(
        patterns.pattern(graph, "?payment", RDF_TYPE, questions.PAYMENT),
        patterns.pattern(graph, "?payment", questions.TO_ACCOUNT, "?beneficiary"),
    )


@registered("exists", PAYMENTS + "SELECT payment FROM pay WHERE beneficiary IS NOT NULL")
def _(spark, sf):
    graph = triples.merge_graphs(bank.bank_graph(spark, sf))
    return patterns.exists(
        patterns.pattern(graph, "?payment", RDF_TYPE, questions.PAYMENT),
        patterns.pattern(graph, "?payment", questions.TO_ACCOUNT, "?beneficiary"),
    )


@registered("pattern_minus", PAYMENTS + "SELECT payment, account FROM pay WHERE beneficiary IS NULL")
def _(spark, sf):
    graph = triples.merge_graphs(bank.bank_graph(spark, sf))
    return patterns.pattern_minus(
        patterns.pattern(graph, "?payment", questions.FROM_ACCOUNT, "?account"),
        patterns.pattern(graph, "?payment", questions.TO_ACCOUNT, "?beneficiary"),
    )


@registered(
    "bind_values",
    BANK
    + f"""SELECT currency, payment, label, length(payment) AS size FROM (
       SELECT o AS currency, s AS payment FROM graph WHERE p = '{V}currency')
       JOIN (VALUES ('A', 'accepted'), ('R', 'returned')) AS v(currency, label) USING (currency)""",
)
def _(spark, sf):
    found = patterns.pattern(triples.merge_graphs(bank.bank_graph(spark, sf)), "?payment", questions.CURRENCY, "?currency")
    joined = patterns.values(found, ["currency", "label"], [("A", "accepted"), ("R", "returned")])
    return patterns.bind(joined, "size", F.length("payment"))


@registered(
    "values_product",
    BANK
    + f"""SELECT o AS account, label FROM graph, (VALUES ('first'), ('second')) AS v(label) WHERE p = '{V}hasAccount'""",
)
def _(spark, sf):
    found = patterns.pattern(bank.bank_graph(spark, sf), "?entity", questions.HAS_ACCOUNT, "?account").select("account")
    return patterns.values(found, ["label"], [("first",), ("second",)])


@registered(
    "optional_unbound",
    PAYMENTS
    + f"""SELECT payment, v.beneficiary, label FROM pay JOIN (VALUES ('{R}beneficiary-1', 'one'), ('{R}beneficiary-2', 'two')) AS v(beneficiary, label)
       ON pay.beneficiary IS NULL OR pay.beneficiary = v.beneficiary""",
)
def _(spark, sf):
    graph = triples.merge_graphs(bank.bank_graph(spark, sf))
    found = patterns.optional(
        patterns.pattern(graph, "?payment", RDF_TYPE, questions.PAYMENT),
        patterns.pattern(graph, "?payment", questions.TO_ACCOUNT, "?beneficiary"),
    )
    rows = [(R + "beneficiary-1", "one"), (R + "beneficiary-2", "two")]
    return patterns.values(found, ["beneficiary", "label"], rows, unbound=("beneficiary",)).select("payment", "beneficiary", "label")


@registered(
    "path_closure",
    f"""WITH RECURSIVE edges AS (
       SELECT DISTINCT '{R}account-' || o_orderkey AS s, '{R}entity-' || o_custkey AS o FROM orders
       UNION ALL SELECT '{R}entity-' || c_custkey, '{R}party-' || c_nationkey FROM customer
       UNION ALL SELECT '{R}party-' || n_nationkey, '{R}area-' || n_regionkey FROM nation),
    paths AS (SELECT s, o FROM edges UNION SELECT e.s, p.o FROM edges e JOIN paths p ON e.o = p.s)
    SELECT s, o FROM paths""",
)
def _(spark, sf):
    part_of = V + "partOf"
    graph = triples.rows_to_triples(
        table(spark, sf, "orders"), [triples.Mapping(bank.ACCOUNT, part_of, iri=R + "entity-{o_custkey}")]
    )
    for name, subject, target in (
        ("customer", bank.ENTITY, R + "party-{c_nationkey}"),
        ("nation", bank.PARTY, R + "area-{n_regionkey}"),
    ):
        graph = graph.unionByName(
            triples.rows_to_triples(table(spark, sf, name), [triples.Mapping(subject, part_of, iri=target)])
        )
    return patterns.path_closure(patterns.pattern(graph, "?s", part_of, "?o"))


@registered(
    "cq_sanctioned_accounts",
    f"""SELECT DISTINCT '{R}sanction-' || r_regionkey AS sanction, '{R}party-' || n_nationkey AS party,
        '{R}entity-' || c_custkey AS entity, '{R}account-' || o_orderkey AS account
    FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey
    JOIN orders ON o_custkey = c_custkey WHERE r_name = 'ASIA'""",
)
def cq_sanctioned_accounts(spark, sf):
    return questions.cq_sanctioned_accounts(bank.bank_graph(spark, sf))


@registered(
    "cq_sanctioned_payments",
    f"""SELECT DISTINCT '{R}payment-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS payment,
        '{R}account-' || o_orderkey AS account, CAST(CAST(l_extendedprice AS DECIMAL(38,2)) AS VARCHAR) AS amount,
        l_returnflag AS currency, CASE WHEN l_suppkey % 3 <> 0 THEN '{R}beneficiary-' || l_suppkey END AS "beneficiaryAccount"
    FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey
    JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE r_name = 'ASIA'""",
)
def _(spark, sf):
    return questions.cq_sanctioned_payments(bank.bank_graph(spark, sf))


@registered(
    "cq_duplicate_parties",
    f"""WITH h AS (SELECT doc_id, source, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS k FROM documents),
    f AS (SELECT k, min(doc_id) AS first_id FROM h GROUP BY k),
    links AS (SELECT '{R}record-' || doc_id AS a, '{R}record-' || first_id AS b FROM h JOIN f USING (k) WHERE doc_id <> first_id),
    both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links)
    SELECT DISTINCT a AS party, b AS duplicate, x.source AS "partySource", y.source AS "duplicateSource",
      '{R}evidence-' || x.doc_id AS evidence
    FROM both_ways JOIN h x ON a = '{R}record-' || x.doc_id JOIN h y ON b = '{R}record-' || y.doc_id WHERE a < b""",
)
def _(spark, sf):
    from govgraph.operators.inference import infer_symmetric

    graph = bank.duplicate_graph(spark, sf)
    axioms = local_frame(
        spark,
        [(questions.POSSIBLE_DUPLICATE_OF, RDF_TYPE, triples.SYMMETRIC)], "s string, p string, o string"
    )
    links = graph.filter(F.col("p") == questions.POSSIBLE_DUPLICATE_OF)
    return questions.cq_duplicate_parties(graph.unionByName(infer_symmetric(links, axioms)))


@registered(
    "cq_mapping_evidence",
    f"""SELECT '{R}mapping-' || o_orderkey AS mapping, o_orderpriority AS field, '{V}status-' || o_orderstatus AS concept,
        '{R}line-' || e.n AS evidence, '{R}flag-' || c.f AS counterevidence, NULL AS counterexample,
        CASE WHEN o_orderkey % 2 = 0 THEN '0.96' END AS lexical, CASE WHEN o_orderkey % 3 = 0 THEN '0.92' END AS structural,
        NULL AS instance
    FROM orders JOIN (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem) e ON e.k = o_orderkey
    JOIN (SELECT DISTINCT l_orderkey AS k, l_returnflag AS f FROM lineitem) c ON c.k = o_orderkey""",
)
def _(spark, sf):
    graph = triples.merge_graphs(bank.evidence_graph(spark, sf))
    return questions.cq_mapping_evidence(graph)


@registered(
    "cq_change_impact",
    f"""SELECT DISTINCT '{R}mapping-' || p_partkey AS mapping, '{V}size-' || p_size AS concept,
        '{R}question-' || l_orderkey AS dependency, '{V}status-' || s.l_linestatus AS "dependencyType"
    FROM part JOIN lineitem l ON l.l_partkey = p_partkey
    JOIN (SELECT DISTINCT l_orderkey, l_linestatus FROM lineitem) s USING (l_orderkey) WHERE p_type = 'ECONOMY'""",
)
def _(spark, sf):
    return questions.cq_change_impact(bank.mapping_graph(spark, sf), "ECONOMY")


_TERMS = "SELECT DISTINCT lower(unnest(string_split(p_type || ' ' || p_name || '|' || p_name || '|' || p_brand, '|'))) AS term FROM part"


def _terms(spark, sf):
    words = F.split(F.concat("p_type", F.lit(" "), "p_name", F.lit("|"), "p_name", F.lit("|"), "p_brand"), r"\|")
    return table(spark, sf, "part").select(F.explode(words).alias("term")).select(F.lower("term").alias("term"))


CONCEPT_LABELS = f"""SELECT DISTINCT '{V}' || replace(p_name, ' ', '-') AS iri, 0 AS predicate_rank, 'prefLabel' AS matched_on, lower(p_name) AS norm, p_name AS label FROM part
       UNION SELECT DISTINCT '{V}' || replace(p_name, ' ', '-'), 1, 'altLabel', lower(p_type), p_name FROM part"""


@registered(
    "resolve_terms",
    f"""WITH RECURSIVE {resolution_sql(_TERMS, CONCEPT_LABELS, 3)}
    SELECT term, rank, iri, label, label AS definition, 'http://www.w3.org/2004/02/skos/core#Concept' AS concept_type, score, matched_on
    FROM resolved""",
)
def _(spark, sf):
    return resolve.resolve_terms(_terms(spark, sf), bank.concept_graph(spark, sf), limit=3)


_ASKED = _TERMS + " UNION ALL SELECT 'zzzz'"


@registered(
    "term_context",
    f"""WITH RECURSIVE {resolution_sql(_ASKED, CONCEPT_LABELS, 1)},
    sizes AS (SELECT DISTINCT '{V}' || replace(p_name, ' ', '-') AS iri, 'size-' || p_size AS size FROM part),
    relations AS (SELECT iri, size, row_number() OVER (PARTITION BY iri ORDER BY size) AS n FROM sizes)
    SELECT t.term, CASE WHEN r.iri IS NULL THEN 'CONCEPT_NOT_FOUND' ELSE 'OK' END AS status, r.iri AS iri, r.score AS score, v.n::int AS rank,
      CASE WHEN v.n IS NOT NULL THEN '{V}hasSize' END AS predicate, '{V}' || v.size AS object, replace(v.size, '-', ' ') AS object_label
    FROM terms t LEFT JOIN resolved r ON r.term = t.term LEFT JOIN relations v ON v.iri = r.iri AND v.n <= 5""",
)
def _(spark, sf):
    asked = _terms(spark, sf).unionByName(spark.range(1).select(F.lit("zzzz").alias("term")))
    slug = F.replace("p_name", F.lit(" "), F.lit("-")).alias("slug")
    sizes = table(spark, sf, "part").select(slug, "p_size").distinct()
    related = triples.rows_to_triples(sizes, [triples.Mapping(V + "{slug}", V + "hasSize", iri=V + "size-{p_size}")])
    found = context.term_context(asked, bank.concept_graph(spark, sf).unionByName(related), limit=5)
    return found.select("term", "status", "iri", "score", "rank", "predicate", "object", "object_label")


@registered(
    "resolve_lexical",
    f"""WITH t AS ({_TERMS}),
    names AS (SELECT DISTINCT '{V}' || replace(p_name, ' ', '-') AS iri, p_name AS norm FROM part
       UNION SELECT DISTINCT '{V}' || replace(p_name, ' ', '-'), lower(p_type) FROM part)
    SELECT term, iri, max(round(CASE WHEN trim(term) = norm THEN 1.0 ELSE greatest(0.84,
        2.0 * least(length(trim(term)), length(norm)) / (length(trim(term)) + length(norm))) END, 4)) AS score
    FROM t, names WHERE contains(norm, trim(term)) OR contains(trim(term), norm) GROUP BY term, iri""",
)
def _(spark, sf):
    names = resolve.concept_labels(bank.concept_graph(spark, sf))
    return resolve.resolve_lexical(_terms(spark, sf), names)


@registered(
    "concept_context",
    BANK
    + f""", asked AS (SELECT '{R}party-' || n_nationkey AS iri FROM nation),
    edges AS (SELECT iri, s, p, o, o_kind, 'out' AS direction FROM graph JOIN asked ON s = iri
        WHERE p NOT IN ('{RDF_TYPE}', '{PREF_LABEL}')
      UNION ALL SELECT iri, s, p, o, o_kind, 'in' FROM graph JOIN asked ON o = iri),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY iri ORDER BY p, s, o, direction) AS rank FROM edges),
    names AS (SELECT s AS node, min(o) AS label FROM graph WHERE p = '{PREF_LABEL}' GROUP BY s)
    SELECT iri, rank, direction, s AS subject, p AS predicate, o AS object,
      CASE WHEN o_kind = 'iri' THEN coalesce(label, replace(regexp_extract(o, '[^:]*$'), '-', ' ')) END AS object_label
    FROM ranked LEFT JOIN names ON node = o WHERE rank <= 5""",
)
def _(spark, sf):
    asked = table(spark, sf, "nation").select(F.concat(F.lit(R + "party-"), "n_nationkey").alias("iri"))
    # Asked for a few resources, the view is scanned; nothing of the rest is written or moved.
    return context.concept_context(bank.bank_graph(spark, sf), asked, limit=5)


@registered(
    "concept_cards",
    f"""SELECT '{V}' || replace(p_name, ' ', '-') AS iri, p_name AS label, p_name AS definition, 'http://www.w3.org/2004/02/skos/core#Concept' AS types FROM part GROUP BY p_name""",
)
def _(spark, sf):
    slug = F.replace("p_name", F.lit(" "), F.lit("-"))
    asked = table(spark, sf, "part").select(F.concat(F.lit(V), slug).alias("iri"))
    cards = context.concept_cards_for(bank.concept_graph(spark, sf), asked)
    return cards.withColumn("types", F.array_join("types", ","))


@registered(
    "concept_mappings",
    f"""SELECT '{V}size-' || p_size AS iri, '{R}mapping-' || p_partkey AS mapping, p_type AS field_name,
        p_brand AS source_system, 'HUMAN_REVIEW' AS status FROM part""",
)
def _(spark, sf):
    asked = table(spark, sf, "part").select(F.concat(F.lit(V + "size-"), "p_size").alias("iri"))
    return context.concept_mappings(bank.mapping_graph(spark, sf), asked)


@registered(
    "explain",
    f"""WITH steps AS (
      SELECT CAST(p_partkey AS VARCHAR) AS id, t.k AS k, t.st AS statement FROM part,
      LATERAL (VALUES (0, 'fieldName = ' || p_type), (1, 'mapsToConcept = {V}size-' || p_size),
                      (3, 'proposalStatus = HUMAN_REVIEW')) AS t(k, st))
    SELECT id, row_number() OVER (PARTITION BY id ORDER BY k) AS step, statement, NULL AS evidence_iri FROM steps""",
)
def _(spark, sf):
    ids = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"))
    return context.explain(bank.mapping_graph(spark, sf), ids)


@registered(
    "explanation_cards",
    f"""SELECT CAST(o_orderkey AS VARCHAR) AS id, '{R}mapping-' || o_orderkey AS iri, 'mapping ' || o_orderkey AS label,
        'The explanation is derived only from the verified graph.' AS rationale,
        CASE WHEN o_orderkey % 2 = 0 THEN CAST(0.96 AS DECIMAL(9,4)) END AS confidence_lexical,
        CASE WHEN o_orderkey % 3 = 0 THEN CAST(0.92 AS DECIMAL(9,4)) END AS confidence_structural,
        CAST(NULL AS DECIMAL(9,4)) AS confidence_instance, CAST(NULL AS DECIMAL(9,4)) AS confidence_provenance,
        0 AS counterexamples FROM orders""",
)
def _(spark, sf):
    ids = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"))
    return context.explanation_cards(bank.evidence_graph(spark, sf), ids)


@registered(
    "route_questions",
    """WITH t AS (SELECT conv_id, turn, lower(text) AS x FROM conversations WHERE role = 'user')
    SELECT conv_id, turn, q AS question_id, CASE WHEN q IS NULL THEN 'ABSTAINED' ELSE 'OK' END AS status FROM (
      SELECT conv_id, turn, CASE WHEN contains(x, 'cif_no') THEN 'CQ-004'
        WHEN contains(x, 'ubo') AND regexp_matches(x, 'impact|delet|elimin') THEN 'CQ-005'
        WHEN regexp_matches(x, 'duplicate|duplicad') THEN 'CQ-003'
        WHEN regexp_matches(x, 'payment|pago|transfer') AND regexp_matches(x, 'sanction|sancion|beneficial|ubo') THEN 'CQ-002'
        WHEN regexp_matches(x, 'account|cuenta') AND regexp_matches(x, 'sanction|sancion|beneficial|ubo') THEN 'CQ-001' END AS q
      FROM (SELECT conv_id, turn, CASE conv_id % 6 WHEN 0 THEN 'why cif_no ' WHEN 1 THEN 'impact if ubo goes: '
        WHEN 2 THEN 'duplicate ' WHEN 3 THEN 'pago sancion ' WHEN 4 THEN 'cuenta beneficial ' ELSE '' END || x AS x FROM t))""",
)
def _(spark, sf):
    key = F.col("conv_id") % 6
    opening = (
        F.when(key == 0, "why CIF_NO ")
        .when(key == 1, "Impact if UBO goes: ")
        .when(key == 2, "duplicate ")
        .when(key == 3, "pago sancion ")
        .when(key == 4, "cuenta beneficial ")
        .otherwise("")
    )
    asked = table(spark, sf, "conversations").filter("role = 'user'")
    asked = asked.select("conv_id", "turn", F.concat(opening, "text").alias("text"))
    return context.route_questions(asked, "text").drop("text")
