"""Registered queries: class and property inference, constraint validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from govgraph.operators import inference, shapes
from govgraph.operators.triples import (
    DOMAIN,
    INVERSE_OF,
    RANGE,
    RDF_TYPE,
    RESOURCE,
    SUBCLASS_OF,
    SYMMETRIC,
    VOCAB,
    XSD,
    Mapping,
    rows_to_triples,
)
from govgraph.plans import bank
from govgraph.plans.registry import registered, table
from govgraph.session import local_frame

R, V = RESOURCE, VOCAB

# Axioms of the bank graph, as the SQL below also applies them.
AXIOMS = [
    (V + "LegalEntity", SUBCLASS_OF, V + "Party"),
    (V + "Party", SUBCLASS_OF, V + "BusinessConcept"),
    (V + "Account", SUBCLASS_OF, V + "BusinessConcept"),
    (V + "Payment", SUBCLASS_OF, V + "BusinessConcept"),
    (V + "hasAccount", DOMAIN, V + "LegalEntity"),
    (V + "hasAccount", RANGE, V + "Account"),
    (V + "hasAccount", INVERSE_OF, V + "heldBy"),
    (V + "beneficialOwnerOf", DOMAIN, V + "Party"),
    (V + "beneficialOwnerOf", RANGE, V + "LegalEntity"),
    (V + "beneficialOwnerOf", INVERSE_OF, V + "hasBeneficialOwner"),
    (V + "fromAccount", DOMAIN, V + "Payment"),
    (V + "fromAccount", RANGE, V + "Account"),
    (V + "toAccount", RANGE, V + "Account"),
    (V + "amount", RANGE, XSD + "decimal"),
]


def axioms(spark):
    return local_frame(spark, AXIOMS, "s string, p string, o string")


@registered(
    "subclass_closure",
    f"""WITH RECURSIVE edges AS (
      SELECT DISTINCT '{V}' || p_name AS a, '{V}' || p_type AS b FROM part UNION SELECT DISTINCT '{V}' || p_type, '{V}Part' FROM part
      UNION SELECT DISTINCT '{V}p' || p_partkey, '{V}' || p_name FROM part),
    paths AS (SELECT a, b FROM edges UNION SELECT e.a, p.b FROM edges e JOIN paths p ON e.b = p.a)
    SELECT a AS subclass, b AS superclass FROM paths""",
)
def _(spark, sf):
    parts = table(spark, sf, "part")
    graph = rows_to_triples(
        parts,
        [
            Mapping(V + "{p_name}", SUBCLASS_OF, iri=V + "{p_type}"),
            Mapping(V + "{p_type}", SUBCLASS_OF, iri=V + "Part"),
            Mapping(V + "p{p_partkey}", SUBCLASS_OF, iri=V + "{p_name}"),
        ],
    )
    return inference.subclass_closure(inference.axioms_of(graph))


@registered(
    "infer_types",
    f"""SELECT '{R}entity-' || c_custkey AS s, t.o AS o FROM customer, LATERAL (VALUES ('{V}Party'), ('{V}BusinessConcept')) AS t(o)
    UNION SELECT '{R}party-' || n_nationkey, '{V}BusinessConcept' FROM nation
    UNION SELECT '{R}account-' || o_orderkey, '{V}BusinessConcept' FROM orders
    UNION SELECT '{R}payment-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey, '{V}BusinessConcept' FROM lineitem""",
)
def _(spark, sf):
    supers = inference.subclass_closure(axioms(spark))
    return inference.infer_types(bank.bank_graph(spark, sf), supers).select("s", "o").distinct()


def _rules(spark):
    schema = axioms(spark)
    supers = inference.subclass_closure(schema)
    return inference.type_rules(schema, supers, inference.property_closure(schema))


@registered(
    "infer_domain",
    f"""SELECT DISTINCT '{R}entity-' || o_custkey AS s, t.o AS o FROM orders, LATERAL (VALUES ('{V}LegalEntity'), ('{V}Party'), ('{V}BusinessConcept')) AS t(o)
    UNION SELECT '{R}party-' || c_nationkey, t.o FROM customer, LATERAL (VALUES ('{V}Party'), ('{V}BusinessConcept')) AS t(o)
    UNION SELECT '{R}payment-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey, t.o FROM lineitem, LATERAL (VALUES ('{V}Payment'), ('{V}BusinessConcept')) AS t(o)""",
)
def _(spark, sf):
    return inference.infer_domain(bank.bank_graph(spark, sf), _rules(spark)).select("s", "o").distinct()


@registered(
    "infer_range",
    f"""SELECT DISTINCT '{R}account-' || k AS s, t.o AS o FROM (SELECT o_orderkey AS k FROM orders UNION SELECT l_orderkey FROM lineitem), LATERAL (VALUES ('{V}Account'), ('{V}BusinessConcept')) AS t(o)
    UNION SELECT '{R}beneficiary-' || l_suppkey, t.o FROM lineitem, LATERAL (VALUES ('{V}Account'), ('{V}BusinessConcept')) AS t(o) WHERE l_suppkey % 3 <> 0
    UNION SELECT '{R}entity-' || c_custkey, t.o FROM customer, LATERAL (VALUES ('{V}LegalEntity'), ('{V}Party'), ('{V}BusinessConcept')) AS t(o)""",
)
def _(spark, sf):
    return inference.infer_range(bank.bank_graph(spark, sf), _rules(spark)).select("s", "o").distinct()


@registered(
    "infer_inverse",
    f"""SELECT '{R}account-' || o_orderkey AS s, '{V}heldBy' AS p, '{R}entity-' || o_custkey AS o FROM orders
    UNION ALL SELECT '{R}entity-' || c_custkey, '{V}hasBeneficialOwner', '{R}party-' || c_nationkey FROM customer""",
)
def _(spark, sf):
    return inference.infer_inverse(bank.bank_graph(spark, sf), axioms(spark)).select("s", "p", "o")


@registered(
    "infer_symmetric",
    f"""WITH h AS (SELECT doc_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS k FROM documents),
    f AS (SELECT k, min(doc_id) AS first_id FROM h GROUP BY k)
    SELECT '{R}record-' || first_id AS s, '{R}record-' || doc_id AS o FROM h JOIN f USING (k) WHERE doc_id <> first_id""",
)
def _(spark, sf):
    relation = V + "possibleDuplicateOf"
    axiom = local_frame(spark, [(relation, RDF_TYPE, SYMMETRIC)], "s string, p string, o string")
    links = bank.duplicate_graph(spark, sf).filter(F.col("p") == relation)
    return inference.infer_symmetric(links, axiom).select("s", "o")


@registered(
    "materialize",
    f"""WITH base AS (
      SELECT DISTINCT '{R}entity-' || o_custkey AS s, '{V}hasAccount' AS p, '{R}account-' || o_orderkey AS o FROM orders
      UNION SELECT '{R}account-' || o_orderkey, '{RDF_TYPE}', '{V}Account' FROM orders
      UNION SELECT '{R}account-' || o_orderkey, '{V}ownedBy', '{R}entity-' || o_custkey FROM orders
      UNION SELECT '{R}account-' || o_orderkey, '{V}accountNumber', CAST(o_orderkey AS VARCHAR) FROM orders
      UNION SELECT '{R}party-' || c_nationkey, '{V}beneficialOwnerOf', '{R}entity-' || c_custkey FROM customer
      UNION SELECT '{R}entity-' || c_custkey, '{RDF_TYPE}', '{V}LegalEntity' FROM customer
      UNION SELECT '{R}party-' || n_nationkey, '{RDF_TYPE}', '{V}Party' FROM nation
      UNION SELECT '{R}sanction-' || n_regionkey, '{V}targetsParty', '{R}party-' || n_nationkey FROM nation
      UNION SELECT '{R}sanction-' || r_regionkey, '{RDF_TYPE}', '{V}SanctionsEntry' FROM region WHERE r_name = 'ASIA'
      UNION SELECT '{R}party-' || n_nationkey, 'http://www.w3.org/2004/02/skos/core#prefLabel', n_name FROM nation
      UNION SELECT '{R}entity-' || c_custkey, 'http://www.w3.org/2004/02/skos/core#prefLabel', c_name FROM customer
      UNION SELECT '{R}payment-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey, '{RDF_TYPE}', '{V}Payment' FROM lineitem
      UNION SELECT '{R}payment-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey, '{V}fromAccount', '{R}account-' || l_orderkey FROM lineitem
      UNION SELECT '{R}payment-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey, '{V}toAccount', '{R}beneficiary-' || l_suppkey FROM lineitem WHERE l_suppkey % 3 <> 0
      UNION SELECT '{R}payment-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey, '{V}amount', CAST(CAST(l_extendedprice AS DECIMAL(38,2)) AS VARCHAR) FROM lineitem
      UNION SELECT '{R}payment-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey, '{V}currency', l_returnflag FROM lineitem),
    swapped AS (SELECT o AS s, CASE p WHEN '{V}hasAccount' THEN '{V}heldBy' ELSE '{V}hasBeneficialOwner' END AS p, s AS o FROM base WHERE p IN ('{V}hasAccount', '{V}beneficialOwnerOf')),
    ruled AS (
      SELECT s, '{V}LegalEntity' AS c FROM base WHERE p = '{V}hasAccount' UNION SELECT o, '{V}Account' FROM base WHERE p = '{V}hasAccount'
      UNION SELECT s, '{V}Party' FROM base WHERE p = '{V}beneficialOwnerOf' UNION SELECT o, '{V}LegalEntity' FROM base WHERE p = '{V}beneficialOwnerOf'
      UNION SELECT s, '{V}Payment' FROM base WHERE p = '{V}fromAccount' UNION SELECT o, '{V}Account' FROM base WHERE p IN ('{V}fromAccount', '{V}toAccount')
      UNION SELECT s, o FROM base WHERE p = '{RDF_TYPE}'),
    supers AS (SELECT * FROM (VALUES ('{V}LegalEntity', '{V}Party'), ('{V}LegalEntity', '{V}BusinessConcept'), ('{V}Party', '{V}BusinessConcept'), ('{V}Account', '{V}BusinessConcept'), ('{V}Payment', '{V}BusinessConcept')) AS t(a, b)),
    everything AS (SELECT * FROM base UNION SELECT * FROM swapped UNION SELECT s, '{RDF_TYPE}', c FROM ruled UNION SELECT s, '{RDF_TYPE}', b FROM ruled JOIN supers ON a = c)
    SELECT s, p, o, NOT EXISTS (SELECT 1 FROM base b WHERE b.s = e.s AND b.p = e.p AND b.o = e.o) AS inferred FROM everything e""",
)
def _(spark, sf):
    full = inference.materialize(bank.bank_graph(spark, sf), axioms(spark))
    return full.select("s", "p", "o", "inferred")


def _constraints():
    account, payment = V + "AccountShape", V + "PaymentShape"
    c = shapes.Constraint
    target, pay = V + "Account", V + "Payment"
    return [
        c(account, target, V + "accountNumber", "minCount", "1", message="An account needs one number."),
        c(account, target, V + "accountNumber", "maxCount", "1", message="An account needs one number."),
        c(account, target, V + "accountNumber", "datatype", XSD + "string"),
        c(account, target, V + "ownedBy", "minCount", "1"),
        c(account, target, V + "ownedBy", "class", V + "LegalEntity"),
        c(account, target, V + "ownedBy", "nodeKind", "IRI"),
        c(payment, pay, V + "amount", "minExclusive", "1000"),
        c(payment, pay, V + "amount", "datatype", XSD + "decimal"),
        c(payment, pay, V + "discount", "minInclusive", "0.01", severity="Warning"),
        c(payment, pay, V + "discount", "maxInclusive", "0.09", severity="Info"),
        c(payment, pay, V + "currency", "pattern", "^[A-Q]$"),
        c(payment, pay, V + "currency", "in", shapes.LIST_SEPARATOR.join(["A", "N"])),
        c(payment, pay, V + "currency", "hasValue", "N"),
        c(payment, pay, V + "toAccount", "minCount", "1"),
    ]


def shaped_graph(spark, sf):
    """Orders as accounts (some without number, with two, or owned by no customer) and payments."""
    key = F.col("o_orderkey")
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(key % 7 != 1, key).alias("number"),
        F.when(key % 11 == 2, F.concat(F.lit("x"), key)).alias("second"),
        F.when(key % 5 != 3, F.concat(F.lit(R + "entity-"), "o_custkey")).otherwise(R + "nobody").alias("owner"),
        F.when(key % 13 == 4, "a name").alias("text_owner"),
    )
    discount = F.col("l_discount").cast("decimal(38,2)")
    lines = bank.payments(spark, sf).withColumn("discount", discount)
    return (
        rows_to_triples(
            orders,
            [
                Mapping(bank.ACCOUNT, RDF_TYPE, iri=V + "Account"),
                Mapping(bank.ACCOUNT, V + "accountNumber", column="number"),
                Mapping(bank.ACCOUNT, V + "accountNumber", column="second", datatype=XSD + "token"),
                Mapping(bank.ACCOUNT, V + "ownedBy", iri="{owner}"),
                Mapping(bank.ACCOUNT, V + "ownedBy", column="text_owner"),
            ],
        )
        .unionByName(rows_to_triples(table(spark, sf, "customer"), [Mapping(bank.ENTITY, RDF_TYPE, iri=V + "LegalEntity")]))
        .unionByName(
            rows_to_triples(
                lines,
                [
                    Mapping(bank.PAYMENT_ID, RDF_TYPE, iri=V + "Payment"),
                    Mapping(bank.PAYMENT_ID, V + "amount", column="l_extendedprice", datatype=XSD + "decimal", transformation="parse_decimal"),
                    Mapping(bank.PAYMENT_ID, V + "discount", column="discount", datatype=XSD + "decimal"),
                    Mapping(bank.PAYMENT_ID, V + "currency", column="l_returnflag"),
                    Mapping(bank.PAYMENT_ID, V + "toAccount", iri=R + "beneficiary-{beneficiary}"),
                ],
            )
        )
    )


_SHAPED = f"""WITH a AS (SELECT DISTINCT o_orderkey AS k, '{R}account-' || o_orderkey AS f FROM orders),
  num AS (SELECT k, f, CAST(k AS VARCHAR) AS v, 'string' AS dt FROM a WHERE k % 7 <> 1 UNION SELECT k, f, 'x' || k, 'token' FROM a WHERE k % 11 = 2),
  pay AS (SELECT DISTINCT '{R}payment-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS f, CAST(l_extendedprice AS DECIMAL(38,2)) AS amount,
     CAST(l_discount AS DECIMAL(38,2)) AS discount, l_returnflag AS cur, l_suppkey FROM lineitem),
  own AS (SELECT '{R}account-' || o_orderkey AS f, CASE WHEN o_orderkey % 5 <> 3 THEN '{R}entity-' || o_custkey ELSE '{R}nobody' END AS v, TRUE AS iri, o_orderkey % 5 <> 3 AS known FROM orders
     UNION SELECT '{R}account-' || o_orderkey, 'a name', FALSE, FALSE FROM orders WHERE o_orderkey % 13 = 4),
  report AS (
   SELECT f, 'minCount' AS component, '{V}accountNumber' AS path, 'Violation' AS severity, NULL AS v, 'An account needs one number.' AS message FROM a WHERE f NOT IN (SELECT f FROM num)
   UNION ALL SELECT f, 'maxCount', '{V}accountNumber', 'Violation', NULL, 'An account needs one number.' FROM num GROUP BY f HAVING count(*) > 1
   UNION ALL SELECT f, 'datatype', '{V}accountNumber', 'Violation', v, 'datatype {XSD}string is not met' FROM num WHERE dt = 'token'
   UNION ALL SELECT f, 'class', '{V}ownedBy', 'Violation', v, 'class {V}LegalEntity is not met' FROM own WHERE NOT known
   UNION ALL SELECT f, 'nodeKind', '{V}ownedBy', 'Violation', v, 'nodeKind IRI is not met' FROM own WHERE NOT iri
   UNION ALL SELECT f, 'minExclusive', '{V}amount', 'Violation', CAST(amount AS VARCHAR), 'minExclusive 1000 is not met' FROM (SELECT DISTINCT f, amount FROM pay) WHERE amount <= 1000
   UNION ALL SELECT f, 'minInclusive', '{V}discount', 'Warning', CAST(discount AS VARCHAR), 'minInclusive 0.01 is not met' FROM (SELECT DISTINCT f, discount FROM pay) WHERE discount < 0.01
   UNION ALL SELECT f, 'maxInclusive', '{V}discount', 'Info', CAST(discount AS VARCHAR), 'maxInclusive 0.09 is not met' FROM (SELECT DISTINCT f, discount FROM pay) WHERE discount > 0.09
   UNION ALL SELECT f, 'pattern', '{V}currency', 'Violation', cur, 'pattern ^[A-Q]$ is not met' FROM (SELECT DISTINCT f, cur FROM pay) WHERE cur = 'R'
   UNION ALL SELECT f, 'in', '{V}currency', 'Violation', cur, 'in A, N is not met' FROM (SELECT DISTINCT f, cur FROM pay) WHERE cur = 'R'
   UNION ALL SELECT f, 'hasValue', '{V}currency', 'Violation', NULL, 'hasValue N is not met' FROM pay GROUP BY f HAVING count(*) FILTER (cur = 'N') = 0
   UNION ALL SELECT f, 'minCount', '{V}toAccount', 'Violation', NULL, 'minCount 1 is not met' FROM (SELECT DISTINCT f, l_suppkey FROM pay) WHERE l_suppkey % 3 = 0)"""

# With inference a beneficiary is an account too, one without number and owner.
_INFERRED = (
    _SHAPED.removesuffix(")")
    + f"""
   UNION ALL SELECT DISTINCT '{R}beneficiary-' || l_suppkey, 'minCount', '{V}accountNumber', 'Violation', NULL, 'An account needs one number.' FROM pay WHERE l_suppkey % 3 <> 0
   UNION ALL SELECT DISTINCT '{R}beneficiary-' || l_suppkey, 'minCount', '{V}ownedBy', 'Violation', NULL, 'minCount 1 is not met' FROM pay WHERE l_suppkey % 3 <> 0)"""
)


@registered(
    "validate",
    _INFERRED
    + f""" SELECT f AS focus_node, component, path, severity, v AS value, message,
      CASE WHEN f NOT LIKE '%payment%' THEN '{V}AccountShape' ELSE '{V}PaymentShape' END AS source_shape FROM report""",
)
def _(spark, sf):
    return shapes.validate(shaped_graph(spark, sf), shapes.shape_frame(spark, _constraints()), axioms(spark))


@registered(
    "conforms",
    _INFERRED
    + """ SELECT count(*) FILTER (severity = 'Violation') = 0 AS conforms, count(*) FILTER (severity = 'Violation') AS violations,
      count(*) FILTER (severity = 'Warning') AS warnings, count(*) FILTER (severity = 'Info') AS infos FROM report""",
)
def _(spark, sf):
    report = shapes.validate(shaped_graph(spark, sf), shapes.shape_frame(spark, _constraints()), axioms(spark))
    return shapes.conforms(report)


def _of(component: str) -> str:
    return _SHAPED + f" SELECT f AS focus_node, path, v AS value FROM report WHERE component = '{component}'"


def _component_query(component: str):
    def query(spark, sf):
        graph = shaped_graph(spark, sf)
        frame = shapes.shape_frame(spark, [c for c in _constraints() if c.component == component])
        types = shapes.types_of(graph)
        check = shapes.count_violations if component in shapes.COUNT_COMPONENTS else shapes.value_violations
        return check(graph, types, frame).select("focus_node", "path", "value")

    return query


for _component in (*shapes.COUNT_COMPONENTS, *shapes.VALUE_COMPONENTS):
    registered(f"shape_{_component}", _of(_component))(_component_query(_component))


@registered(
    "shape_languages",
    f"""SELECT '{R}entity-' || c_custkey AS focus_node, '{V}name' AS path, CAST(NULL AS VARCHAR) AS value FROM customer WHERE c_custkey % 3 = 1""",
)
def _(spark, sf):
    """One text in two languages is two values; every third customer has both."""
    rows = table(spark, sf, "customer").withColumn("second", F.when(F.col("c_custkey") % 3 == 1, F.col("c_name")))
    graph = rows_to_triples(
        rows,
        [
            Mapping(bank.ENTITY, RDF_TYPE, iri=V + "LegalEntity"),
            Mapping(bank.ENTITY, V + "name", column="c_name", lang="en"),
            Mapping(bank.ENTITY, V + "name", column="second", lang="es"),
        ],
    )
    one = shapes.Constraint(V + "EntityShape", V + "LegalEntity", V + "name", "maxCount", "1")
    found = shapes.count_violations(graph, shapes.types_of(graph), shapes.shape_frame(spark, [one]))
    return found.select("focus_node", "path", "value")


@registered(
    "shape_targets",
    f"""SELECT '{V}AccountShape' AS shape, '{R}account-' || o_orderkey AS focus FROM orders
    UNION SELECT '{V}PaymentShape', '{R}payment-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey FROM lineitem""",
)
def _(spark, sf):
    graph = shaped_graph(spark, sf)
    supers = inference.subclass_closure(axioms(spark))
    return shapes.targets(shapes.types_of(graph, supers), shapes.shape_frame(spark, _constraints()))
