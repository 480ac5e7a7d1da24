"""A small bank graph with known answers."""

from govgraph.operators import context as c
from govgraph.operators import triples as t
from govgraph.operators.triples import RDF_TYPE, RESOURCE, VOCAB
from govgraph.plans import questions as q

V, R = VOCAB, RESOURCE

CLASSES = {
    "Party": "BusinessConcept",
    "LegalEntity": "Party",
    "Account": "BusinessConcept",
    "Payment": "BusinessConcept",
    "SanctionsEntry": "BusinessConcept",
}
PROPERTIES = {
    "hasAccount": ("LegalEntity", "Account"),
    "ownedBy": ("Account", "LegalEntity"),
    "beneficialOwnerOf": ("Party", "LegalEntity"),
    "targetsParty": ("SanctionsEntry", "Party"),
    "fromAccount": ("Payment", "Account"),
    "toAccount": ("Payment", "Account"),
}
PARTIES = [
    ("party-p-1001", "CRM", "P-1001"),
    ("party-aml-77", "AML_CASES", "AML-77"),
    ("party-p-1002", "CRM", "P-1002"),
]
PAYMENTS = [
    ("PAY-5001", "ES120001", "125000.00", "EUR"),
    ("PAY-5002", "ES120001", "17000.00", "USD"),
    ("PAY-5003", "ES120002", "320.00", "EUR"),
]


def iri(s, p, o):
    return (s, p, o, "iri", None, None)


def text(s, p, o, datatype=t.XSD_STRING):
    return (s, p, o, "literal", datatype, None)


def rows():
    out = [iri(V + a, t.SUBCLASS_OF, V + b) for a, b in CLASSES.items()]
    for name, (domain, range_) in PROPERTIES.items():
        out += [iri(V + name, t.DOMAIN, V + domain), iri(V + name, t.RANGE, V + range_)]
    out.append(iri(V + "hasAccount", t.INVERSE_OF, V + "ownedBy"))
    out.append(iri(q.POSSIBLE_DUPLICATE_OF, RDF_TYPE, t.SYMMETRIC))
    for concept, label, alternative in (
        ("UltimateBeneficialOwner", "Ultimate Beneficial Owner", "UBO"),
        ("CustomerIdentifier", "Customer Identifier", "CIF number"),
        ("Name", "Name", None),
    ):
        out.append(iri(V + concept, RDF_TYPE, t.SKOS + "Concept"))
        out.append(text(V + concept, t.PREF_LABEL, label))
        if alternative:
            out.append(text(V + concept, t.ALT_LABEL, alternative))
    for name, system, _record in PARTIES:
        out += [iri(R + name, RDF_TYPE, V + "Party"), text(R + name, c.SOURCE_SYSTEM, system)]
        out.append(iri(R + name, c.EVIDENCE, R + "evidence-" + name))
    out.append(iri(R + "party-aml-77", q.POSSIBLE_DUPLICATE_OF, R + "party-p-1001"))
    for party, entity, account in (
        ("party-p-1001", "entity-le-2001", "ES120001"),
        ("party-p-1002", "entity-le-2002", "ES120002"),
    ):
        out += [
            iri(R + party, q.BENEFICIAL_OWNER_OF, R + entity),
            iri(R + entity, q.HAS_ACCOUNT, R + account),
            text(R + account, V + "accountNumber", account),
        ]
    out += [
        iri(R + "entity-le-3001", q.HAS_ACCOUNT, R + "DE890001"),
        text(R + "DE890001", V + "accountNumber", "DE890001"),
    ]
    for name, account, amount, currency in PAYMENTS:
        out += [
            iri(R + name, RDF_TYPE, q.PAYMENT),
            iri(R + name, q.FROM_ACCOUNT, R + account),
            iri(R + name, q.TO_ACCOUNT, R + "DE890001"),
            text(R + name, q.AMOUNT, amount, t.XSD_DECIMAL),
            text(R + name, q.CURRENCY, currency),
        ]
    out += [
        iri(R + "EU-998", RDF_TYPE, q.SANCTIONS_ENTRY),
        iri(R + "EU-998", q.TARGETS_PARTY, R + "party-p-1001"),
    ]
    mapping = R + "mapping-crm-cif"
    out += [
        iri(mapping, RDF_TYPE, t.MAPPING_PROPOSAL),
        text(mapping, t.MAPPING_ID, "mapping-crm-cif"),
        text(mapping, c.FIELD_NAME, "cif_no"),
        text(mapping, t.PROPOSAL_STATUS, "HUMAN_REVIEW"),
        iri(mapping, c.MAPS_TO, V + "CustomerIdentifier"),
        text(mapping, c.COUNTEREXAMPLE, "CIF-0042 is used twice."),
        iri(mapping, c.EVIDENCE, R + "evidence-crm-schema-cif"),
        iri(mapping, c.EVIDENCE, R + "evidence-crm-profile-cif"),
        iri(mapping, q.COUNTEREVIDENCE, R + "evidence-crm-cif-duplicate-0042"),
        text(R + "evidence-crm-schema-cif", c.LOCATOR, "crm.csv#field=cif_no"),
    ]
    for name, score in (("lexical", "0.96"), ("structural", "0.92"), ("instance", "0.88")):
        out.append(text(mapping, c.CONFIDENCES[name], score, t.XSD_DECIMAL))
    ubo = R + "mapping-crm-ubo"
    out += [
        iri(ubo, RDF_TYPE, t.MAPPING_PROPOSAL),
        text(ubo, c.FIELD_NAME, "ubo"),
        iri(ubo, c.MAPS_TO, V + "UltimateBeneficialOwner"),
    ]
    for name, kind in (("CQ-001", "CompetencyQuestion"), ("CQ-002", "CompetencyQuestion"), ("rel-1", "DerivedRelation")):
        out += [iri(R + name, q.DEPENDS_ON, ubo), iri(R + name, RDF_TYPE, V + kind)]
        out.append(iri(R + name, RDF_TYPE, t.OWL_THING))
    return out


def graph(spark):
    schema = "s string, p string, o string, o_kind string, o_datatype string, o_lang string"
    return spark.createDataFrame(rows(), schema)
