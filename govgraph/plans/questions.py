"""The five reviewed multi-hop questions over a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govgraph.operators.context import (
    CONFIDENCES,
    COUNTEREXAMPLE,
    EVIDENCE,
    FIELD_NAME,
    MAPS_TO,
    SOURCE_SYSTEM,
)
from govgraph.operators.patterns import (
    bgp,
    optional,
    order_by,
    pattern,
    project,
    project_distinct,
    where,
)
from govgraph.operators.triples import MAPPING_ID, MAPPING_PROPOSAL, OWL_THING, RDF_TYPE, VOCAB

SANCTIONS_ENTRY = VOCAB + "SanctionsEntry"
TARGETS_PARTY = VOCAB + "targetsParty"
BENEFICIAL_OWNER_OF = VOCAB + "beneficialOwnerOf"
HAS_ACCOUNT = VOCAB + "hasAccount"
PAYMENT = VOCAB + "Payment"
FROM_ACCOUNT = VOCAB + "fromAccount"
TO_ACCOUNT = VOCAB + "toAccount"
AMOUNT = VOCAB + "amount"
CURRENCY = VOCAB + "currency"
POSSIBLE_DUPLICATE_OF = VOCAB + "possibleDuplicateOf"
COUNTEREVIDENCE = VOCAB + "counterevidence"
DEPENDS_ON = VOCAB + "dependsOn"


def _sanctioned_accounts(triples: DataFrame) -> DataFrame:
    return bgp(
        pattern(triples, "?sanction", RDF_TYPE, SANCTIONS_ENTRY),
        pattern(triples, "?sanction", TARGETS_PARTY, "?party"),
        pattern(triples, "?party", BENEFICIAL_OWNER_OF, "?entity"),
        pattern(triples, "?entity", HAS_ACCOUNT, "?account"),
    )


def cq_sanctioned_accounts(triples: DataFrame) -> DataFrame:
    """CQ-001: accounts linked to sanctioned parties through beneficial ownership."""
    found = project_distinct(
        _sanctioned_accounts(triples), ["sanction", "party", "entity", "account"]
    )
    return order_by(found, ["account"])


def cq_sanctioned_payments(triples: DataFrame) -> DataFrame:
    """CQ-002: payments out of those accounts, with the beneficiary where known."""
    # The accounts are made distinct before they meet the payments.
    accounts = _sanctioned_accounts(triples).select("account").distinct()
    paid = bgp(
        accounts,
        pattern(triples, "?payment", FROM_ACCOUNT, "?account"),
        pattern(triples, "?payment", RDF_TYPE, PAYMENT),
        pattern(triples, "?payment", AMOUNT, "?amount"),
        pattern(triples, "?payment", CURRENCY, "?currency"),
    )
    full = optional(paid, pattern(triples, "?payment", TO_ACCOUNT, "?beneficiaryAccount"))
    columns = ["payment", "account", "amount", "currency", "beneficiaryAccount"]
    return order_by(project_distinct(full, columns), ["payment"])


def cq_duplicate_parties(triples: DataFrame) -> DataFrame:
    """CQ-003: proposed duplicates, once per pair, with sources and evidence."""
    # The direction is chosen on the links, before they meet the other facts.
    links = where(
        pattern(triples, "?party", POSSIBLE_DUPLICATE_OF, "?duplicate"),
        F.col("party") < F.col("duplicate"),
    )
    found = bgp(
        links,
        pattern(triples, "?party", SOURCE_SYSTEM, "?partySource"),
        pattern(triples, "?party", EVIDENCE, "?evidence"),
        pattern(triples, "?duplicate", SOURCE_SYSTEM, "?duplicateSource"),
    )
    columns = ["party", "duplicate", "partySource", "duplicateSource", "evidence"]
    return order_by(project_distinct(found, columns), ["party", "duplicate"])


def cq_mapping_evidence(triples: DataFrame, mapping_id: str | None = None) -> DataFrame:
    """CQ-004: why a field is mapped: evidence by counterevidence, as a bag.

    Without an id the question is asked of every mapping.
    """
    asked = pattern(triples, "?mapping", MAPPING_ID, "?mappingId" if mapping_id is None else mapping_id)
    found = bgp(
        pattern(triples, "?mapping", RDF_TYPE, MAPPING_PROPOSAL),
        asked.select("mapping"),
        pattern(triples, "?mapping", FIELD_NAME, "?field"),
        pattern(triples, "?mapping", MAPS_TO, "?concept"),
        pattern(triples, "?mapping", EVIDENCE, "?evidence"),
        pattern(triples, "?mapping", COUNTEREVIDENCE, "?counterevidence"),
    )
    found = optional(found, pattern(triples, "?mapping", COUNTEREXAMPLE, "?counterexample"))
    for name in ("lexical", "structural", "instance"):
        found = optional(found, pattern(triples, "?mapping", CONFIDENCES[name], f"?{name}"))
    columns = ["mapping", "field", "concept", "evidence", "counterevidence", "counterexample"]
    bag = project(found, [*columns, "lexical", "structural", "instance"])
    return order_by(bag, ["mapping", "evidence", "counterevidence"])


def cq_change_impact(triples: DataFrame, field: str) -> DataFrame:
    """CQ-005: what depends on the mapping of a field, with types except the top class."""
    found = bgp(
        pattern(triples, "?mapping", FIELD_NAME, field),
        pattern(triples, "?mapping", RDF_TYPE, MAPPING_PROPOSAL),
        pattern(triples, "?mapping", MAPS_TO, "?concept"),
        pattern(triples, "?dependency", DEPENDS_ON, "?mapping"),
        where(
            pattern(triples, "?dependency", RDF_TYPE, "?dependencyType"),
            F.col("dependencyType") != OWL_THING,
        ),
    )
    columns = ["mapping", "concept", "dependency", "dependencyType"]
    return order_by(project_distinct(found, columns), ["dependency"])
