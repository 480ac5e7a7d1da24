"""One spelling per model provider and model family."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from govgraph.functions.text import casefold, nfkc

# Provider spellings that mean the same provider.
PROVIDER_ALIASES = {
    "anthropic": "anthropic",
    "anthropic-ai": "anthropic",
    "claude": "anthropic",
    "open-ai": "openai",
    "openai": "openai",
    "gemini": "google-vertex-ai",
    "google": "google-vertex-ai",
    "google-cloud-vertex-ai": "google-vertex-ai",
    "google-genai": "google-vertex-ai",
    "google-generative-ai": "google-vertex-ai",
    "google-vertex": "google-vertex-ai",
    "google-vertex-ai": "google-vertex-ai",
    "vertex": "google-vertex-ai",
    "vertex-ai": "google-vertex-ai",
}
# Provider words in front of a model name, and release suffixes after it.
MODEL_PREFIX = r"^(google-vertex-ai|vertex-ai|anthropic|openai|google|models?)-+"
MODEL_SUFFIXES = (
    r"-(vertex|preview|snapshot)-20[0-9]{6}\z",
    r"-20[0-9]{2}-[0-9]{2}-[0-9]{2}\z",
    r"-20[0-9]{6}\z",
    r"-(latest|stable)\z",
)


def _slug(value: Column, ascii_only: bool) -> Column:
    folded = F.lower(F.trim(value)) if ascii_only else casefold(F.trim(nfkc(value)))
    return F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9]+", "-"), r"^-+|-+\z", "")


def normalize_provider(value: Column, ascii_only: bool = False) -> Column:
    slug = _slug(value, ascii_only)
    aliases = F.create_map(*[F.lit(x) for pair in PROVIDER_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(aliases, slug), slug)


def normalize_model(value: Column, ascii_only: bool = False) -> Column:
    """Last path part, without provider prefix and without any release suffixes."""
    leaf = F.substring_index(F.regexp_replace(F.trim(value), r"/+\z", ""), "/", -1)
    base = F.regexp_replace(_slug(leaf, ascii_only), MODEL_PREFIX, "")
    # One anchored pattern that swallows all suffixes at once, in any order and
    # number, has the same fixpoint as stripping them one by one.
    any_suffix = "(" + "|".join(s.removesuffix(r"\z") for s in MODEL_SUFFIXES) + ")"
    return F.regexp_replace(base, any_suffix + r"+\z", "")
