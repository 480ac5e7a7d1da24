from govgraph.functions.digest import (
    canonical_json_text,
    canonical_sha256,
    canonical_struct,
    deterministic_id,
    evidence_id,
    set_digest,
    snapshot_id,
)
from govgraph.functions.identity import normalize_model, normalize_provider
from govgraph.functions.paths import (
    column_locator,
    field_locator,
    generation_locator,
    line_locator,
    parse_object_path,
    pointer_locator,
    row_locator,
    safe_segment,
    table_locator,
)
from govgraph.functions.text import casefold, collapse_spaces, nfkc, ratcliff_ratio
from govgraph.functions.times import utc_second, valid_utc_day, valid_utc_instant, valid_utc_second

__all__ = [name for name in dir() if not name.startswith("_")]
