"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from govgraph.llm import conversations, decontaminate, identifiers, language, mixing, near_text, near_vectors, packing, pages, quality, repeats, urls, vector_codes
from govgraph.llm.common import LOWER, UPPER, WORD, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


@query
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


ORACLES["op10_decontaminate"] = f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w
  FROM benchmark
), windows AS MATERIALIZED (
  SELECT DISTINCT item_id, array_to_string(w[i : i + 9], ' ') AS phrase, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), grams AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), found AS MATERIALIZED (
  SELECT doc_id, grams.n, i, item_id FROM grams JOIN windows USING (phrase, n)
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, item_id::varchar AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit,
       coalesce(n_items, 0)::bigint AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"))


@query
def op8_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


@query
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identifiers.identifiers(table(spark, sf_dir, "documents"))


@query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"))


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_text.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


ORACLES["op3_near_vectors"] = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, embedding::double[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), counts AS (
  SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0)::bigint AS n_links, component_id, component_id = vec_id AS kept
FROM embeddings JOIN least USING (vec_id) LEFT JOIN counts USING (vec_id)
"""


@query
def op9_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


@query
def op11_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op12_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.audited(table(spark, sf_dir, "conversations"))


def _edit(cost: str, letter: str, after: str, line: str = "''") -> str:
    return f"{{'c': {cost} + {after}.c, 'a': '{letter}' || {after}.a, 'r': {line} || {after}.r}}"


def _conversations_sql() -> str:
    """Costs, edits and repaired lines from every conversation's end to its start, one row a round."""
    user, assistant = r"'user:' || text || chr(10)", r"'assistant:' || text || chr(10)"
    add_user, add_assistant = "'user:' || chr(10)", "'assistant:' || chr(10)"
    own = r"role || ':' || text || chr(10)"

    def options(state: str, kept: dict[str, str], role: str, to: str) -> str:
        may = [_edit("2", "D", state), f"CASE WHEN fault < 2 THEN {_edit('1 + 5 * fault', 'R', to, role)} END"]
        may += [f"CASE WHEN fault < 2 AND initial = '{i}' THEN {_edit('5 * fault', 'K', s, own)} END" for i, s in kept.items()]
        return f"list_min([{', '.join(may)}])"

    states = {
        "q0": options("q0", {"s": "qs", "u": "qu"}, user, "qu"),
        "qs": options("qs", {"u": "qu"}, user, "qu"),
        "qu": options("qu", {"a": "qa"}, assistant, "qa"),
        "qa": options("qa", {"u": "qu"}, user, "qu"),
    }
    plain_states = ", ".join(f"{sql} AS {name}" for name, sql in states.items())
    return f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
    lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') AS k
  FROM conversations
), kinds AS (
  SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(
    list_prepend(4294967295::bigint, list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::bigint)),
    lambda c, b: xor(c // 256, t[(xor(c, b) & 255) + 1]))) % 20 AS kind
  FROM keyed, crc
), dealt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM kinds)
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM dealt
), rows AS MATERIALIZED (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS initial, lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS next,
         count(*) OVER (PARTITION BY conv_id) AS n,
         CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 2
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 3
              WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 1 ELSE 0 END AS fault
  FROM numbered
), walk AS (
  SELECT conv_id, max(n) + 1 AS i, {{'c': 0::bigint, 'a': '', 'r': ''}} AS q0,
         {{'c': 10::bigint, 'a': 'II', 'r': {add_user} || {add_assistant}}} AS qs,
         {{'c': 5::bigint, 'a': 'I', 'r': {add_assistant}}} AS qu, {{'c': 0::bigint, 'a': '', 'r': ''}} AS qa
  FROM rows GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, list_min([q0, {_edit('5', 'I', 'qu', add_user)}]), list_min([qs, {_edit('5', 'I', 'qu', add_user)}]), qu, qa
  FROM (
    SELECT conv_id, i, q0, qs, list_min([qu, {_edit('5', 'I', 'qa', add_assistant)}]) AS qu,
           list_min([qa, {_edit('5', 'I', 'qu', add_user)}]) AS qa
    FROM (
      SELECT w.conv_id, r.i, {plain_states}
      FROM walk w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i - 1))
), totals AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 2) AS blank,
         count(*) FILTER (fault = 3) AS duplicate, count(*) FILTER (fault = 1) AS truncated,
         count(*) FILTER (next IS NOT NULL AND initial || next NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::bigint AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(q0.c, 0) AS cost, coalesce(q0.a, '') AS audit,
       sha256(coalesce(left(q0.r, length(q0.r) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN totals t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN (SELECT conv_id, q0 FROM walk WHERE i = 1) w ON w.conv_id IS NOT DISTINCT FROM o.conv_id
"""


ORACLES["op12_repair_conversations"] = _conversations_sql()


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


def _vector_codes_sql() -> str:
    """Rounds written out one after the other; squared distances by products, exact in doubles at these magnitudes."""
    steps = [
        """v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
)""",
        """p AS MATERIALIZED (
  SELECT vec_id, label, k, x, list_inner_product(x, x) AS xx FROM (
    SELECT vec_id, label, k, e[k * (len(e) // 4) + 1 : (k + 1) * (len(e) // 4)] AS x FROM v, (SELECT unnest(range(4)) AS k))
)""",
        """b0 AS MATERIALIZED (
  SELECT k, row_number() OVER (PARTITION BY k ORDER BY vec_id) - 1 AS i, x AS y, xx AS yy FROM p
  WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 256)
)""",
    ]
    for r in range(5):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, label, k, x, n.i AS i, n.d AS d FROM (
    SELECT vec_id, any_value(label) AS label, k, any_value(x) AS x,
           min({{'d': xx + yy - 2 * list_inner_product(x, y), 'i': i}}) AS n
    FROM p JOIN b{r} USING (k) GROUP BY vec_id, k)
)""")
        if r < 4:
            steps.append(f"""b{r + 1} AS MATERIALIZED (
  SELECT k, i, coalesce(m.y, b.y) AS y, list_inner_product(coalesce(m.y, b.y), coalesce(m.y, b.y)) AS yy
  FROM b{r} b LEFT JOIN (
    SELECT k, i, list(s ORDER BY j) AS y FROM (
      SELECT k, i, j, floor(sum(c) / count(*)) AS s
      FROM (SELECT k, i, unnest(x) AS c, unnest(range(len(x))) AS j FROM a{r}) GROUP BY k, i, j)
    GROUP BY k, i) m USING (k, i)
)""")
    steps.append("""done AS MATERIALIZED (
  SELECT vec_id, any_value(label) AS label, string_agg(lower(printf('%02x', i)), '' ORDER BY k) AS code, sum(d)::bigint AS error
  FROM a4 GROUP BY vec_id
)""")
    steps.append("""digest AS (
  SELECT sha256(string_agg(array_to_string(list_transform(y, lambda c: c::bigint), ','), ',' ORDER BY k, i)) AS codebooks_sha256 FROM b4
)""")
    return "WITH " + ",\n".join(steps) + """
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::bigint AS label_error, codebooks_sha256 FROM done, digest
"""


ORACLES["op13_vector_codes"] = _vector_codes_sql()
