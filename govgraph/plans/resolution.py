"""SQL for term resolution: the ratio of matching blocks as a recursion over segments of two texts."""

from __future__ import annotations


def resolution_sql(terms: str, labels: str, limit: int, least: float = 0.25) -> str:
    """CTEs that end in ``resolved (term, rank, iri, label, score, matched_on)``; they start with ``terms AS``.

    ``terms`` selects ``term``; ``labels`` selects ``iri, predicate_rank, matched_on, norm, label``. For texts
    under 200 letters, where the matcher has no rule for frequent letters.
    """
    return f"""terms AS (SELECT DISTINCT term, trim(term) AS query FROM ({terms})),
    labels AS ({labels}),
    queries AS (SELECT query AS x, row_number() OVER (ORDER BY query) AS qid FROM (SELECT DISTINCT query FROM terms)),
    norms AS (SELECT norm AS y, row_number() OVER (ORDER BY norm) AS nid FROM (SELECT DISTINCT norm FROM labels)),
    runs AS MATERIALIZED (
      SELECT qid, nid, i, j, list_max(list_filter(range(1, least(length(x) - i, length(y) - j) + 2),
               lambda n: substr(x, i, n) = substr(y, j, n))) AS k
      FROM (SELECT qid, x, unnest(range(1, length(x) + 1)) AS i FROM queries) q
      JOIN (SELECT nid, y, unnest(range(1, length(y) + 1)) AS j FROM norms) n ON substr(x, i, 1) = substr(y, j, 1)),
    segments AS (
      SELECT qid, nid, 1::bigint AS alo, length(x) + 1 AS ahi, 1::bigint AS blo, length(y) + 1 AS bhi, 0::bigint AS size FROM queries, norms
      UNION ALL
      SELECT qid, nid, unnest([alo, m.k - m.i]), unnest([-m.i, ahi]), unnest([blo, m.k - m.j]), unnest([-m.j, bhi]), unnest([m.k, 0])
      FROM (SELECT s.qid, s.nid, alo, ahi, blo, bhi, max({{'k': least(k, ahi - i, bhi - j), 'i': -i, 'j': -j}}) AS m
            FROM segments s JOIN runs r ON r.qid = s.qid AND r.nid = s.nid AND i >= alo AND i < ahi AND j >= blo AND j < bhi
            GROUP BY s.qid, s.nid, alo, ahi, blo, bhi)),
    ratios AS (
      SELECT x, y, 2.0 * sum(size)::double / greatest(length(x) + length(y), 1) AS r
      FROM segments JOIN queries USING (qid) JOIN norms USING (nid) GROUP BY x, y),
    scores AS (
      SELECT x, y, CASE WHEN x = y THEN 1.0::double WHEN contains(x, y) OR contains(y, x) THEN greatest(0.84::double, r)
                   ELSE r * 0.78::double END AS raw FROM ratios),
    best AS (
      SELECT x, iri, min({{'low': -printf('%.4f', raw)::double, 'rank': predicate_rank, 'norm': norm, 'label': label, 'on': matched_on}}) AS b
      FROM scores JOIN labels ON norm = y WHERE raw >= {least} GROUP BY x, iri),
    ranked AS (
      SELECT x, iri, b.label AS label, -b.low AS score, b."on" AS matched_on,
             row_number() OVER (PARTITION BY x ORDER BY b.low, b.label, iri) AS rank FROM best),
    resolved AS (
      SELECT term, rank::int AS rank, iri, label, score, matched_on FROM terms JOIN ranked ON x = query WHERE rank <= {limit})"""
