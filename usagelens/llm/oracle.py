"""SQL for DuckDB of the queries that SQL can express."""

from __future__ import annotations

# Words, their windows (10 words, or the whole of a shorter item) and all places in documents
# where a window occurs, by equality of joined words.
OP6 = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, i, grams.n, item_id FROM grams JOIN win ON grams.g = win.g AND grams.n = win.n),
hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_V = "list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))"


def op11(clusters: int = 40, rounds: int = 5, dimensions: int = 64) -> str:
    """Every round by all distances; centroids are one list of lists."""
    square = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [
        f"v AS (SELECT vec_id, {_V} AS v FROM embeddings WHERE len(embedding) = {dimensions}"
        " AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0)",
        f"""c0 AS (SELECT list(v ORDER BY k) AS cs FROM (SELECT v, row_number() OVER (
  ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)) NULLS LAST, vec_id, v) AS k FROM v) WHERE k <= {clusters})""",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (SELECT vec_id, v, list_position(ds, list_min(ds)) AS k, list_min(ds) AS d
  FROM (SELECT vec_id, v, list_transform(cs, lambda c: {square}) AS ds FROM v, c{r}))"""
        )
        if r < rounds:
            steps.append(
                f"""s{r} AS (SELECT k, i, (s - ((s % n) + n) % n) // n AS m FROM (SELECT k, i, sum(v[i]) AS s, count(*) AS n
  FROM a{r}, range(1, {dimensions + 1}) AS t(i) GROUP BY k, i))"""
            )
            steps.append(f"m{r} AS (SELECT k, list(CAST(m AS BIGINT) ORDER BY i) AS c FROM s{r} GROUP BY k)")
            steps.append(
                f"""c{r + 1} AS MATERIALIZED (SELECT list(coalesce(m{r}.c, o.c) ORDER BY o.k) AS cs FROM
  (SELECT unnest(cs) AS c, unnest(range(1, len(cs) + 1)) AS k FROM c{r}) o LEFT JOIN m{r} USING (k))"""
            )
    return (
        "WITH "
        + ",\n".join(steps)
        + f"""
SELECT vec_id, CAST(k - 1 AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
  CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(cs[k], ',')) AS centroid_sha256 FROM a{rounds}, c{rounds}"""
    )


def all_sql() -> dict[str, str]:
    return {"op6_decontamination": OP6, "op11_centroid_clustering": op11()}
