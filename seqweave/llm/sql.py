"""SQL for those queries of this subpackage that it can express."""

ORACLE: dict[str, str] = {}

ORACLE["op1_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha256(coalesce(html, '')) AS payload_digest,
         octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM f
"""

ORACLE["op4_mixing"] = """
WITH sums AS (
  SELECT coalesce(source, '') AS source, sum(coalesce(octet_length(encode(text)), 0)::DOUBLE) AS bytes FROM documents GROUP BY 1),
weights AS (SELECT source, bytes, pow(bytes, 0.5) AS weight FROM sums),
whole AS (SELECT sum(bytes) AS all_bytes, sum(weight) AS all_weight FROM weights),
rates AS (SELECT source, CASE WHEN bytes > 0 THEN all_bytes * (weight / all_weight) / bytes ELSE 0 END AS rate FROM weights, whole),
terms AS (
  SELECT source, k, exp(-rate + k * ln(greatest(rate, 1e-300)) - lgamma(k + 1.0)) AS p
  FROM rates, range(0, 200) t(k)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS total FROM terms),
drawn AS (
  SELECT *, (('0x' || substr(md5('mix-1|' || doc_id), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u FROM documents),
counted AS (
  SELECT d.doc_id, count(c.k) AS n_copies FROM drawn d JOIN cdf c ON coalesce(d.source, '') = c.source AND c.total <= d.u GROUP BY d.doc_id)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, i::INT AS copy, n_copies::INT AS n_copies,
       md5('mix-1|order|' || d.doc_id || '|' || i) AS shuffle_key
FROM documents d JOIN counted USING (doc_id), range(0, n_copies) r(i)
"""

ORACLE["op10_jaccard"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM k JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 90 * (a.n + b.n - k)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
reach(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x),
c AS (SELECT x, min(y) AS low FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.low, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.x = d.doc_id
"""


def _centroids(rounds: int = 3, k: int = 16) -> str:
    """The seeds, then in each round the nearest centroids and the rounded means."""
    near = "SELECT vec_id, v, min({'distance': list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'cluster': cluster}) AS m FROM v, c%d GROUP BY vec_id, v"
    steps = [
        "v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)",
        f"c0 AS (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1)::INT AS cluster, v AS c FROM v QUALIFY cluster < {k})",
    ]
    for i in range(1, rounds + 1):
        steps += [
            f"a{i} AS ({near % (i - 1)})",
            f"s{i} AS (SELECT m.cluster AS cluster, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{i}, range(1, 65) t(i) GROUP BY ALL)",
            f"n{i} AS (SELECT cluster, list((s - (s % n + n) % n) // n ORDER BY i) AS c FROM s{i} GROUP BY cluster)",
            f"c{i} AS (SELECT cluster, coalesce(n{i}.c, c{i - 1}.c) AS c FROM c{i - 1} LEFT JOIN n{i} USING (cluster))",
        ]
    steps.append(f"a AS (SELECT vec_id, m.cluster AS cluster, m.distance AS distance FROM ({near % rounds}))")
    return f"WITH {', '.join(steps)} SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a JOIN c{rounds} USING (cluster)"


ORACLE["op11_centroids"] = _centroids()
