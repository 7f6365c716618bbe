"""DuckDB SQL for the queries that SQL can state."""

from __future__ import annotations

from .codes import ENTRIES, PARTS, ROUNDS, SCALE
from .periods import LEAST, POWER
from .spans import WINDOW

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

WARC = """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), first AS (
    SELECT payload_digest, min(page_id) AS least FROM p WHERE payload_bytes >= 100 GROUP BY ALL
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN least <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN least <> page_id THEN least END AS refers_to
FROM p LEFT JOIN first USING (payload_digest)
"""

TOP_K = f"""
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v, row_number() OVER () AS place
    FROM embeddings WHERE vec_id IS NOT NULL AND {USABLE}
), scored AS (
    SELECT q.place, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM v AS q JOIN v AS c ON q.place <> c.place AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""


def vector_codes(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """Each round compares every part with every entry and takes the floors of means."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""near{r} AS (
    SELECT place, p.part, arg_min(entry, [far, entry]) AS entry, min(far) AS far, any_value(p.v) AS v
    FROM (SELECT place, p.part, entry, p.v,
              list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS far
          FROM parts AS p JOIN book{r} AS b USING (part)) AS p GROUP BY ALL
)""")
        if r < rounds:
            steps.append(f"""book{r + 1} AS (
    SELECT part, entry, coalesce(m.v, b.v) AS v
    FROM book{r} AS b LEFT JOIN (
        SELECT part, entry, list(mean ORDER BY d) AS v
        FROM (SELECT part, entry, d, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS mean
              FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM near{r}) GROUP BY ALL) GROUP BY ALL
    ) AS m USING (part, entry)
)""")
    return f"""
WITH v AS MATERIALIZED (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::HUGEINT) AS v, row_number() OVER () AS place
    FROM embeddings WHERE {USABLE}
), parts AS MATERIALIZED (
    SELECT place, part, v[len(v) * part // {parts} + 1 : len(v) * (part + 1) // {parts}] AS v FROM v, range({parts}) AS r(part)
), book0 AS (
    SELECT part, entry, p.v FROM parts AS p JOIN (
        SELECT place, row_number() OVER (ORDER BY vec_id, v) - 1 AS entry FROM v WHERE vec_id IS NOT NULL QUALIFY entry < {entries}
    ) USING (place)
), {", ".join(steps).replace(" AS (", " AS MATERIALIZED (")}, coded AS (
    SELECT place, string_agg(printf('%02x', entry::INT), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM near{rounds} GROUP BY place
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
    (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, d))
     FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM book{rounds})) AS codebooks_sha256
FROM v JOIN coded USING (place)
"""


# One step of CRC-32 for each bit of a byte, for each digit of the id.
CRC = """xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
        lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

PERIODIC_RUNS = f"""
WITH d0 AS MATERIALIZED (
    SELECT row_number() OVER () AS place, doc_id, {WORDS} AS w, {CRC} AS h FROM documents
), d AS MATERIALIZED (
    SELECT place, doc_id, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN list_transform(range(len(w)), lambda i:
        CASE WHEN i < (h // 10) % len(w) THEN w[i + 1]
        ELSE w[(h // 10) % len(w) + (i - (h // 10) % len(w)) % (1 + (len(w) - (h // 10) % len(w)) // (3 + (h // 10) % 8)) + 1] END) ELSE w END AS w
    FROM d0
), t AS MATERIALIZED (
    SELECT place, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d
), same AS (
    SELECT a.place, b.i - a.i AS q, a.i FROM t AS a JOIN t AS b USING (place, word) WHERE b.i > a.i AND b.i - a.i <= a.n // {POWER}
), runs AS MATERIALIZED (
    SELECT place, "start", length, min(q) AS period FROM (
        SELECT place, q, min(i) AS "start", count(*) + q AS length
        FROM (SELECT place, q, i, i - row_number() OVER (PARTITION BY place, q ORDER BY i) AS island FROM same) GROUP BY place, q, island
    ) WHERE length >= greatest({LEAST}, {POWER} * q) GROUP BY ALL
), best AS (
    SELECT * FROM (
        SELECT a.* FROM runs AS a WHERE NOT EXISTS (
            FROM runs AS b WHERE b.place = a.place AND (b.length * a.period > a.length * b.period
                OR b.length * a.period = a.length * b.period AND (b."start", b.period) < (a."start", a.period)))
    )
), gone AS (
    SELECT DISTINCT place, unnest(range("start" + period, "start" + length)) AS i FROM runs
), kept AS (
    SELECT place, string_agg(word, ' ' ORDER BY i) AS kept FROM t ANTI JOIN gone USING (place, i) GROUP BY place
), listed AS (
    SELECT place, count(*) AS n_runs, string_agg(concat("start", ',', length, ',', period, chr(10)), '' ORDER BY "start", period) AS listed FROM runs GROUP BY place
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, "start", length, period, 1000 * length // period AS exponent_milli,
    sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (place) LEFT JOIN kept USING (place) LEFT JOIN listed USING (place)
"""

REPEATED_SPANS = f"""
WITH d AS MATERIALIZED (
    SELECT row_number() OVER () AS place, doc_id, {WORDS} AS w FROM documents
), windows AS MATERIALIZED (
    SELECT place, i, sha256(array_to_string(w[i : i + {WINDOW - 1}], ' ')) AS k
    FROM (SELECT place, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})
), gone AS (
    SELECT DISTINCT place, unnest(range(i, i + {WINDOW})) AS i FROM windows SEMI JOIN (SELECT k FROM windows GROUP BY k HAVING count(*) > 1) USING (k)
), kept AS (
    SELECT place, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept
    FROM (SELECT place, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d) ANTI JOIN gone USING (place, i) GROUP BY place
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (place)
"""

ORACLES = {
    "op6_warc": WARC,
    "op10_top_k": TOP_K,
    "op11_vector_codes": vector_codes(),
    "op12_periodic_runs": PERIODIC_RUNS,
    "op13_repeated_spans": REPEATED_SPANS,
}
