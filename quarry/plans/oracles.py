"""DuckDB SQL for the catalog's queries, written independently of their Spark plans."""

from __future__ import annotations

from quarry.operators.grid import MASK

TOKENS = r"unnest(regexp_extract_all(text, '[^ \t\n\r\f]+'))"
UNESCAPED = "replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&quot;', '\"'), '&apos;', '''')"
LETTERS = rf"""
w AS (SELECT {TOKENS} AS word FROM documents),
c AS (SELECT substr(word, 1, 1) AS ch, count(*) AS n FROM w WHERE regexp_matches(word, '^\p{{L}}') GROUP BY 1)"""
AVERAGES = f"""
w AS (SELECT doc_id, {TOKENS} AS key FROM documents),
n AS (SELECT doc_id, key, count(*) AS value FROM w GROUP BY ALL),
a AS (SELECT key, round(sum(value) / count(*)::DOUBLE, 9) AS average FROM n GROUP BY key)"""
PAGES = f"""
b AS (SELECT page_id, {UNESCAPED} AS body FROM pages),
t AS (SELECT page_id, body, regexp_extract(body, '<title>(.+?)</title>', 1) AS whole FROM b),
p AS (SELECT page_id AS page, regexp_extract(whole, '^[^ ]*') AS title, body FROM t WHERE whole <> ''),
k AS (SELECT page, title, unnest(regexp_extract_all(body, 'href="/([^"]+)"', 1)) AS raw FROM p),
l AS (SELECT page, title, CASE WHEN substr(raw, 1, 1) BETWEEN 'a' AND 'z' THEN upper(substr(raw, 1, 1)) || substr(raw, 2) ELSE raw END AS link FROM k),
v AS (SELECT * FROM l WHERE link IN (SELECT title FROM p))"""
ALL_EVENTS = """
n AS (SELECT DISTINCT user_id AS id FROM events),
q AS (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) AS dst FROM events),
e AS (SELECT * FROM q WHERE dst IS NOT NULL),
s AS (SELECT count(*)::DOUBLE AS pages, (SELECT count(*) FROM n WHERE id NOT IN (SELECT src FROM e))::DOUBLE AS lone FROM n)"""
PAGE_GRAPH = """
n AS (SELECT DISTINCT title AS id FROM p),
e AS (SELECT title AS src, link AS dst FROM v),
s AS (SELECT count(*)::DOUBLE AS pages, (SELECT count(*) FROM p WHERE page NOT IN (SELECT page FROM v))::DOUBLE AS lone FROM p)"""
ALL_NATIONS = """
e AS (SELECT s_nationkey AS src, c_nationkey AS dst, CAST(min(floor(l_extendedprice)) AS BIGINT) AS weight
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
d0 AS (SELECT src AS i, dst AS j, weight AS dist FROM e
       UNION ALL SELECT n_nationkey, n_nationkey, 0 FROM nation WHERE n_nationkey NOT IN (SELECT src FROM e WHERE src = dst))"""

EVENT_EDGES = """
e0 AS (SELECT event_id AS pos, user_id::INT AS src, ((event_id * 7 + user_id) % 61)::INT AS dst, event_id * 31 % 997 + 1 AS weight FROM events),
v AS (SELECT i::INT AS i FROM range((SELECT greatest(max(src), max(dst)) + 1 FROM e0)) t(i)),
e AS (SELECT src, dst, arg_max(weight, pos) AS weight FROM e0 GROUP BY src, dst),
d0 AS (SELECT src AS i, dst AS j, weight AS dist FROM e UNION ALL SELECT i, i, 0 FROM v WHERE i NOT IN (SELECT src FROM e WHERE src = dst))"""


def _steps(count: int) -> str:
    """Unrolled PageRank: ``r0`` to ``r<count>`` over ``n, e, s``."""
    out = "o AS (SELECT src, count(*)::DOUBLE AS deg FROM e GROUP BY src), r0 AS (SELECT id, 0::DOUBLE AS old, 1 / s.pages AS pr FROM n, s)"
    for i in range(1, count + 1):
        mass = "(SELECT lone / pages FROM s)" if i == 1 else f"(SELECT coalesce(sum(pr), 0) FROM r{i - 1} WHERE id NOT IN (SELECT src FROM o))"
        out += f""",
g{i} AS (SELECT dst, sum(pr / deg) AS got FROM e JOIN o USING (src) JOIN r{i - 1} ON id = src GROUP BY dst),
r{i} AS (SELECT r.id, r.pr AS old, 15e-2 / s.pages + 85e-2 * (coalesce(got, 0) + {mass} / s.pages) AS pr FROM r{i - 1} r CROSS JOIN s LEFT JOIN g{i} ON dst = r.id)"""
    return out


def _squared_with_loops(count: int) -> str:
    """Where loops stand on the diagonal, shorter paths must be carried along."""
    out = ""
    for i in range(1, count + 1):
        through = f"SELECT a.i, b.j, a.dist + b.dist AS dist FROM d{i - 1} a JOIN d{i - 1} b ON a.j = b.i"
        out += f", d{i} AS (SELECT i, j, min(dist) AS dist FROM (SELECT * FROM d{i - 1} UNION ALL {through}) GROUP BY i, j)"
    return out


def _converged(most: int) -> str:
    """The ranks before the first step whose input error is below the tolerance."""
    found = " UNION ALL ".join(f"SELECT {i} AS step, sum(abs(pr - old)) AS error FROM r{i}" for i in range(most + 1))
    state = " UNION ALL ".join(f"SELECT {i} AS step, id, pr FROM r{i}" for i in range(most + 1))
    return f"""x AS ({found}), y AS ({state}), z AS (SELECT min(step) AS step FROM x WHERE error < 1e-3)
SELECT id, round(pr, 9) AS pr FROM y WHERE step = (SELECT step FROM z)"""


MANDELBROT = """
f AS (SELECT x::INT AS x, y::INT AS y, -2e0 + x * (3e0 / 48) AS cx, -1e0 + y * (2e0 / 32) AS cy FROM range(48) a(x), range(32) b(y)),
z AS (SELECT x, y, cx, cy, 0e0 AS zx, 0e0 AS zy, 0 AS i FROM f
      UNION ALL SELECT x, y, cx, cy, zx * zx - zy * zy + cx, 2 * zx * zy + cy, i + 1 FROM z WHERE i < 60 AND zx * zx + zy * zy <= 4),
m AS (SELECT x, y, max(i)::INT AS iter FROM z GROUP BY x, y)"""


def _sobel() -> str:
    rows = ", ".join(f"({u - 2}, {v - 2}, {MASK[u][v]}, {MASK[v][u]})" for u in range(5) for v in range(5))
    size = ", ".join(f"CAST(least(255, floor(sqrt((pow(sum({c} * a), 2) + pow(sum({c} * b), 2))::DOUBLE) / 8)) AS INT) AS {c}" for c in ("r", "g", "bl"))
    return f"""
WITH m(u, v, a, b) AS (VALUES {rows}),
i AS (SELECT x, y, (x * 7 + y * 3 + x * y) % 256 AS r, (x * 2 + y * 11 + x * y) % 256 AS g, (x * 5 + y * 5 + x * y) % 256 AS bl FROM range(48) p(x), range(32) q(y)),
o AS (SELECT x - u AS x, y - v AS y, {size} FROM i, m WHERE x - u BETWEEN 0 AND 47 AND y - v BETWEEN 0 AND 31 GROUP BY 1, 2)
SELECT x::INT AS x, y::INT AS y, r, g, bl AS b FROM o"""


def sql() -> dict[str, str]:
    by_pages = f"WITH {PAGES}, {PAGE_GRAPH}, {_steps(5)}"
    by_all_events, all_nations = f"WITH {ALL_EVENTS}, {_steps(5)}", f"WITH {ALL_NATIONS}{_squared_with_loops(5)}"
    pairs = "SELECT i, j, dist FROM d5"
    users = f"""WITH {ALL_EVENTS.rsplit("s AS", 1)[0]}
f AS (SELECT DISTINCT src, dst, (src * 31 + dst * 17) % 997 + 1 AS weight FROM e),
d0 AS (SELECT src AS i, dst AS j, weight AS dist FROM f UNION ALL SELECT id, id, 0 FROM n WHERE id NOT IN (SELECT src FROM f WHERE src = dst)){_squared_with_loops(8)}"""
    trace = " UNION ALL ".join(f"SELECT {i} AS step, round(sum(abs(pr - old)), 9) AS error FROM r{i}" for i in range(5))
    return {
        "first_letter_count": f"WITH {LETTERS} SELECT ch, n FROM c",
        "first_letter_partitioned": f"WITH {LETTERS} SELECT ch, n, CASE WHEN lower(ch) BETWEEN 'a' AND 'g' THEN 0 ELSE 1 END AS part FROM c",
        "first_letter_ordered": f"WITH {LETTERS} SELECT ch, n, CAST(row_number() OVER (ORDER BY lower(ch), ch) AS INT) AS pos FROM c",
        "word_average": f"WITH {AVERAGES} SELECT key, average FROM a",
        "word_average_sorted": f"WITH {AVERAGES} SELECT key, average, row_number() OVER (ORDER BY average DESC, key) AS pos FROM a",
        "key_mod_partition": f"WITH w AS (SELECT DISTINCT {TOKENS} AS key FROM documents) SELECT key, CAST(unicode(key) % 3 AS INT) AS part FROM w",
        "average_range_partition": """
WITH a AS (SELECT l_partkey AS key, round(sum(l_quantity) / count(*), 9) AS average FROM lineitem GROUP BY 1),
s AS (SELECT *, (average - 10) / (30e0 / 8) AS step FROM a)
SELECT key, average, CAST(least(greatest(8 - (CASE WHEN step < 0 THEN ceil(step) ELSE floor(step) END) - 1, 0), 7) AS INT) AS part FROM s""",
        "placed_letters": f"""
WITH {LETTERS}, p AS (SELECT *, CASE WHEN lower(ch) BETWEEN 'a' AND 'g' THEN 0 ELSE 1 END AS file FROM c)
SELECT file, row_number() OVER (PARTITION BY file ORDER BY lower(ch), ch) - 1 AS place, ch, n FROM p""",
        "placed_keys": f"""
WITH w AS (SELECT DISTINCT {TOKENS} AS key FROM documents), p AS (SELECT key, CAST(unicode(key) % 3 AS INT) AS file FROM w)
SELECT file, row_number() OVER (PARTITION BY file ORDER BY key) - 1 AS place, key FROM p""",
        "placed_averages": """
WITH a AS (SELECT l_partkey AS key, round(sum(l_quantity) / count(*), 9) AS average FROM lineitem GROUP BY 1),
s AS (SELECT *, (average - 10) / (30e0 / 8) AS step FROM a),
p AS (SELECT *, CAST(least(greatest(8 - (CASE WHEN step < 0 THEN ceil(step) ELSE floor(step) END) - 1, 0), 7) AS INT) AS file FROM s)
SELECT file, row_number() OVER (PARTITION BY file ORDER BY average DESC, key) - 1 AS place, key, average FROM p""",
        "placed_ranks": f"""{by_all_events}, x AS (SELECT id, round(pr, 9) AS pr FROM r5),
p AS (SELECT *, CAST(CASE WHEN pr < 0 OR pr >= 31e-3 THEN 31 ELSE floor(pr / 1e-3) END AS INT) AS file FROM x)
SELECT file, row_number() OVER (PARTITION BY file ORDER BY pr DESC, id) - 1 AS place, id, pr FROM p""",
        "adjacency_lines": f"WITH {PAGES} SELECT title AS src, count(*)::INT AS degree FROM v GROUP BY 1",
        "edges_by_range": f"""
WITH {EVENT_EDGES}, s AS (SELECT count(*)::BIGINT // 8 AS small, count(*) % 8 AS extra FROM v)
SELECT CAST(CASE WHEN src < extra * (small + 1) THEN src // (small + 1) ELSE extra + (src - extra * (small + 1)) // greatest(small, 1) END AS INT) AS part,
       src, count(*) AS n, CAST(sum(weight) AS BIGINT) AS weight FROM e0, s GROUP BY ALL""",
        "kv_text_average": "SELECT 'part ' || l_partkey AS key, round(avg(floor(l_quantity)), 9) AS average FROM lineitem GROUP BY 1",
        "wiki_links": """
WITH p AS (SELECT c_custkey AS k, 'Customer-' || c_custkey AS title FROM customer),
l AS (SELECT title, unnest(['Nation ' || c_nationkey, 'Customer-' || (c_custkey + 1), 'Customer-' || (c_custkey // 2), title]) AS link FROM p JOIN customer ON k = c_custkey)
SELECT title, link, count(*) AS n FROM l WHERE link IN (SELECT title FROM p) GROUP BY ALL""",
        "edge_file_roundtrip": f"WITH {EVENT_EDGES}{_squared_with_loops(11)} SELECT a.i, b.i AS j, CAST(coalesce(dist, 999999999) AS INT) AS dist FROM v a CROSS JOIN v b LEFT JOIN d11 ON d11.i = a.i AND d11.j = b.i",
        "float_file_sort": "SELECT row_number() OVER (ORDER BY value::FLOAT) - 1 AS pos, value::FLOAT::DOUBLE AS value FROM events",
        "image_roundtrip": """
WITH p AS (SELECT p_partkey % 48 AS x, p_partkey // 48 AS y, p_size * 5 % 256 AS r, p_partkey * 3 % 256 AS g, floor(p_retailprice)::BIGINT % 256 AS b FROM part),
f AS (SELECT x, y FROM range(48) a(x), range((SELECT max(y) + 1 FROM p)) c(y))
SELECT kind, f.x::INT AS x, f.y::INT AS y, coalesce(r, 0)::INT AS r, coalesce(g, 0)::INT AS g, coalesce(b, 0)::INT AS b
FROM f CROSS JOIN (VALUES ('png'), ('bmp')) t(kind) LEFT JOIN p USING (x, y)""",
        "xml_unescape": f"SELECT page_id, {UNESCAPED} AS body FROM pages",
        "page_titles": f"WITH {PAGES} SELECT DISTINCT title FROM p",
        "title_count": f"WITH {PAGES} SELECT count(*) AS n_pages FROM p",
        "page_links": f"WITH {PAGES} SELECT page, title, link, count(*) AS n FROM l GROUP BY ALL",
        "valid_links": f"WITH {PAGES} SELECT page, title, link, count(*) AS n FROM v GROUP BY ALL",
        "dangling_pages": f"WITH {PAGES} SELECT page, title FROM p WHERE page NOT IN (SELECT page FROM v)",
        "out_degree": f"WITH {PAGES} SELECT title AS src, count(*) AS degree FROM v GROUP BY 1",
        "adjacency": f"WITH {PAGES} SELECT title AS src, string_agg(link, '|' ORDER BY link) AS links FROM v GROUP BY 1",
        "pagerank_pages_k5": f"{by_pages} SELECT id, round(pr, 9) AS pr FROM r5",
        "pagerank_all_events_k5": f"{by_all_events} SELECT id, round(pr, 9) AS pr FROM r5",
        "pagerank_all_events_ranked": f"{by_all_events}, x AS (SELECT id, round(pr, 9) AS pr FROM r5) SELECT id, pr, row_number() OVER (ORDER BY pr DESC, id) AS pos FROM x",
        "pagerank_all_events_buckets": f"{by_all_events}, x AS (SELECT id, round(pr, 9) AS pr FROM r5) SELECT id, pr, CAST(CASE WHEN pr < 0 OR pr >= 31e-3 THEN 31 ELSE floor(pr / 1e-3) END AS INT) AS bucket FROM x",
        "pagerank_all_events_error_trace": f"{by_all_events} {trace}",
        "pagerank_all_events_converged": f"WITH {ALL_EVENTS}, {_steps(12)}, {_converged(12)}",
        "apsp_all_orders": f"{all_nations} {pairs}",
        "apsp_all_orders_dense": f"{all_nations} SELECT a.n_nationkey AS i, b.n_nationkey AS j, coalesce(dist, 999999999) AS dist FROM nation a CROSS JOIN nation b LEFT JOIN d5 ON i = a.n_nationkey AND j = b.n_nationkey",
        "apsp_all_orders_blocked": f"{all_nations} {pairs}",
        "apsp_all_events_blocked": f"{users} SELECT i, j, dist FROM d8",
        "sssp_all_orders": f"{all_nations} SELECT j AS id, CASE WHEN j = 0 THEN 0 ELSE dist END AS dist FROM d5 WHERE i = 0",
        "position_diff_whole": """
WITH a AS (SELECT row_number() OVER (ORDER BY p_size, p_partkey) - 1 AS pos, p_partkey AS left_value FROM part),
b AS (SELECT row_number() OVER (ORDER BY p_size, p_partkey DESC) - 1 AS pos, p_partkey AS right_value FROM part)
SELECT pos, left_value, right_value FROM a FULL JOIN b USING (pos) WHERE left_value IS DISTINCT FROM right_value""",
        "float_sort": "SELECT row_number() OVER (ORDER BY value::FLOAT) - 1 AS pos, value::FLOAT::DOUBLE AS value FROM events",
        "block_assign": "SELECT row_number() OVER (ORDER BY value::FLOAT) - 1 AS pos, CAST(ntile(7) OVER (ORDER BY value::FLOAT) - 1 AS INT) AS block FROM events",
        "mandelbrot_iters": f"WITH RECURSIVE {MANDELBROT} SELECT x, y, iter FROM m",
        "mandelbrot_rgb": f"""WITH RECURSIVE {MANDELBROT}
SELECT x, 31 - y AS y, CASE WHEN iter = 60 THEN 0 WHEN iter & 16 <> 0 THEN 240 ELSE iter % 16 * 16 END AS r,
       CASE WHEN iter <> 60 AND iter & 16 <> 0 THEN iter % 16 * 16 ELSE 0 END AS g, CASE WHEN iter <> 60 AND iter & 16 <> 0 THEN iter % 16 * 16 ELSE 0 END AS b FROM m""",
        "sobel_edges": _sobel(),
        "sobel_join": _sobel(),
        "pi_riemann": "SELECT round(4 * sum(sqrt(1 - pow(i / 1e6, 2))) / 1e6, 9) AS pi FROM range(1000000) t(i)",
        "prime_count": "SELECT count(*) AS n_primes FROM range(2, 20000) a(i) WHERE NOT EXISTS (SELECT 1 FROM range(2, 142) b(d) WHERE d < i AND d * d <= i AND i % d = 0)",
        "primes": "SELECT i AS prime FROM range(2, 20000) a(i) WHERE NOT EXISTS (SELECT 1 FROM range(2, 142) b(d) WHERE d < i AND d * d <= i AND i % d = 0)",
    }
