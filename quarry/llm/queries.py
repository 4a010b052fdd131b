"""Queries that apply the corpus operators, with production parameters, to their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.bpe import bpe, digests

    return digests(bpe(_table(spark, sf_dir, "documents"), word_tokenizer()))


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files ``source/lang/thousand/id.txt``; one whose whole text is a notice counts for its directory."""
    from pyspark.sql import functions as F

    from quarry.llm.licences import licence_scan

    docs = _table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 1000).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licence_scan(docs.withColumn("path", path), whole_file=F.lit(True))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.exact import exact_groups

    return exact_groups(_table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.neardup import near_groups

    return near_groups(_table(spark, sf_dir, "documents"), words=5, percent=85)


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.topk import top_k

    vectors = _table(spark, sf_dir, "embeddings")
    return top_k(vectors.filter("vec_id % 50 = 0"), vectors, k=5)


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.repeats import repeated_passages

    return repeated_passages(_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.quality import classify, train

    docs = _table(spark, sf_dir, "documents")
    return classify(docs, train(docs, _table(spark, sf_dir, "labels")))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.webtext import extract

    return extract(_table(spark, sf_dir, "pages"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.tokenfile import token_files

    return token_files(_table(spark, sf_dir, "documents"), word_tokenizer())


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from quarry.llm.periodic import periodic_runs, run_digests, with_loops

    docs = _table(spark, sf_dir, "documents").select("doc_id", with_loops(F.col("text"), F.col("doc_id")).alias("text"))
    return run_digests(periodic_runs(docs))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.vectorcodes import vector_codes

    return vector_codes(_table(spark, sf_dir, "embeddings")).rows.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.descent import nearest_neighbours

    vectors = _table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors.filter("vec_id % 50 = 0"), vectors, k=5)


def queries() -> dict[str, Query]:
    return {
        "op1_bpe": op1_bpe,
        "op2_licences": op2_licences,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_mixing": op4_mixing,
        "op5_near_dedup": op5_near_dedup,
        "op6_top_k": op6_top_k,
        "op7_repeats": op7_repeats,
        "op8_quality": op8_quality,
        "op9_main_text": op9_main_text,
        "op10_token_files": op10_token_files,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_vector_codes": op12_vector_codes,
        "op13_neighbours": op13_neighbours,
    }


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op3_exact_dedup": f"""
WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents),
     g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
""",
    "op5_near_dedup": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE
               WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM d)),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
     l AS (SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * c >= 85 * (i.n + j.n - c)),
     e AS (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
     r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id, min(c) = doc_id AS kept
FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
""",
    "op6_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id,
                  CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
}


def _licence_sql() -> str:
    from quarry.llm.licences import APART, FULL, PARAGRAPH, SPDX, SPDX_END, TEMPLATES, TERM, _counts, full_counts, spdx_names, told

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(n)}, {i}, {quoted(t)})" for n, texts in TEMPLATES.items() for i, t in enumerate(texts))
    # The same table of whole licences, as their terms' counts.
    full = ", ".join(f"({quoted(name)}, {quoted(' '.join(c))}, {list(c.values())})" for name, c in full_counts().items())
    needs = [(n, i, told(_counts(t))) for n, texts in TEMPLATES.items() for i, t in enumerate(texts)]
    musts = ", ".join(f"({quoted(n)}, {i}, {quoted(m)})" for n, i, (must, _) in needs for m in sorted(must))
    families = ", ".join(f"({quoted(n)}, {i}, {len(must)}, {str(family).lower()})" for n, i, (must, family) in needs)
    apart = ", ".join(map(quoted, sorted(APART)))
    spdx = ", ".join(map(quoted, spdx_names()))
    terms = lambda x: f"unnest(regexp_extract_all(lower({x}), '{TERM}'))"
    return f"""
WITH t(licence, k, txt) AS (VALUES {values}),
mu(licence, k, term) AS (VALUES {musts}),
fa(licence, k, need, family) AS (VALUES {families}),
tt AS (SELECT licence, k, term, count(*) AS tf FROM (SELECT licence, k, {terms("txt")} AS term FROM t) GROUP BY ALL),
d AS (SELECT doc_id, coalesce(text, '') AS text,
             concat_ws('/', source, lang, CAST(CAST(floor(doc_id / 1000) AS BIGINT) AS VARCHAR), doc_id || '.txt') AS path FROM documents),
df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, {terms("text")} AS term FROM d) GROUP BY term),
idf AS (SELECT DISTINCT tt.term, ln(((SELECT count(*) FROM d) + 1) / (coalesce(df, 0) + 1)::DOUBLE) + 1 AS idf FROM tt LEFT JOIN df USING (term)),
w AS (SELECT licence, k, term, tf * idf / sqrt(sum(pow(tf * idf, 2)) OVER (PARTITION BY licence, k)) AS weight FROM tt JOIN idf USING (term)),
u AS (SELECT doc_id, kind, row_number() OVER () AS spot, unit FROM (
        SELECT doc_id, 0 AS kind, unnest(string_split(text, chr(10))) AS unit FROM d
        UNION ALL SELECT doc_id, 1, p FROM (SELECT doc_id, unnest(regexp_split_to_array(text, {quoted(PARAGRAPH)})) AS p FROM d) WHERE contains(trim(p), chr(10))
        UNION ALL SELECT doc_id, 2, text FROM d)),
tf AS (SELECT doc_id, kind, spot, term, count(*) AS tf FROM (SELECT doc_id, kind, spot, {terms("unit")} AS term FROM u) GROUP BY ALL),
norm AS (SELECT spot, sqrt(sum(pow(tf * coalesce(idf, ln((SELECT count(*) FROM d) + 1) + 1), 2))) AS norm, count(*) FILTER (term IN ({apart})) AS others FROM tf LEFT JOIN idf USING (term) GROUP BY spot),
hit AS (SELECT doc_id, kind, licence, round(sum(tf * idf * weight) / any_value(norm), 9) AS cosine
        FROM tf JOIN w USING (term) JOIN idf USING (term) JOIN norm USING (spot) JOIN fa USING (licence, k) LEFT JOIN mu USING (licence, k, term)
        GROUP BY doc_id, kind, spot, licence, k
        HAVING count(mu.term) = any_value(need) AND (NOT any_value(family) OR count(*) FILTER (tf.term IN ({apart})) = any_value(others))),
said AS (SELECT doc_id, regexp_replace(regexp_extract(text, {quoted(SPDX)}, 1), {quoted(SPDX_END)}, '') AS licence FROM d WHERE contains(text, 'SPDX-License-Identifier:')),
best AS (SELECT doc_id, arg_min(licence, {{'c': -cosine, 'l': licence}}) AS licence, max(cosine) AS cosine FROM hit WHERE cosine >= 6e-1 GROUP BY doc_id),
own AS (SELECT doc_id, coalesce(s.licence, best.licence) AS licence, CASE WHEN s.licence IS NULL THEN best.cosine ELSE 1e0 END AS cosine
        FROM best FULL JOIN (SELECT * FROM said WHERE licence IN ({spdx})) s USING (doc_id)),
file AS (SELECT doc_id, arg_min(licence, {{'c': -cosine, 'l': licence}}) AS file_licence, max(cosine) AS file_cosine FROM hit WHERE cosine >= 6e-1 AND kind = 2 GROUP BY doc_id),
ft AS (SELECT licence, unnest(string_split(ts, ' ')) AS term, unnest(ns) AS tf FROM (VALUES {full}) AS x(licence, ts, ns)),
wt AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {terms("regexp_replace(text, '(?i)(^|' || chr(10) || ')[ ' || chr(9) || ']*copyright" + chr(92) + "b[^' || chr(10) || ']*', ' ', 'g')")} AS term FROM d) GROUP BY ALL),
wdf AS (SELECT term, count(*) AS df FROM wt GROUP BY term),
widf AS (SELECT DISTINCT ft.term, ln(((SELECT count(*) FROM d) + 1) / (coalesce(df, 0) + 1)::DOUBLE) + 1 AS idf FROM ft LEFT JOIN wdf USING (term)),
wn AS (SELECT doc_id, sqrt(sum(pow(tf * coalesce(idf, ln((SELECT count(*) FROM d) + 1) + 1), 2))) AS norm FROM wt LEFT JOIN widf USING (term) GROUP BY doc_id),
fw AS (SELECT licence, term, tf * idf / sqrt(sum(pow(tf * idf, 2)) OVER (PARTITION BY licence)) AS weight FROM ft JOIN widf USING (term)),
whit AS (SELECT doc_id, licence, round(sum(wt.tf * idf * weight) / any_value(norm), 9) AS cosine
         FROM wt JOIN fw USING (term) JOIN widf USING (term) JOIN wn USING (doc_id) GROUP BY doc_id, licence),
wbest AS (SELECT doc_id, arg_min(licence, {{'c': -cosine, 'l': licence}}) AS licence, max(cosine) AS cosine FROM whit WHERE cosine >= {FULL} GROUP BY doc_id),
own0 AS (SELECT doc_id, coalesce(wbest.licence, own.licence) AS licence, coalesce(wbest.cosine, own.cosine) AS cosine FROM own FULL JOIN wbest USING (doc_id)),
file0 AS (SELECT doc_id, coalesce(wbest.licence, file_licence) AS file_licence, coalesce(wbest.cosine, file_cosine) AS file_cosine FROM file FULL JOIN wbest USING (doc_id)),
dir AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, arg_min(path, {{'c': -file_cosine, 'p': path}}) AS inherited_from, arg_min(file_licence, {{'c': -file_cosine, 'p': path}}) AS inherited
        FROM d JOIN file0 AS file USING (doc_id) GROUP BY 1),
near AS (SELECT path, arg_max(inherited, length(dir)) AS inherited, arg_max(inherited_from, length(dir)) AS inherited_from
         FROM d JOIN dir ON dir = '' OR starts_with(path, dir || '/') GROUP BY path)
SELECT d.doc_id, d.path, own.licence, own.cosine, file_licence IS NOT NULL AS licence_file,
       CASE WHEN own.licence IS NULL THEN near.inherited END AS inherited, CASE WHEN own.licence IS NULL THEN near.inherited_from END AS inherited_from
FROM d LEFT JOIN own0 AS own USING (doc_id) LEFT JOIN file0 AS file USING (doc_id) LEFT JOIN near USING (path)
"""


def _codes_sql() -> str:
    far = "list_sum(list_transform(list_zip(p.x, b{r}.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    sql = """
WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, k, e[k * (len(e) // 4) + 1:(k + 1) * (len(e) // 4)] AS x FROM v, range(4) t(k)),
b0 AS MATERIALIZED (SELECT k, dense_rank() OVER (ORDER BY vec_id) - 1 AS i, x FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 256))"""
    for r in range(5):
        sql += f""",
a{r} AS MATERIALIZED (SELECT vec_id, p.k, min({{'far': CAST({far.format(r=r)} AS BIGINT), 'i': b{r}.i}}) AS best FROM p JOIN b{r} ON p.k = b{r}.k GROUP BY vec_id, p.k)"""
        if r < 4:
            sql += f""",
s{r} AS (SELECT k, i, spot, CAST(sum(c) AS BIGINT) AS s, count(*) AS n FROM (SELECT p.k, best.i AS i, unnest(p.x) AS c, unnest(range(len(p.x))) AS spot FROM p JOIN a{r} a ON a.vec_id = p.vec_id AND a.k = p.k) GROUP BY ALL),
m{r} AS (SELECT k, i, list((s - ((s % n) + n) % n) // n ORDER BY spot) AS x FROM s{r} GROUP BY k, i),
b{r + 1} AS MATERIALIZED (SELECT b.k, b.i, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN m{r} m ON m.k = b.k AND m.i = b.i)"""
    return sql + """,
c AS MATERIALIZED (SELECT vec_id, string_agg(printf('%02x', best.i), '' ORDER BY k) AS code, CAST(sum(best.far) AS BIGINT) AS error FROM a4 GROUP BY vec_id),
l AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM c JOIN v USING (vec_id) GROUP BY label),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY k, i)) AS codebooks_sha256 FROM b4)
SELECT c.vec_id, code, error, label_error, codebooks_sha256 FROM c JOIN v USING (vec_id) JOIN l ON l.label IS NOT DISTINCT FROM v.label, h
"""


def oracle_sql() -> dict[str, str]:
    return ORACLE_SQL | {"op2_licences": _licence_sql(), "op12_vector_codes": _codes_sql()}
