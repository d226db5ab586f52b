"""Named queries of the operators over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import (
    decontaminate,
    hyperlang,
    jaccard_groups,
    license_scan,
    packing,
    perplexity,
    pfor,
    pii,
    quality_rules,
    simhash_planes,
    storage,
    token_alignment,
    toxicity,
    whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_token_blocks")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = storage.fresh_folder(spark, "token-blocks")
    pfor.write_ids(table(spark, sf_dir, "documents"), path)
    return pfor.read_ids(spark, path)


@query("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


_WORDS_SQL = """
lowered AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{pattern}') AS w FROM lowered)"""

_OP4_SQL = f"""
WITH {_WORDS_SQL.format(pattern=r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+').strip()},
items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
cuts AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
    FROM items WHERE len(w) > 0),
wanted AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS t FROM cuts),
sizes AS (SELECT DISTINCT n FROM wanted),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words JOIN sizes ON len(w) >= n),
hits AS (SELECT p.doc_id, p.i, p.n, x.item_id
    FROM (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS t FROM places) p JOIN wanted x USING (n, t)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
    FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    n_hit IS NOT NULL AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


@query("op4_benchmark_windows", _OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


_OP7_SQL = f"""
WITH RECURSIVE {_WORDS_SQL.format(pattern=r'[^\x20\x09-\x0D]+').strip()},
grams AS (SELECT DISTINCT doc_id, unnest(CASE
        WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id
    GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * o >= 90 * (x.n + y.n - o)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, b AS other FROM edges UNION
    SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = reach.other),
least AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
SELECT words.doc_id, coalesce(n, 0) AS n_shingles, least(words.doc_id, coalesce(other, words.doc_id)) AS component_id
FROM words LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON least.doc_id = words.doc_id
"""


@query("op7_token_group_join", _OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups.link_documents(table(spark, sf_dir, "documents"))


@query("op10_hyperdimensional_language")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperlang.identify(table(spark, sf_dir, "documents"))


@query("op8_class_kneser_ney")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_crf_personal_data")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [f"n_{k}" for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans")


@query("op3_ngram_likelihood_rules")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _op2_sql() -> str:
    quoted = [(name, text.replace("'", "''")) for name, text in license_scan.TEMPLATES]
    templates = ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(quoted))

    comment = license_scan.COMMENT.replace("'", "''")

    def terms(text: str) -> str:
        low = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        return f"regexp_extract_all({low}, '[a-z0-9]+')"

    return f"""
WITH templates(k, name, text) AS (VALUES {templates}),
t_terms AS (SELECT k, name, unnest({terms('text')}) AS term FROM templates),
files AS (SELECT doc_id, '/' || source || '/' || lang AS dir, text, {terms("coalesce(text, '')")} AS w FROM documents),
total AS (SELECT count(*) AS n FROM files),
df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(w) AS term FROM files) GROUP BY term),
vocabulary AS (SELECT DISTINCT term FROM t_terms),
idf AS (SELECT term, ln(((SELECT n FROM total) + 1) / (coalesce(df, 0) + 1)) + 1 AS idf
    FROM vocabulary LEFT JOIN df USING (term)),
t_weights AS (SELECT k, name, term, count(*) * max(idf) AS v FROM t_terms JOIN idf USING (term) GROUP BY ALL),
t_norms AS (SELECT k, sqrt(sum(v * v)) AS norm FROM t_weights GROUP BY k),
units AS (
    SELECT doc_id, line, {terms('unit')} AS w FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS unit, generate_subscripts(string_split(text, chr(10)), 1) AS line
        FROM files WHERE text IS NOT NULL)
    UNION ALL SELECT doc_id, -1, w FROM files
    UNION ALL SELECT doc_id, line, {terms('unit')} AS w FROM (
        SELECT doc_id, unnest(p) AS unit, -2 * generate_subscripts(p, 1) AS line
        FROM (SELECT doc_id, regexp_split_to_array(text, '{license_scan.GAP}') AS p FROM files)
        UNION ALL SELECT doc_id, unnest(p), -2 * generate_subscripts(p, 1) - 1
        FROM (SELECT doc_id, regexp_split_to_array(array_to_string(list_transform(string_split(text, chr(10)),
            lambda l: CASE WHEN regexp_matches(l, '{comment}') THEN l ELSE '' END), chr(10)), '{license_scan.GAP}') AS p FROM files))
        WHERE contains(unit, chr(10))),
u_terms AS (SELECT doc_id, line, term, count(*) AS tf FROM (SELECT doc_id, line, unnest(w) AS term FROM units) GROUP BY ALL),
u_weights AS (SELECT doc_id, line, term, tf * coalesce(idf, ln((SELECT n FROM total) + 1) + 1) AS v
    FROM u_terms LEFT JOIN idf USING (term)),
u_norms AS (SELECT doc_id, line, sum(v * v) AS norm FROM u_weights GROUP BY ALL),
near AS (SELECT doc_id, line, name, round(sum(u.v * t.v / t_norms.norm) / sqrt(max(u_norms.norm)), 9) AS cosine
    FROM u_weights u JOIN t_weights t USING (term) JOIN t_norms USING (k) JOIN u_norms USING (doc_id, line)
    GROUP BY doc_id, line, k, name HAVING cosine >= 0.8),
best AS (SELECT doc_id, line, min({{'c': -cosine, 'name': name}}) AS best FROM near GROUP BY ALL),
own AS (SELECT doc_id, min(best) AS best, count(*) FILTER (line >= 1) AS n_lines,
    greatest(coalesce(sum(len(w)) FILTER (line >= 1), 0), coalesce(sum(len(w)) FILTER (line = -1), 0),
        coalesce(sum(len(w)) FILTER (line < -1 AND line % 2 = 0), 0),
        coalesce(sum(len(w)) FILTER (line < -1 AND line % 2 <> 0), 0)) AS n_matched FROM best JOIN units USING (doc_id, line) GROUP BY doc_id),
given AS (SELECT dir, min(best) AS given FROM own JOIN files USING (doc_id) WHERE n_matched >= 0.5 * len(w) GROUP BY dir),
parents AS (SELECT DISTINCT dir, unnest([dir, regexp_replace(dir, '/[^/]*$', '')]) AS up FROM files),
nearest AS (SELECT p.dir, arg_max(up, length(up)) AS up, arg_max(given, length(up)) AS given
    FROM parents p JOIN given g ON g.dir = p.up GROUP BY p.dir)
SELECT doc_id, coalesce(own.best.name, nearest.given.name) AS licence,
    coalesce(-own.best.c, -nearest.given.c) AS similarity, coalesce(n_lines, 0) AS n_lines,
    own.best IS NOT NULL AS own, CASE WHEN own.best IS NULL THEN up END AS inherited_from
FROM files LEFT JOIN own USING (doc_id) LEFT JOIN nearest USING (dir)
"""


@query("op2_licence_inheritance", _op2_sql())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"))
    found = license_scan.scan(docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), "text"))
    return found.withColumnRenamed("file_id", "doc_id")


@query("op5_kneser_ney_perplexity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_tokenizer_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.summarise(table(spark, sf_dir, "documents"))


@query("op12_simhash_planes")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_planes.near_duplicates(table(spark, sf_dir, "documents"))


@query("op13_embedding_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
