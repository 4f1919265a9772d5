"""The operators as registered queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import (collocations, decontaminate, filter_audit, language, licenses, near_dup, packing, parsing_dedup, secrets, simhash,
                           token_files, topk, toxicity)
from tidewatch.llm.common import crc_mod, ship, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Score from which a document is called toxic.
TOXIC_FROM = 0.3


def query(name: str, sql: str | None = None):
    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text")


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").where("toxic IS NOT NULL AND doc_id IS NOT NULL")
    learn = docs.join(labels.where(crc_mod("doc_id", 4) != 2), "doc_id").select("text", "toxic")
    model = toxicity.fit(learn)
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return toxicity.score(docs, model, ["doc_id", held]).withColumn("predicted", (F.col("score") >= TOXIC_FROM).cast("int"))


@query("op2_near_duplicates")
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(documents(spark, sf_dir))


@query("op3_prefix_free_parsing")
def op3_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing_dedup.remove_repeats(documents(spark, sf_dir))


@query("op4_license_scan")
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


@query("op5_token_files")
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digest(documents(spark, sf_dir))


@query("op6_decontaminate")
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query("op7_topk")
def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return topk.search(vectors.where(F.col("vec_id") % 50 == 0), vectors, k=5)


@query("op8_language")
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = language.fit(docs.where(crc_mod("doc_id", 5) != 0))
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return language.predict(docs.select("doc_id", "text"), model, ["doc_id", held])


@query("op9_secrets")
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


@query("op10_best_two_fit")
def op10_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


OP11_SQL = r"""
WITH marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
base AS (SELECT d.doc_id, coalesce(d.source, '') AS part, coalesce(d.text, '') AS t, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic
  FROM documents d LEFT JOIN marks m USING (doc_id)),
worded AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM base),
failing AS (SELECT part, good, toxic,
    (CASE WHEN len(w) < 50 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN first < doc_id THEN 'E' ELSE '' END) AS fails
  FROM worded),
cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failing GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
placed AS (SELECT part, fails, n, good, toxic, filter_order, step, substr(filter_order, step, 1) AS f,
    list_min(list_filter(range(1, 6), lambda i: contains(fails, substr(filter_order, i, 1)))) AS goes
  FROM cells, orders, (SELECT unnest(range(1, 6)) AS step)),
counted AS (SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (goes IS NULL OR goes > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (goes = step), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (contains(fails, f) AND goes < step), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = f), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (goes = step), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (goes = step), 0)::BIGINT AS toxic_lost
  FROM placed GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM counted
"""

OP13_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
worded AS (SELECT lang, w FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces) WHERE len(w) > 0),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded),
grams AS (SELECT lang, k, w[i:i + k - 1] AS g FROM places, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, g, count(*)::HUGEINT AS a FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT * FROM f WHERE k > 1 AND a >= 30),
cuts AS (SELECT c.lang, c.g, c.a, j, l.a AS l, r.a AS r, (2000000 * c.a) // (l.a + r.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM candidates) c
  JOIN f l ON l.lang = c.lang AND l.g = c.g[1:j] JOIN f r ON r.lang = c.lang AND r.g = c.g[j + 1:c.k]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
inner_parts AS (SELECT lang, g[i:i + m - 1] AS g, a FROM (SELECT *, unnest(range(1, k)) AS i FROM candidates WHERE k > 2), (SELECT unnest([2, 3]) AS m)
  WHERE m < k AND i + m - 1 <= k),
dropped AS (SELECT DISTINCT c.lang, c.g FROM candidates c JOIN inner_parts p ON p.lang = c.lang AND p.g = c.g WHERE 100 * p.a >= 80 * c.a),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(g, ' '))) AS rank, array_to_string(g, ' ') AS phrase,
    a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, score::BIGINT AS score
  FROM best ANTI JOIN dropped USING (lang, g))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


@query("op11_filter_audit", OP11_SQL)
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents", "doc_id", "text", "source"), table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


@query("op12_simhash")
def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


@query("op13_collocations", OP13_SQL)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
