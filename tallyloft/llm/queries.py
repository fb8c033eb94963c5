"""The queries of this subpackage, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloft.llm import bit_sliced, chat, language, mixing, order_minhash, packing, quality, simhash, toxicity, url_filter
from tallyloft.llm.common import remainder_is, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


URL_RULES = [
    url_filter.site_rule("net/", "block"),
    url_filter.site_rule("example.net/en/", "allow"),
    url_filter.site_rule("example.com/de/", "block"),
    url_filter.site_rule("org/fr/", "allow"),
]


@query(
    "op1_url_filter",
    """
    WITH parts AS (
      SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest
      FROM pages
    ), split AS (
      SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw_host, rest FROM parts
    ), canonical AS (
      SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path
      FROM split
    ), rules(rule, rule_host, rule_path, rule_verdict) AS (
      VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
             ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
    ), hits AS (
      SELECT c.page_id, c.host, c.path, r.rule, r.rule_verdict
      FROM canonical c LEFT JOIN rules r
        ON (c.host = r.rule_host OR ends_with(c.host, '.' || r.rule_host)) AND starts_with(c.path, r.rule_path)
    )
    SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule,
           coalesce(arg_max(rule_verdict, length(rule)), 'allow') AS verdict
    FROM hits GROUP BY page_id, host, path
    """,
)
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


@query("op3_simhash_near_dedup")
def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder_is("doc_id", 4, 2)
    model = language.fit(docs, learn=~held_out)
    return language.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model)


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder_is("doc_id", 3, 1)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn=~held_out)
    return toxicity.score(docs.select("doc_id", held_out.alias("held_out"), "text"), model, keep_text=False)


@query(
    "op5_exact_top_k",
    """
    WITH valid AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
      SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM valid q JOIN valid c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
    ), ranked AS (
      SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
      FROM scored
    )
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
)
def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return bit_sliced.top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


@query("op6_order_minhash")
def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edited_likeness(table(spark, sf_dir, "documents"))


@query("op4_mixing")
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return mixing.mix(docs, power=0.9)


def _escaped(sql: str) -> str:
    return f"regexp_replace({sql}, '([<\\[])(\\\\*){chat.CONTROL}', '" + r"\1\2\\\3', 'g')"


@query(
    "op7_chat_windows",
    """
    WITH raw AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
    ), lined AS (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS n, CAST(ceil(length(text) / 4.0) AS BIGINT) + 5 AS len,
             24 + length(ROLE) + length(TEXT) AS size
      FROM raw
    ), heads AS (
      SELECT conv_id, max(CASE WHEN len <= 512 THEN len ELSE 0 END) AS longest, max(CASE WHEN n = 0 AND role = 'system' THEN len END) AS sys FROM lined GROUP BY conv_id
    ), measured AS (
      SELECT l.*, coalesce(sys <= 1024, false) AS repeats, n = 0 AND role = 'system' AS leads, len > 512 AND NOT (n = 0 AND role = 'system') AS alone,
             greatest(512, 2048 - 256 - CASE WHEN sys <= 1024 THEN sys ELSE 0 END - longest) AS stride
      FROM lined l JOIN heads USING (conv_id)
    ), summed AS (
      SELECT *, coalesce(sum(CASE WHEN leads THEN 0 ELSE len END) OVER upto, 0) AS before, coalesce(sum(CASE WHEN leads OR alone THEN 0 ELSE len END) OVER upto, 0) AS small,
             coalesce(sum(CASE WHEN alone THEN 1 ELSE 0 END) OVER upto, 0) AS larges
      FROM measured WINDOW upto AS (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), placed AS (
      SELECT *, CASE WHEN alone THEN 0 ELSE floor(small / stride) END AS stride_no FROM summed
    ), opens AS (
      SELECT conv_id, min(n) AS win, min(before) AS opens FROM placed GROUP BY conv_id, larges, alone, stride_no
    ), again AS (
      SELECT p.conv_id, sum(p.size) AS chars FROM placed p JOIN opens o ON o.conv_id = p.conv_id AND o.win > p.n AND CASE WHEN p.leads THEN p.repeats ELSE o.opens - p.before <= 256 END GROUP BY p.conv_id
    ), whole AS (
      SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
             coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '') AS loss, sum(size) AS chars
      FROM placed GROUP BY conv_id
    )
    SELECT w.conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
           CAST(w.chars + coalesce(a.chars, 0) AS BIGINT) AS formatted_chars
    FROM whole w LEFT JOIN again a ON a.conv_id = w.conv_id
    """.replace("ROLE", _escaped(r"replace(replace(role, '\', '\\'), chr(10), '\n')")).replace("TEXT", _escaped("text")),
)
def op7_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.sql(
        "SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(planted)
    return chat.digests(chat.windows(rows))


@query("op9_best_fit_packing")
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    model, scores = quality.fit(table(spark, sf_dir, "documents"), labels.filter("quality = 1"))
    return quality.judge(scores, model).select("doc_id", "lang", "chars", "perplexity", "smoothed", "threshold", "keep")
