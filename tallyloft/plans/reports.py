"""Further queries: operations reports, set operations, capabilities, audits, evidence and discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloft.functions import text, timing, url
from tallyloft.operators import evidence, folding
from tallyloft.operators.latest import latest
from tallyloft.plans.queries import LATEST, OBS, OFF, query
from tallyloft.sources.tables import observations, offers, table


# ------------------------------------------------------------------ operations
@query("queue_status", """SELECT o_orderstatus, o_orderpriority, count(*) AS jobs, min(o_orderdate) AS oldest, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1996-01-01') AS overdue FROM orders GROUP BY 1, 2""")
def queue_status(spark, sf_dir):
    overdue = F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("jobs"), F.min("o_orderdate").alias("oldest"), F.count_if(overdue).alias("overdue"))


@query("source_priorities", f"""WITH {OFF}, s AS (SELECT source, count(*) FILTER (WHERE NOT active) AS pending, count(*) FILTER (WHERE km > 45000) AS overdue, count(*) FILTER (WHERE variant IS NULL AND mfg_year IS NULL) AS gaps, min(observed_at) AS oldest FROM offers GROUP BY source)
  SELECT source, pending, overdue, gaps, 2 * pending + overdue + 5 * gaps AS score, oldest, concat_ws('|', CASE WHEN pending > 0 THEN 'clear_queue' END, CASE WHEN overdue > 0 THEN 'renew' END, CASE WHEN gaps > 0 THEN 'repair_parser' END) AS actions FROM s""")
def source_priorities(spark, sf_dir):
    s = offers(spark, sf_dir).groupBy("source").agg(F.count_if(~F.col("active")).alias("pending"), F.count_if(F.col("km") > 45000).alias("overdue"), F.count_if(F.col("variant").isNull() & F.col("mfg_year").isNull()).alias("gaps"), F.min("observed_at").alias("oldest"))
    act = lambda c, name: F.when(F.col(c) > 0, F.lit(name))
    return s.withColumn("score", 2 * F.col("pending") + F.col("overdue") + 5 * F.col("gaps")).withColumn("actions", F.concat_ws("|", act("pending", "clear_queue"), act("overdue", "renew"), act("gaps", "repair_parser")))


@query("run_outcomes", """SELECT date_trunc('day', ts) AS day, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(*) FILTER (WHERE event_type = 'error') AS errors, round(avg(value), 4) AS mean_value FROM events GROUP BY 1""")
def run_outcomes(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.sum(k).alias("total"), F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.avg("value"), 4).alias("mean_value"))


@query("latency_percentiles", """SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS slowest FROM events GROUP BY event_type""")
def latency_percentiles(spark, sf_dir):
    """Nearest-rank percentiles."""
    at = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("value").alias("slowest"))


@query("demand_top", "SELECT user_id % 20 AS segment, count(*) AS searches FROM events WHERE event_type <> 'error' GROUP BY 1 ORDER BY searches DESC, segment LIMIT 5")
def demand_top(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("event_type <> 'error'").groupBy((F.col("user_id") % 20).alias("segment")).agg(F.count("*").alias("searches")).orderBy(F.desc("searches"), "segment").limit(5)


@query("watch_alert_stats", """SELECT c_custkey AS watch_id, count(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS sent, max(o_orderdate) FILTER (WHERE o_orderstatus = 'F') AS last_sent FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def watch_alert_stats(spark, sf_dir):
    sent = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("sent"), F.max("o_orderdate").alias("last_sent"))
    out = table(spark, sf_dir, "customer").join(sent, F.col("c_custkey") == F.col("o_custkey"), "left")
    return out.select(F.col("c_custkey").alias("watch_id"), F.coalesce("sent", F.lit(0)).alias("sent"), "last_sent")


@query("ttl_expiry", f"""WITH {LATEST} SELECT listing_id, CASE WHEN negative THEN 'removed' WHEN observed_at < (SELECT max(ts) FROM events) - INTERVAL 12 HOUR THEN 'stale' ELSE 'active' END AS status FROM latest""")
def ttl_expiry(spark, sf_dir):
    """Listings go stale by age; absence never removes them."""
    now = F.lit(table(spark, sf_dir, "events").agg(F.max("ts")).first()[0])
    last = latest(observations(spark, sf_dir), ["listing_id"], "observed_at", "observation_id")
    return last.select("listing_id", F.when(F.col("negative"), "removed").when(F.col("observed_at") < now - F.expr("INTERVAL 12 HOUR"), "stale").otherwise("active").alias("status"))


@query("due_times", """SELECT o_orderkey, o_orderdate + to_minutes(CAST(least(360, 5 * power(2, o_custkey % 6)) AS BIGINT)) AS due_at FROM orders""")
def due_times(spark, sf_dir):
    minutes = F.least(F.lit(360), 5 * F.pow(F.lit(2), F.col("o_custkey") % 6)).cast("int")
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderdate") + F.make_dt_interval(mins=minutes)).alias("due_at"))


@query("claim_order", """SELECT s_suppkey, CAST(rank AS INTEGER) AS rank FROM (SELECT s_suppkey, row_number() OVER (ORDER BY nullif(s_nationkey, 3) ASC NULLS FIRST, s_acctbal DESC, s_suppkey) AS rank FROM supplier) WHERE rank <= 25""")
def claim_order(spark, sf_dir):
    """The next jobs by fairness: never served first, then longest waiting."""
    order = [F.nullif("s_nationkey", F.lit(3)).asc_nulls_first(), F.desc("s_acctbal"), F.asc("s_suppkey")]
    top = table(spark, sf_dir, "supplier").orderBy(*order).limit(25)
    return top.select("s_suppkey", F.row_number().over(Window.orderBy(*order)).alias("rank"))


@query("work_class_turns", "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'demo' WHEN 3 THEN 'demo' WHEN 5 THEN 'probe' ELSE 'used' END AS class FROM orders")
def work_class_turns(spark, sf_dir):
    """A weighted round: three turns in six for used, two for demo, one for probes."""
    turns = F.array(*map(F.lit, ("demo", "used", "used", "demo", "used", "probe")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.get(turns, (F.col("o_orderkey") % 6).cast("int")).alias("class"))


# ------------------------------------------------------------------ market reports
@query("brand_coverage", f"""WITH {OFF}, taxonomy AS (SELECT 'Brand#' || CAST(k AS VARCHAR) AS brand FROM range(11, 60) t(k)) SELECT t.brand, count(o.listing_id) AS offers, count(DISTINCT o.vehicle_id) AS vehicles, count(DISTINCT o.source) AS sources FROM taxonomy t LEFT JOIN offers o ON o.brand = t.brand AND o.active GROUP BY 1""")
def brand_coverage(spark, sf_dir):
    taxonomy = spark.range(11, 60).select(F.concat(F.lit("Brand#"), F.col("id").cast("string")).alias("brand"))
    counted = offers(spark, sf_dir).filter("active").groupBy("brand").agg(F.count("*").alias("offers"), F.countDistinct("vehicle_id").alias("vehicles"), F.countDistinct("source").alias("sources"))
    return taxonomy.join(counted, "brand", "left").na.fill(0, ["offers", "vehicles", "sources"])


@query("reference_median", f"""WITH {OFF}, m AS (SELECT brand, model, condition, price_basis, count(*) AS n, quantile_cont(price_lakh, 0.5) AS med FROM offers WHERE active GROUP BY 1, 2, 3, 4)
  SELECT listing_id, CASE WHEN n >= 3 THEN round(med, 6) END AS reference, CASE WHEN n >= 3 THEN round((med - price_lakh) / med * 100, 4) END AS discount FROM offers JOIN m USING (brand, model, condition, price_basis) WHERE active""")
def reference_median(spark, sf_dir):
    keys = ["brand", "model", "condition", "price_basis"]
    live = offers(spark, sf_dir).filter("active").select("listing_id", "price_lakh", *keys)
    med = live.groupBy(*keys).agg(F.count("*").alias("n"), F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY price_lakh)").alias("med")).filter("n >= 3")
    gap = F.round((F.col("med") - F.col("price_lakh")) / F.col("med") * 100, 4)
    return live.join(med, keys, "left").select("listing_id", F.round("med", 6).alias("reference"), gap.alias("discount"))


@query("observed_models", f"""WITH {OFF} SELECT brand, model, min(listing_id) AS example, max(observed_at) AS verified, count(DISTINCT source) AS sources FROM offers WHERE active GROUP BY 1, 2""")
def observed_models(spark, sf_dir):
    return offers(spark, sf_dir).filter("active").groupBy("brand", "model").agg(F.min("listing_id").alias("example"), F.max("observed_at").alias("verified"), F.countDistinct("source").alias("sources"))


@query("identity_audit", f"""WITH {OFF}, k AS (SELECT brand, model, variant, mfg_year, count(DISTINCT vehicle_id) AS vehicles, count(DISTINCT source) AS sources FROM offers GROUP BY 1, 2, 3, 4)
  SELECT sha256(concat_ws('|', brand, model, coalesce(variant, ''), coalesce(CAST(mfg_year AS VARCHAR), ''))) AS key_hash, vehicles, concat_ws('|', CASE WHEN vehicles > 5 THEN 'many_vehicles' END, CASE WHEN mfg_year IS NULL THEN 'year_missing' END, CASE WHEN variant IS NULL THEN 'variant_missing' END) AS reasons FROM k WHERE vehicles > 5 OR mfg_year IS NULL""")
def identity_audit(spark, sf_dir):
    k = offers(spark, sf_dir).groupBy("brand", "model", "variant", "mfg_year").agg(F.countDistinct("vehicle_id").alias("vehicles")).filter("vehicles > 5 OR mfg_year IS NULL")
    key = F.sha2(F.concat_ws("|", "brand", "model", F.coalesce("variant", F.lit("")), F.coalesce(F.col("mfg_year").cast("string"), F.lit(""))), 256)
    why = F.concat_ws("|", F.when(F.col("vehicles") > 5, "many_vehicles"), F.when(F.col("mfg_year").isNull(), "year_missing"), F.when(F.col("variant").isNull(), "variant_missing"))
    return k.select(key.alias("key_hash"), "vehicles", why.alias("reasons"))


@query("price_evidence", f"""WITH {OFF}, f AS (SELECT vehicle_id, source, price_basis, min(price_lakh) AS price FROM offers WHERE active AND brand = 'Brand#11' GROUP BY 1, 2, 3)
  SELECT 'E' || CAST(vehicle_id AS VARCHAR) || '-' || CAST(row_number() OVER (PARTITION BY vehicle_id ORDER BY price, source, price_basis) AS VARCHAR) AS evidence_id, vehicle_id, source, price_basis, round(price, 6) AS price FROM f QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY price, source, price_basis) <= 6""")
def price_evidence(spark, sf_dir):
    """Bounded facts with ids that a summary may cite: six a vehicle."""
    facts = offers(spark, sf_dir).filter("active AND brand = 'Brand#11'").groupBy("vehicle_id", "source", "price_basis").agg(F.min("price_lakh").alias("price"))
    n = F.row_number().over(Window.partitionBy("vehicle_id").orderBy("price", "source", "price_basis"))
    ranked = facts.withColumn("n", n).filter("n <= 6")
    return ranked.select(F.concat(F.lit("E"), F.col("vehicle_id").cast("string"), F.lit("-"), F.col("n").cast("string")).alias("evidence_id"), "vehicle_id", "source", "price_basis", F.round("price", 6).alias("price"))


@query("shortlist", f"""WITH {OFF}, asked AS (SELECT p_partkey AS vehicle_id FROM part WHERE p_partkey % 97 = 3 UNION ALL SELECT -1), live AS (SELECT vehicle_id, min(price_lakh) AS price FROM offers WHERE active AND data_consistent GROUP BY 1)
  SELECT a.vehicle_id, round(l.price, 6) AS price, l.vehicle_id IS NULL AS unavailable FROM asked a LEFT JOIN live l USING (vehicle_id)""")
def shortlist(spark, sf_dir):
    asked = table(spark, sf_dir, "part").filter("p_partkey % 97 = 3").select(F.col("p_partkey").alias("vehicle_id")).union(spark.range(1).select(F.lit(-1).cast("long")))
    live = offers(spark, sf_dir).filter("active AND data_consistent").groupBy("vehicle_id").agg(F.min("price_lakh").alias("price"), F.lit(True).alias("found"))
    return asked.join(live, "vehicle_id", "left").select("vehicle_id", F.round("price", 6).alias("price"), F.col("found").isNull().alias("unavailable"))


@query("hydrated_page", f"""WITH {OFF}, hits AS (SELECT listing_id, CAST(row_number() OVER (ORDER BY price_lakh, listing_id) AS INTEGER) AS ordinal FROM offers WHERE active)
  SELECT h.ordinal, o.listing_id, o.vehicle_id, o.source FROM hits h JOIN offers o USING (listing_id) WHERE h.ordinal <= 40""")
def hydrated_page(spark, sf_dir):
    """A page of index hits, filled from the table by key, in the hits' order."""
    rows = offers(spark, sf_dir)
    top = rows.filter("active").select("listing_id", "price_lakh").orderBy("price_lakh", "listing_id").limit(40)
    hits = top.select("listing_id", F.row_number().over(Window.orderBy("price_lakh", "listing_id")).alias("ordinal"))
    return rows.join(hits, "listing_id").select("ordinal", "listing_id", "vehicle_id", "source")


@query("negative_evidence", f"""WITH {OBS}, claims AS (SELECT listing_id, date_trunc('day', observed_at) AS day, count(DISTINCT event_type) AS claims, min(event_type) AS claim FROM obs GROUP BY 1, 2)
  SELECT listing_id, day, CASE WHEN claims = 1 THEN claim ELSE 'inconclusive' END AS outcome FROM claims""")
def negative_evidence(spark, sf_dir):
    """Exactly one distinct claim decides; conflicting ones are inconclusive."""
    day = F.date_trunc("day", "observed_at").alias("day")
    claims = observations(spark, sf_dir).groupBy("listing_id", day).agg(F.countDistinct("event_type").alias("n"), F.min("event_type").alias("claim"))
    return claims.select("listing_id", "day", F.when(F.col("n") == 1, F.col("claim")).otherwise("inconclusive").alias("outcome"))


@query("nested_offers", f"""WITH {OFF}, g AS (SELECT vehicle_id, list(price_lakh) AS prices, list(source) AS sources FROM offers WHERE active GROUP BY 1)
  SELECT vehicle_id, len(prices) AS offers, len(list_filter(prices, lambda p: p BETWEEN 1000 AND 1500)) > 0 AS one_in_budget FROM g""")
def nested_offers(spark, sf_dir):
    """A nested predicate keeps the budget on one offer, not on the least and the greatest apart."""
    g = offers(spark, sf_dir).filter("active").groupBy("vehicle_id").agg(F.collect_list(F.struct("price_lakh", "source")).alias("offers"))
    return g.select("vehicle_id", F.size("offers").cast("long").alias("offers"), F.exists("offers", lambda o: o["price_lakh"].between(1000, 1500)).alias("one_in_budget"))


# ------------------------------------------------------------------ capabilities, registries, discovery
@query("wildcard_capability", """WITH caps AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '*' ELSE 'Brand#' || CAST(11 + s_suppkey % 25 AS VARCHAR) END AS brand FROM supplier), wanted AS (SELECT DISTINCT p_brand AS brand FROM part)
  SELECT w.brand, count(*) AS sources FROM wanted w JOIN caps c ON c.brand = '*' OR c.brand = w.brand GROUP BY 1""")
def wildcard_capability(spark, sf_dir):
    """Equal or wildcard: the equal part is a join on the key, the wildcard part one number."""
    caps = table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 3 == 0, "*").otherwise(F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 25 + 11).cast("string"))).alias("brand"))
    counts = caps.groupBy("brand").agg(F.count("*").alias("n"))
    any_ = counts.filter("brand = '*'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("any"))
    wanted = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand")).distinct()
    return wanted.join(counts, "brand", "left").crossJoin(any_).select("brand", (F.coalesce("n", F.lit(0)) + F.col("any")).alias("sources")).filter("sources > 0")


@query("taxonomy_union", """WITH u AS (SELECT lower(p_brand) AS brand, 0 AS rank, p_partkey AS id FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT lower(p_brand), 1, p_partkey FROM part)
  SELECT brand, rank, id FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY rank, id) AS rn FROM u) WHERE rn = 1""")
def taxonomy_union(spark, sf_dir):
    """Lists merged in order of trust, the first of each name winning."""
    part = table(spark, sf_dir, "part")
    one = lambda df, rank: df.select(F.lower("p_brand").alias("brand"), F.lit(rank).alias("rank"), F.col("p_partkey").alias("id"))
    both = one(part.filter("p_partkey % 2 = 0"), 0).union(one(part, 1))
    return both.groupBy("brand").agg(F.min(F.struct("rank", "id")).alias("w")).select("brand", "w.rank", "w.id")


@query("plan_order", """SELECT s_suppkey, score, CAST(row_number() OVER (ORDER BY score DESC, s_name) AS INTEGER) AS place FROM (SELECT s_suppkey, s_name, s_nationkey % 4 * 10 + CASE WHEN s_acctbal > 5000 THEN 5 ELSE 0 END AS score FROM supplier) ORDER BY place LIMIT 30""")
def plan_order(spark, sf_dir):
    scored = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", (F.col("s_nationkey") % 4 * 10 + F.when(F.col("s_acctbal") > 5000, 5).otherwise(0)).alias("score"))
    top = scored.orderBy(F.desc("score"), "s_name").limit(30)
    return top.select("s_suppkey", "score", F.row_number().over(Window.orderBy(F.desc("score"), "s_name")).alias("place"))


@query("query_bank", """WITH t(i, template) AS (VALUES (0, 'used % for sale'), (1, 'demo % dealer'), (2, '% certified'))
  SELECT DISTINCT replace(template, '%', lower(p_brand) || ' ' || lower(p_type)) AS q, i FROM part, t WHERE p_size % 3 = i""")
def query_bank(spark, sf_dir):
    templates = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(t).alias("template")) for i, t in enumerate(("used % for sale", "demo % dealer", "% certified"))))
    names = table(spark, sf_dir, "part").select(F.concat_ws(" ", F.lower("p_brand"), F.lower("p_type")).alias("name"), F.get(templates, (F.col("p_size") % 3).cast("int")).alias("t"))
    return names.select(F.replace("t.template", F.lit("%"), F.col("name")).alias("q"), "t.i").distinct()


@query("staged_candidates", """WITH h AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, count(*) AS pages, count(DISTINCT regexp_extract(url, '://[^/?#]*(/[a-z]+)', 1)) AS sections FROM pages GROUP BY 1)
  SELECT host, pages, least(1.0, 0.45 + 0.05 * pages) AS confidence, pages >= 2 AND sections >= 2 AS staged FROM h""")
def staged_candidates(spark, sf_dir):
    """Hosts with two matching pages or more are staged for review."""
    pages = table(spark, sf_dir, "pages")
    section = F.regexp_extract(F.col("url"), "://[^/?#]*(/[a-z]+)", 1)
    h = pages.groupBy(url.host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"), F.countDistinct(section).alias("sections"))
    return h.select("host", "pages", F.least(F.lit(1.0), F.lit(0.45) + 0.05 * F.col("pages")).alias("confidence"), ((F.col("pages") >= 2) & (F.col("sections") >= 2)).alias("staged"))


@query("known_domains_anti", """WITH known AS (SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages WHERE page_id % 5 = 0)
  SELECT page_id FROM pages WHERE NOT EXISTS (SELECT 1 FROM known WHERE host = regexp_extract(url, '://([^/?#]*)', 1))""")
def known_domains_anti(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", url.host(F.col("url")).alias("host"))
    return pages.join(pages.filter("page_id % 5 = 0").select("host").distinct(), "host", "left_anti").select("page_id")


@query("merge_universes", """WITH u AS (SELECT url, 0 AS rank, page_id FROM pages WHERE page_id % 2 = 1 UNION ALL SELECT url, 1, page_id FROM pages)
  SELECT url, rank, page_id FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY rank, page_id) AS rn FROM u) WHERE rn = 1""")
def merge_universes(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("url", "page_id")
    both = pages.filter("page_id % 2 = 1").withColumn("rank", F.lit(0)).unionByName(pages.withColumn("rank", F.lit(1)))
    return both.groupBy("url").agg(F.min(F.struct("rank", "page_id")).alias("w")).select("url", "w.rank", "w.page_id")


@query("set_difference", """SELECT conv_id, string_agg(DISTINCT role, '|' ORDER BY role) AS roles, bool_or(role = 'system') IS NOT TRUE AS no_system FROM conversations GROUP BY conv_id""")
def set_difference(spark, sf_dir):
    roles = F.sort_array(F.collect_set("role"))
    out = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(roles.alias("r"))
    missing = F.array_except(F.array(F.lit("system")), F.col("r"))
    return out.select("conv_id", F.array_join("r", "|").alias("roles"), (F.size(missing) > 0).alias("no_system"))


@query("seed_sync", """SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'kept' ELSE 'seeded' END AS origin FROM supplier""")
def seed_sync(spark, sf_dir):
    """A bootstrap seed adds what is absent and never overwrites what was reviewed."""
    ids = table(spark, sf_dir, "supplier").select("s_suppkey")
    reviewed = ids.filter("s_suppkey % 2 = 0").withColumn("origin", F.lit("kept"))
    return folding.insert_absent(reviewed, ids.withColumn("origin", F.lit("seeded")), ["s_suppkey"])


# ------------------------------------------------------------------ text
@query("title_model", """SELECT p_partkey, nullif(concat_ws(' ', split_part(p_name, ' ', 1), nullif(split_part(p_name, ' ', 2), ''), nullif(split_part(p_name, ' ', 3), '')), '') AS model FROM part""")
def title_model(spark, sf_dir):
    made = F.concat_ws(" ", "p_brand", F.lit("2021"), "p_name", F.lit("diesel automatic"))
    return table(spark, sf_dir, "part").select("p_partkey", text.model_from_title(made, F.col("p_brand")).alias("model"))


@query("condition_of", """SELECT doc_id, CASE WHEN regexp_matches(lower(text), '\\b(demo|demonstrator|test drive car)\\b') THEN 'demo' WHEN regexp_matches(lower(text), '\\b(used|pre-owned|preowned|certified)\\b') THEN 'used' ELSE 'unknown' END AS condition FROM documents""")
def condition_of(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.condition_of(F.col("text")).alias("condition"))


@query("personal_data_guard", """SELECT doc_id, regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}|\\+?[0-9][0-9 -]{8,}[0-9]') AS flagged FROM documents""")
def personal_data_guard(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.has_personal_data(F.col("text")).alias("flagged"))


@query("money_text", """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderkey AS DOUBLE) * 100 WHEN 1 THEN CAST(o_orderkey AS DOUBLE) ELSE CAST(o_orderkey AS DOUBLE) / 100000 END AS lakh FROM orders""")
def money_text(spark, sf_dir):
    unit = F.get(F.array(F.lit(" crore"), F.lit(" lakh"), F.lit("")), (F.col("o_orderkey") % 3).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.money_lakh(F.concat(F.lit("₹"), F.col("o_orderkey").cast("string"), unit)).alias("lakh"))


@query("freshness_function", f"""WITH {LATEST} SELECT freshness, count(*) AS n FROM (SELECT CASE WHEN observed_at >= (SELECT max(ts) FROM events) - INTERVAL 6 HOUR THEN 'fresh' WHEN observed_at >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR THEN 'aging' WHEN observed_at >= (SELECT max(ts) FROM events) - INTERVAL 168 HOUR THEN 'stale' ELSE 'expired' END AS freshness FROM latest) GROUP BY 1""")
def freshness_function(spark, sf_dir) -> DataFrame:
    """The freshness rule as a function of the session, used from SQL."""
    timing.register(spark)
    last = latest(observations(spark, sf_dir), ["listing_id"], "observed_at", "observation_id")
    now = table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
    state = F.call_function("freshness_state", F.col("observed_at").cast("timestamp"), F.lit(now).cast("timestamp"))
    return last.groupBy(state.alias("freshness")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ evidence
@query("route_resolution", """SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'https://s.example/special/' || CAST(s_nationkey AS VARCHAR)
    WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'https://s.example/' || lower(n_name) || '?c=' || CAST(s_nationkey AS VARCHAR) END AS route FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def route_resolution(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    override = F.when(F.col("s_suppkey") % 4 == 0, F.lit("https://s.example/special/{id}"))
    values = {"city": F.when(F.col("s_suppkey") % 5 != 0, F.lower("n_name")), "id": F.col("s_nationkey").cast("string")}
    return rows.select("s_suppkey", evidence.route(F.lit("https://s.example/{city}?c={id}"), override, values).alias("route"))


@query("ledger_evidence", """SELECT event_id, event_id % 3 <> 0 AND event_type <> 'error' AND event_id % 7 <> 0 AS valid FROM events""")
def ledger_evidence(spark, sf_dir):
    seal = F.when(F.col("event_id") % 7 == 0, F.lit("other")).otherwise(F.sha2("props", 256))
    rows = table(spark, sf_dir, "events").select("event_id", "props", F.when(F.col("event_id") % 3 == 0, 1).otherwise(2).alias("version"), (F.col("event_type") == "error").alias("grants"), seal.alias("fingerprint"))
    return evidence.ledger_evidence(rows, 2, ("grants",), "props", "fingerprint").select("event_id", "valid")


@query("replay_status", """SELECT conv_id, CASE WHEN conv_id % 5 = 0 THEN 'unavailable' WHEN conv_id % 5 = 1 THEN 'drift' ELSE 'matched' END AS status FROM (SELECT DISTINCT conv_id FROM conversations)""")
def replay_status(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    now = rows.filter("conv_id % 5 <> 0").withColumn("text", F.when(F.col("conv_id") % 5 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return evidence.replay(rows, now, "conv_id", ["turn", "role", "text"])


@query("sample_problems", """WITH s AS (SELECT page_id, url, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS h, regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '') AS p, regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) AS q, lower(split_part(url, '://', 1)) AS sc FROM pages),
  k AS (SELECT page_id, h, sc || h || CASE WHEN p = '' THEN '/' ELSE p END || '?' || array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT starts_with(lower(split_part(x, '=', 1)), 'utm_') AND NOT lower(split_part(x, '=', 1)) IN ('gclid', 'fbclid'))), '&') AS key FROM s)
  SELECT page_id AS id, concat_ws('|', CASE WHEN page_id % 9 = 0 THEN 'labels' END, CASE WHEN page_id % 4 = 3 THEN 'condition' END, CASE WHEN page_id % 6 = 0 THEN 'collected' END, CASE WHEN row_number() OVER (PARTITION BY h, key ORDER BY page_id) > 1 THEN 'duplicate' END) AS problems FROM k""")
def sample_problems(spark, sf_dir):
    now = F.lit("2026-01-02 00:00:00").cast("timestamp_ntz")
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"), "url", url.host(F.col("url")).alias("source"), F.when(F.col("page_id") % 9 != 0, "b").alias("brand"), F.lit("m").alias("model"),
        F.get(F.array(F.lit("used"), F.lit("demo"), F.lit("used"), F.lit("new")), (F.col("page_id") % 4).cast("int")).alias("condition"), F.lit(True).alias("eligible"),
    )
    collected = now - F.make_dt_interval(hours=F.when(F.col("id") % 6 == 0, 30).otherwise(3))
    return evidence.sample_problems(pages, collected, now).select("id", F.array_join("problems", "|").alias("problems"))


@query("group_survivors", """SELECT p_partkey AS id, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size, p_partkey) = 1 AS kept FROM part""")
def group_survivors(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_type", "p_size")
    first = rows.groupBy("p_brand", "p_type").agg(F.min("id").alias("group_id"))
    pairs = rows.join(first, ["p_brand", "p_type"]).select("id", "group_id")
    return evidence.survivors(rows, pairs, [F.col("p_size"), F.col("id")]).select("id", "kept")
