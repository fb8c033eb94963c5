"""Further queries: discovery and catalogue functions, evidence, ordering of results, joins of operations reports, text functions on made titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloft.functions import discovery, scores, text
from tallyloft.operators import cards, extract, planning
from tallyloft.operators.latest import latest
from tallyloft.plans.queries import LATEST, MARKET, OFF, SCORED, _scored, query
from tallyloft.plans.search import Intent, grouped
from tallyloft.sources.scan import Page, Policy, scan
from tallyloft.sources.tables import observations, offers, table


def _any(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _first(column: str, classes: dict[str, tuple[str, ...]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {_any(column, words)} THEN '{name}'" for name, words in classes.items()) + f" ELSE '{other}' END"


def _one_of(words: tuple[str, ...], key: str):
    """The word that a key picks, as a function that makes its column (which needs a session) and as SQL."""
    listed = ", ".join(f"'{w}'" for w in words)
    return lambda: F.element_at(F.array(*map(F.lit, words)), (F.col(key) % len(words) + 1).cast("int")), f"list_extract([{listed}], CAST({key} % {len(words)} + 1 AS INTEGER))"


# ------------------------------------------------------------------ discovery
TITLES = ("Demo cars of the month", "Certified used cars", "Owner direct", "Luxury showroom", "Cars for sale", "About us", "Pre-owned inventory", "Dealer network")
PATHS = ("/used-cars/list", "/contact", "/cars/42", "/listing/7", "/demonstrator", "")
TITLE, TITLE_SQL = _one_of(TITLES, "s_suppkey")
PATH, PATH_SQL = _one_of(PATHS, "s_suppkey")
MAKER, MAKER_SQL = _one_of(("BMW", "Skoda", "Tata", "MG", "Audi"), "s_suppkey")
FOUND_SQL = f"""found AS (SELECT s_suppkey, {TITLE_SQL} AS title, {MAKER_SQL} AS maker, {PATH_SQL} AS path, CASE WHEN s_suppkey % 11 = 0 THEN 'ftp' ELSE 'https' END AS scheme FROM supplier),
  said AS (SELECT *, lower(title || ' ' || maker || ' ' || regexp_replace(path, '[^a-z0-9]+', ' ', 'g')) AS words, lower(title || ' ' || maker || ' ' || path) AS raw FROM found)"""


def _found(spark, sf_dir) -> DataFrame:
    scheme = F.when(F.col("s_suppkey") % 11 == 0, "ftp").otherwise("https")
    return table(spark, sf_dir, "supplier").select("s_suppkey", TITLE().alias("title"), MAKER().alias("maker"), F.concat(scheme, F.lit("://site.example"), PATH()).alias("url"))


@query("source_class", f"""WITH {FOUND_SQL}, judged AS (SELECT *, {_first('words', discovery.TYPE_WORDS, 'unknown')} AS source_type, {_first('words', discovery.CONDITION_WORDS, 'both')} AS condition FROM said)
  SELECT s_suppkey, source_type, condition, least(100, 60 + CASE WHEN condition <> 'both' THEN 10 ELSE 0 END + CASE WHEN source_type <> 'unknown' THEN 20 ELSE 0 END + CASE WHEN {_any('words', discovery.STOCK_WORDS)} THEN 10 ELSE 0 END) / 100 AS confidence FROM judged""")
def source_class(spark, sf_dir):
    kind = discovery.source_class(F.col("title"), F.col("maker"), F.col("url"), F.col("maker"))
    return _found(spark, sf_dir).select("s_suppkey", kind.alias("c")).select("s_suppkey", "c.source_type", "c.condition", "c.confidence")


@query("landing_pages", f"""WITH {FOUND_SQL} SELECT s_suppkey, scheme = 'https' AND {_any('raw', discovery.LANDING_WORDS)} AND (NOT {_any('path', discovery.DETAIL_PATHS)} OR {_any('raw', discovery.CATALOGUE_WORDS)}) AS landing FROM said""")
def landing_pages(spark, sf_dir):
    return _found(spark, sf_dir).select("s_suppkey", discovery.is_landing_page(F.col("title"), F.col("maker"), F.col("url")).alias("landing"))


@query("discovery_order", f"""WITH {FOUND_SQL}, judged AS (SELECT s_suppkey, title, {_first('words', discovery.TYPE_WORDS, 'unknown')} AS source_type, {_first('words', discovery.CONDITION_WORDS, 'both')} AS condition, words FROM said),
  sure AS (SELECT *, least(100, 60 + CASE WHEN condition <> 'both' THEN 10 ELSE 0 END + CASE WHEN source_type <> 'unknown' THEN 20 ELSE 0 END + CASE WHEN {_any('words', discovery.STOCK_WORDS)} THEN 10 ELSE 0 END) AS c FROM judged)
  SELECT s_suppkey, source_type, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (ORDER BY c DESC, source_type, s_suppkey) AS place FROM sure) WHERE place <= 50""")
def discovery_order(spark, sf_dir):
    """The surest candidates first; a report of fifty."""
    kind = discovery.source_class(F.col("title"), F.col("maker"), F.col("url"), F.col("maker"))
    top = _found(spark, sf_dir).select("s_suppkey", kind.alias("c")).orderBy(F.desc("c.confidence"), "c.source_type", "s_suppkey").limit(50)
    return top.select("s_suppkey", "c.source_type", F.row_number().over(Window.orderBy(F.desc("c.confidence"), "c.source_type", "s_suppkey")).alias("place"))


BRAND_NAME, BRAND_NAME_SQL = _one_of(("BMW", "Mercedes-Benz", "Skoda", "Tata", "MG", "Rolls-Royce", "Kia"), "p_partkey")


@query("brand_segments", f"""SELECT brand, segment, count(*) AS n FROM (SELECT {BRAND_NAME_SQL} AS brand, CASE WHEN p_partkey % 7 IN (0, 1, 5) THEN 'luxury' WHEN p_partkey % 7 IN (2, 4) THEN 'premium' ELSE 'mass_market' END AS segment FROM part) GROUP BY brand, segment""")
def brand_segments(spark, sf_dir):
    return table(spark, sf_dir, "part").select(BRAND_NAME().alias("brand")).groupBy("brand", discovery.segment(F.col("brand")).alias("segment")).agg(F.count("*").alias("n"))


@query("catalogue_names", f"""SELECT p_partkey, CASE p_partkey % 5 WHEN 3 THEN NULL ELSE p_name END AS model FROM part""")
def catalogue_names(spark, sf_dir):
    """Labels as catalogues write them: with the brand before, a price or stars behind, or a word that the model is gone."""
    spelt = F.when(F.col("p_partkey") % 2 == 0, F.upper(BRAND_NAME())).otherwise(F.replace(BRAND_NAME(), F.lit("-"), F.lit(" ")))
    tail = F.element_at(F.array(F.lit(""), F.lit(" ₹ 12.5 - 18 Lakh*"), F.lit(" *"), F.lit(" (Discontinued)"), F.lit(" Rs. 1,20,000 ")), (F.col("p_partkey") % 5 + 1).cast("int"))
    label = F.concat(spelt, F.lit("  "), F.col("p_name"), tail)
    return table(spark, sf_dir, "part").select("p_partkey", discovery.catalogue_name(label, BRAND_NAME()).alias("model"))


@query("query_parts", f"""SELECT p_partkey, CASE WHEN p_partkey % 7 < 6 THEN {BRAND_NAME_SQL} END AS brand, CASE WHEN p_partkey % 7 < 6 THEN lower(p_type) ELSE 'kia ' || lower(p_type) END AS model FROM part""")
def query_parts(spark, sf_dir):
    asked = F.concat(F.lower(BRAND_NAME()), F.lit("  "), F.col("p_type"))
    parts = discovery.split_query(asked, ("BMW", "Mercedes-Benz", "Skoda", "Tata", "MG", "Rolls-Royce"))
    return table(spark, sf_dir, "part").select("p_partkey", parts.alias("q")).select("p_partkey", "q.brand", "q.model")


@query("safe_tokens", """SELECT page_id, substr(regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g'), 1, 80) AS token,
    substr(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '[^A-Za-z0-9/_-]', '_', 'g'), 1, 120) AS path FROM pages WHERE url IS NOT NULL AND url <> ''""")
def safe_tokens(spark, sf_dir):
    return table(spark, sf_dir, "pages").filter("url IS NOT NULL AND url <> ''").select("page_id", discovery.safe_token(F.col("url")).alias("token"), discovery.safe_path(F.col("url")).alias("path"))


@query("contact_kinds", """SELECT kind, count(*) AS n, count(DISTINCT token) AS tokens FROM (SELECT CASE c_custkey % 4 WHEN 0 THEN 'email' WHEN 1 THEN 'phone' END AS kind, sha256('watch-' || CAST(c_custkey AS VARCHAR)) AS token FROM customer) GROUP BY kind""")
def contact_kinds(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    made = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("a"), key, F.lit("@x.org"))).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("+91"), F.lpad(key, 10, "9"))).when(F.col("c_custkey") % 4 == 2, F.concat(key, F.lit("@x"))).otherwise(key)
    rows = table(spark, sf_dir, "customer").select(discovery.contact_kind(made).alias("kind"), F.sha2(F.concat(F.lit("watch-"), key), 256).alias("token"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("token").alias("tokens"))


# ------------------------------------------------------------------ evidence
@query("evidence_sentences", f"""WITH {OFF}, o AS (SELECT vehicle_id, source, price_basis, CAST(round(min(price_lakh) * 100) AS BIGINT) AS cents FROM offers WHERE active GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY cents, source, price_basis) AS n FROM o)
  SELECT vehicle_id, 's' || CAST(n AS VARCHAR) || '.price' AS fact, 'Recorded asking price: INR ' || CAST(cents // 100 AS VARCHAR) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') || ' lakh; price basis: ' || price_basis || '.' AS sentence FROM r WHERE n <= 12""")
def evidence_sentences(spark, sf_dir):
    """At most twelve facts a vehicle, each with the id of the source it is drawn from."""
    low = offers(spark, sf_dir).filter("active").groupBy("vehicle_id", "source", "price_basis").agg(F.round(F.min("price_lakh") * 100).cast("long").alias("cents"))
    ranked = low.withColumn("n", F.row_number().over(Window.partitionBy("vehicle_id").orderBy("cents", "source", "price_basis"))).filter("n <= 12")
    return ranked.select("vehicle_id", F.concat(F.lit("s"), F.col("n").cast("string"), F.lit(".price")).alias("fact"), discovery.money_sentence(F.col("cents"), F.col("price_basis")).alias("sentence"))


@query("record_sentences", """SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN 'Canonical inventory record — Mileage (km): ' || CAST(p_size * 100 AS VARCHAR) || '. Attribute provenance is not independently verified by this guide.' END AS sentence FROM part""")
def record_sentences(spark, sf_dir):
    value = F.when(F.col("p_size") % 3 > 0, (F.col("p_size") * 100).cast("string")).otherwise("Unknown")
    return table(spark, sf_dir, "part").select("p_partkey", discovery.field_sentence("Mileage (km)", value).alias("sentence"))


# ------------------------------------------------------------------ orders of results
@query("relevance_order", f"""WITH {OFF}, live AS (SELECT listing_id, 4 * greatest(-10.0, least(20.0, coalesce(identity_confidence * 40 - 10, 0))) + 5 * least(owners, 4) + 10 * coalesce(identity_confidence, 0) + CASE WHEN data_consistent THEN 8 ELSE 0 END
      + CASE WHEN km <= 30000 THEN 5 ELSE 0 END + CASE WHEN owners = 1 THEN 4 ELSE 0 END + CASE WHEN vehicle_id % 2 = 0 THEN 3 ELSE 0 END + CASE WHEN source_tier = 1 THEN 3 ELSE 0 END + 4 AS relevance, price_lakh FROM offers WHERE active)
  SELECT listing_id, relevance, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (ORDER BY relevance DESC, price_lakh, listing_id) AS place FROM live) WHERE place <= 100""")
def relevance_order(spark, sf_dir):
    score = scores.relevance(F.col("identity_confidence") * 40 - 10, F.col("owners"), F.col("identity_confidence"), F.col("data_consistent"), F.col("km"), F.col("owners"), F.col("vehicle_id") % 2 == 0, F.col("source_tier") == 1, F.col("observed_at"))
    top = offers(spark, sf_dir).filter("active").select("listing_id", score.alias("relevance"), "price_lakh").orderBy(F.desc("relevance"), "price_lakh", "listing_id").limit(100)
    return top.select("listing_id", "relevance", F.row_number().over(Window.orderBy(F.desc("relevance"), "price_lakh", "listing_id")).alias("place"))


@query("report_order", f"""WITH {SCORED}, c AS (SELECT listing_id, price_lakh, discount, CASE WHEN data_consistent AND n >= 4 AND discount >= 15 THEN 'exceptional' WHEN data_consistent AND n >= 4 AND discount >= 10 THEN 'bargain' WHEN data_consistent AND km <= 20000 THEN 'low-mileage-watch' ELSE 'watch' END AS class FROM scored)
  SELECT listing_id, class, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (ORDER BY class <> 'exceptional', round(discount, 6) DESC, price_lakh, listing_id) AS place FROM c WHERE class <> 'watch') WHERE place <= 20""")
def report_order(spark, sf_dir):
    """The twenty opportunities of a report: the exceptional ones first, then by what they save."""
    kind = scores.opportunity_class(F.col("discount"), F.col("n"), F.col("km"), F.col("data_consistent"))
    order = [F.col("class") != "exceptional", F.round("discount", 6).desc(), F.col("price_lakh"), F.col("listing_id")]
    top = _scored(spark, sf_dir).withColumn("class", kind).filter("class <> 'watch'").orderBy(*order).limit(20)
    return top.select("listing_id", "class", F.row_number().over(Window.orderBy(*order)).alias("place"))


@query("image_ranking", """SELECT p_partkey, 'https://a.example/og.jpg|https://a.example/car/' || CAST(p_partkey AS VARCHAR) || '.jpg|https://a.example/plain' AS images FROM part""")
def image_ranking(spark, sf_dir):
    """The best images of a page: the one it names itself, then those whose tags speak of a car; logos and small ones go."""
    key = F.col("p_partkey").cast("string")
    html = F.concat(F.lit('<meta property="og:image" content="/og.jpg"><img src="/logo.png" alt="logo"><img src="/plain" alt="x"><img alt="car photo" src="/car/'), key, F.lit('.jpg#a"><img src="data:abc"><img width="20" class="avatar" src="/tiny"><img alt="car" data-src="/car/'), key, F.lit('.jpg">'))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(extract.images(html, F.lit("https://a.example/cars/1")), "|").alias("images"))


@query("alternating_slots", f"""WITH {OFF}, q AS (SELECT listing_id, condition, row_number() OVER (PARTITION BY condition ORDER BY observed_at, listing_id) AS r, count(*) OVER (PARTITION BY condition) AS n FROM offers WHERE condition IN ('used', 'demo')),
  f AS (SELECT *, (SELECT min(n) FROM (SELECT condition, max(n) AS n FROM q GROUP BY condition)) AS fewer FROM q)
  SELECT listing_id, condition, CAST(slot AS BIGINT) AS slot FROM (SELECT *, CASE WHEN r <= fewer THEN 2 * r - CASE WHEN condition = 'demo' THEN 1 ELSE 0 END ELSE fewer + r END AS slot FROM f) WHERE slot <= 100""")
def alternating_slots(spark, sf_dir):
    """Demonstrators and used cars take turns, oldest first; when one kind runs out, the other has all turns."""
    return planning.alternate(offers(spark, sf_dir).filter("condition IN ('used', 'demo')").select("listing_id", "condition", "observed_at"), "condition", ("demo", "used"), ["observed_at", "listing_id"], 100).select("listing_id", "condition", "slot")


# ------------------------------------------------------------------ joins of reports
@query("consistent_offers", f"""WITH {LATEST}, o AS (SELECT *, observation_id % 25 AS vehicle FROM latest)
  SELECT c_custkey, n_name, o.observation_id, coalesce(o.vehicle = n_nationkey, false) AS consistent FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN o ON o.listing_id = c_custkey""")
def consistent_offers(spark, sf_dir):
    """Whether a listing's latest observation is of the vehicle that the listing names; unknown is not consistent."""
    last = latest(observations(spark, sf_dir), ["listing_id"], "observed_at", "observation_id").select("listing_id", "observation_id", (F.col("observation_id") % 25).alias("vehicle"))
    listings = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return listings.join(last, F.col("c_custkey") == F.col("listing_id"), "left").select("c_custkey", "n_name", "observation_id", F.coalesce(F.col("vehicle") == F.col("n_nationkey"), F.lit(False)).alias("consistent"))


@query("fallback_source", f"""WITH {LATEST} SELECT n_name, count(*) AS listings, count(observation_id) AS observed FROM customer LEFT JOIN latest ON listing_id = c_custkey
  JOIN nation ON n_nationkey = coalesce(CASE WHEN observation_id % 3 > 0 THEN observation_id % 25 END, c_nationkey) GROUP BY n_name""")
def fallback_source(spark, sf_dir):
    """A fact's source is its observation's, or failing that its listing's."""
    last = latest(observations(spark, sf_dir), ["listing_id"], "observed_at", "observation_id").select("listing_id", "observation_id", F.when(F.col("observation_id") % 3 > 0, F.col("observation_id") % 25).alias("own"))
    facts = table(spark, sf_dir, "customer").join(last, F.col("c_custkey") == F.col("listing_id"), "left").withColumn("source", F.coalesce("own", "c_nationkey"))
    return facts.join(table(spark, sf_dir, "nation"), F.col("source") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("listings"), F.count("observation_id").alias("observed"))


@query("renewal_facts", """WITH q AS (SELECT o_custkey, max_by(o_orderstatus, o_orderkey) AS status, max(o_orderkey) AS job FROM orders GROUP BY 1)
  SELECT c_mktsegment, coalesce(status, 'not_enrolled') AS renewal, count(*) AS n FROM customer LEFT JOIN q ON o_custkey = c_custkey GROUP BY ALL""")
def renewal_facts(spark, sf_dir):
    """Facts beside the latest renewal job of each, those without one kept."""
    jobs = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderstatus", "o_orderkey").alias("status"))
    return table(spark, sf_dir, "customer").join(jobs, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_mktsegment", F.coalesce("status", F.lit("not_enrolled")).alias("renewal")).agg(F.count("*").alias("n"))


@query("watch_board", """WITH e AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders)
  SELECT c_custkey, count(o_orderkey) AS shown, coalesce(string_agg(CAST(o_orderkey AS VARCHAR) || ':' || o_orderstatus, '|' ORDER BY r), '') AS events FROM customer LEFT JOIN e ON o_custkey = c_custkey AND r <= 5 GROUP BY c_custkey""")
def watch_board(spark, sf_dir):
    """Each watch with its five newest events; watches without events stay."""
    newest = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    events = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.row_number().over(newest).alias("r")).filter("r <= 5")
    listed = events.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("r", "o_orderkey", "o_orderstatus"))).alias("e"))
    shown = F.array_join(F.transform("e", lambda x: F.concat(x["o_orderkey"].cast("string"), F.lit(":"), x["o_orderstatus"])), "|")
    return table(spark, sf_dir, "customer").join(listed, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce(F.size("e"), F.lit(0)).cast("long").alias("shown"), F.coalesce(shown, F.lit("")).alias("events"))


@query("readiness", "SELECT 'customer' AS name, true AS ready UNION ALL SELECT 'events', true UNION ALL SELECT 'lineitem', true UNION ALL SELECT 'part', true UNION ALL SELECT 'no_such_table', false")
def readiness(spark, sf_dir):
    """Whether each table of the read path can be planned, by its schema alone: no row is read."""
    from pyspark.errors import AnalysisException

    def ready(name: str) -> bool:
        try:
            return bool(table(spark, sf_dir, name).columns)
        except AnalysisException:
            return False

    return spark.createDataFrame([(n, ready(n)) for n in ("customer", "events", "lineitem", "part", "no_such_table")], "name string, ready boolean")


@query("prefix_match", "SELECT p_type, count(*) AS n FROM part WHERE p_type LIKE 'ECONOMY%' GROUP BY p_type")
def prefix_match(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(F.col("p_type").startswith("ECONOMY")).groupBy("p_type").agg(F.count("*").alias("n"))


@query("planned_observed", f"""WITH {OFF}, s AS (SELECT brand, list(DISTINCT condition) AS planned, list(DISTINCT CASE WHEN active THEN condition END) AS observed FROM offers GROUP BY brand)
  SELECT brand, array_to_string(list_sort(list_intersect(planned, list_filter(observed, lambda x: x IS NOT NULL))), '|') AS served FROM s""")
def planned_observed(spark, sf_dir):
    """Conditions that were both planned for and observed, of each brand."""
    s = offers(spark, sf_dir).groupBy("brand").agg(F.collect_set("condition").alias("planned"), F.collect_set(F.when(F.col("active"), F.col("condition"))).alias("observed"))
    return s.select("brand", F.array_join(F.array_sort(F.array_intersect("planned", "observed")), "|").alias("served"))


@query("plan_summary", """SELECT count(*) FILTER (WHERE s_suppkey % 3 = 0) AS live, count(*) FILTER (WHERE s_suppkey % 3 = 1) AS candidates, count(*) FILTER (WHERE s_suppkey % 3 = 2) AS others, count(*) AS sources FROM supplier""")
def plan_summary(spark, sf_dir):
    status = F.element_at(F.array(F.lit("live"), F.lit("candidate"), F.lit("discovery_only")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "supplier").withColumn("status", status)
    return rows.agg(F.count_if(F.col("status") == "live").alias("live"), F.count_if(F.col("status") == "candidate").alias("candidates"), F.count_if(~F.col("status").isin("live", "candidate")).alias("others"), F.count("*").alias("sources"))


@query("health_latest", """WITH h AS (SELECT user_id % 100 AS source, ts AS checked_at, event_id, event_type <> 'error' AS ok FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY checked_at DESC, event_id DESC) AS n, max(CASE WHEN ok THEN checked_at END) OVER (PARTITION BY source) AS last_validated FROM h)
  SELECT source, checked_at, ok, last_validated FROM r WHERE n = 1""")
def health_latest(spark, sf_dir):
    """The appended health samples seen as a table: the latest of each source, and when it was last found well."""
    samples = table(spark, sf_dir, "events").select((F.col("user_id") % 100).alias("source"), F.col("ts").alias("checked_at"), "event_id", (F.col("event_type") != "error").alias("ok"))
    last = samples.groupBy("source").agg(F.max_by(F.struct("checked_at", "ok"), F.struct("checked_at", "event_id")).alias("s"), F.max(F.when(F.col("ok"), F.col("checked_at"))).alias("last_validated"))
    return last.select("source", "s.checked_at", "s.ok", "last_validated")


@query("report_rows", f"""WITH {MARKET} SELECT vehicle_id, price_basis, count(DISTINCT source) AS source_count, round(min(price_lakh), 6) AS lowest, round(max(price_lakh), 6) AS highest,
    CASE WHEN count(DISTINCT source) >= 3 AND max(price_lakh) > 1.1 * min(price_lakh) THEN 'compare' WHEN count(DISTINCT source) = 1 THEN 'verify' ELSE 'watch' END AS signal FROM market GROUP BY vehicle_id, price_basis""")
def report_rows(spark, sf_dir):
    rows = grouped(offers(spark, sf_dir), Intent(condition="both")).select("vehicle_id", "price_basis", F.inline("offers"))
    one = rows.groupBy("vehicle_id", "price_basis").agg(F.countDistinct("source").alias("source_count"), F.min("price_lakh").alias("low"), F.max("price_lakh").alias("high"))
    signal = F.when((F.col("source_count") >= 3) & (F.col("high") > 1.1 * F.col("low")), "compare").when(F.col("source_count") == 1, "verify").otherwise("watch")
    return one.select("vehicle_id", "price_basis", "source_count", F.round("low", 6).alias("lowest"), F.round("high", 6).alias("highest"), signal.alias("signal"))


@query("baseline_demands", f"""WITH {OFF} SELECT DISTINCT brand, condition FROM offers WHERE brand NOT IN (SELECT 'Brand#' || CAST(n_nationkey + 11 AS VARCHAR) FROM nation WHERE n_regionkey = 0)
  UNION SELECT 'Brand#' || CAST(n_nationkey + 60 AS VARCHAR), 'used' FROM nation""")
def baseline_demands(spark, sf_dir):
    """Brands of the catalogue and of the sources' capabilities, once each, without those that already have a demand."""
    name = lambda shift: F.concat(F.lit("Brand#"), (F.col("n_nationkey") + shift).cast("string"))
    nation = table(spark, sf_dir, "nation")
    seen = offers(spark, sf_dir).select("brand", "condition").distinct().join(nation.filter("n_regionkey = 0").select(name(11).alias("brand")), "brand", "left_anti")
    return seen.select("brand", "condition").union(nation.select(name(60).alias("brand"), F.lit("used").alias("condition"))).distinct()


@query("deferred_jobs", "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'queued' ELSE 'done' END AS status, CAST(CASE WHEN o_orderkey % 9 = 0 THEN greatest(0, o_orderkey % 4 - 1) ELSE o_orderkey % 4 END AS BIGINT) AS attempts, CASE WHEN o_orderkey % 9 = 0 THEN o_orderdate + INTERVAL 1 MINUTE ELSE o_orderdate END AS due FROM orders")
def deferred_jobs(spark, sf_dir):
    """A job that found its lock taken goes back to the queue a minute later, and the attempt does not count."""
    blocked, attempts = F.col("o_orderkey") % 9 == 0, F.col("o_orderkey") % 4
    return planning.deferred(table(spark, sf_dir, "orders").select("o_orderkey", attempts.alias("attempts"), F.col("o_orderdate").alias("due"), F.lit("done").alias("status")), blocked).select("o_orderkey", "status", F.col("attempts").cast("long").alias("attempts"), "due")


@query("search_lists", f"""WITH {OFF} SELECT listing_id FROM offers WHERE active AND price_lakh > 0 AND condition IN ('used', 'demo') AND lower(trim(brand)) IN ('brand#13', 'brand#21') AND listing_id % 4 IN (0, 2) AND listing_id % 7 < 6 AND listing_id % 3 = 1""")
def search_lists(spark, sf_dir):
    """Refinements by lists: brand and its other names, fuels, classes of transmission, bodies; what is unknown fails."""
    fuel = F.element_at(F.array(*map(F.lit, text.FUELS)), (F.col("listing_id") % 4 + 1).cast("int"))
    gear = F.element_at(F.array(*map(F.lit, text.TRANSMISSIONS)), (F.col("listing_id") % 7 + 1).cast("int"))
    rows = offers(spark, sf_dir).withColumns({"fuel": fuel, "transmission": gear, "body_type": F.when(F.col("listing_id") % 3 == 1, "SUV").when(F.col("listing_id") % 3 == 2, "Sedan")})
    intent = Intent(brand="Brand#13", brand_aliases=("BRAND#21",), condition="both", fuels=("Diesel", "electric"), transmissions=("automatic",), bodies=("suv", "coupe"))
    rules = intent.market() | intent.refinements(2024)
    for rule in rules.values():
        rows = rows.filter(rule)
    return rows.select("listing_id")


# ------------------------------------------------------------------ text on made titles
@query("folded_names", """SELECT p_partkey, 'skoda-' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') || '-and-o-z-odz-12' AS slug, 'facade' AS word, true AS phrase FROM part""")
def folded_names(spark, sf_dir):
    """Letters fold by their whole compatibility decomposition, composed or not."""
    name = F.concat(F.lit("Škoda "), F.col("p_name"), F.lit(" & ő ž Łódź ½"))
    return table(spark, sf_dir, "part").select("p_partkey", text.slug(name).alias("slug"), F.trim(text.token_text(F.lit("Façade"))).alias("word"), text.has_phrase(F.concat(F.lit("Škoda "), F.col("p_name")), "skoda").alias("phrase"))


@query("asked_prices", """WITH p AS (SELECT p_partkey, CAST(5 + p_partkey % 90 AS DOUBLE) AS v FROM part)
  SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN v WHEN 1 THEN v + 0.5 WHEN 2 THEN v WHEN 3 THEN v WHEN 4 THEN NULL ELSE v END AS price FROM p""")
def asked_prices(spark, sf_dir):
    v = (F.col("p_partkey") % 90 + 5).cast("string")
    far = F.lit(" and a good many other words that stand between the two amounts here, so that they are far apart; ")
    kinds = [
        F.concat(F.lit("Rs "), v),
        F.concat(F.lit("Asking price ₹"), v, F.lit(".5 lakh only"), far, F.lit("EMI from ₹9 lakh")),
        F.concat(F.lit("10% of ₹"), v, F.lit(",00,000")),
        F.concat(v, F.lit(" lakh selling price"), far, F.lit("also ₹35.0 lakh")),
        F.concat(F.lit("reservation ₹"), v, F.lit(" lakh")),
        F.concat(F.lit("offer ₹"), v, F.lit("00000"), far, F.lit("reservation amount ₹30,00,000")),
    ]
    made = F.element_at(F.array(*kinds), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", extract.price_lakh(made).alias("price"))


@query("labelled_months", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '2019-' || lpad(CAST(1 + p_partkey % 12 AS VARCHAR), 2, '0') WHEN 1 THEN '2021-' || lpad(CAST(1 + p_partkey % 12 AS VARCHAR), 2, '0') WHEN 2 THEN '2018' END AS month,
    CASE p_partkey % 3 WHEN 0 THEN 'X5' WHEN 1 THEN 'Es 300H' END AS model, CASE p_partkey % 2 WHEN 0 THEN 'M Sport' END AS variant FROM part""")
def labelled_months(spark, sf_dir):
    names = ("January", "Feb", "march", "APR", "May", "June", "jul", "August", "Sept", "October", "nov", "December")
    month = F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % 12 + 1).cast("int"))
    said = F.element_at(F.array(F.concat(F.lit("x Mfg: "), month, F.lit(" 2019")), F.concat(F.lit("mfg - 2021 "), month), F.lit("Mfg year 2018, reg 2019"), F.lit("reg 2019")), (F.col("p_partkey") % 4 + 1).cast("int"))
    title = F.concat(F.element_at(F.array(F.lit("BMW x5 "), F.lit("Lexus ES 300h "), F.lit("Tata x50 ")), (F.col("p_partkey") % 3 + 1).cast("int")), F.when(F.col("p_partkey") % 2 == 0, "xDrive M Sport").otherwise("plain"))
    return table(spark, sf_dir, "part").select("p_partkey", text.labelled_month(said, "mfg").alias("month"), text.known_model(title).alias("model"), text.variant_of(title).alias("variant"))


# ------------------------------------------------------------------ pages and scans
MAKERS = ("BMW", "Mercedes-Benz", "Skoda", "Tata", "MG", "Rolls-Royce")


def _made_pages(spark, sf_dir, html) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("page_id"), F.concat(F.lit("https://dealer.example/stock/"), F.col("p_partkey").cast("string")).alias("url"), html.alias("html"))


@query("card_listings", f"""SELECT p_partkey AS page_id, {BRAND_NAME_SQL} || ' ' || p_name AS title, CASE WHEN p_partkey % 7 < 6 THEN {BRAND_NAME_SQL} END AS brand, CASE WHEN p_partkey % 7 < 6 THEN p_name ELSE 'Kia ' || p_name END AS model,
    CAST(5 + p_partkey % 90 AS DOUBLE) * CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 100 END AS price_lakh, CAST(2015 + p_size % 8 AS INTEGER) AS year, CAST(10000 + p_size AS DOUBLE) AS km, 'Diesel' AS fuel, 'Pune' AS location, CASE WHEN p_size % 4 = 0 THEN 'demo' ELSE 'used' END AS condition,
    'https://dealer.example/car/' || CAST(p_partkey AS VARCHAR) AS url FROM part""")
def card_listings(spark, sf_dir):
    """Cards of result pages by the layout of a site; cards of sold cars, of other hosts and repeats give nothing."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    card = F.concat(
        F.lit('<div class="x listing-post"><h3 class="title"><a href="/car/'), key, F.lit('#top">'), BRAND_NAME(), F.lit(" "), "p_name", F.lit('</a></h3><b class="price">₹ '), (F.col("p_partkey") % 90 + 5).cast("string"),
        F.when(F.col("p_partkey") % 2 == 0, " Lakh").otherwise(" Cr"), F.lit('</b><br><i class="date-car">Reg. '), (size % 8 + 2015).cast("string"), F.lit("</i><p>"), (size + 10000).cast("string"), F.lit(" km Diesel "),
        F.when(size % 4 == 0, "demonstrator").otherwise(""), F.lit('</p><p class="location"> Pune </p><img src="/a/logo.png"><img src="/a.jpg"></div>'),
    )
    others = F.lit('<div class="listing-post"><h3 class="title"><a href="/car/s">Tata Sold</a></h3><b class="price">₹ 5 Lakh</b> 100 km Sold</div><div class="listing-post"><h3 class="title"><a href="https://other.example/c">Tata Far</a></h3><b class="price">₹ 5 Lakh</b> 100 km</div>')
    pages = _made_pages(spark, sf_dir, F.concat(F.lit("<script>if (a < b) {}</script><div>"), card, card, others, F.lit("</div>")))
    found = cards.listings(pages, lambda html, url: cards.cards(html, url, "luxuryride_cards", MAKERS))
    return found.select("page_id", "title", "brand", "model", "price_lakh", "year", "km", "fuel", "location", "condition", "url")


@query("detail_listings", f"""SELECT p_partkey AS page_id, {BRAND_NAME_SQL} AS brand, CAST(5 + p_partkey % 90 AS DOUBLE) AS price_lakh, CAST(2021 AS INTEGER) AS year, CAST(10000 + p_size AS DOUBLE) AS km FROM part WHERE p_partkey % 7 < 6 AND p_partkey % 5 > 0""")
def detail_listings(spark, sf_dir):
    """Pages of one vehicle: a price without year and mileage is no vehicle, and a catalogue's page is none either."""
    price = F.concat(F.lit("Rs. "), (F.col("p_partkey") % 90 + 5).cast("string"), F.lit(",00,000"))
    facts = F.when(F.col("p_partkey") % 5 > 0, F.concat(F.lit(" Mfg Year: 05/2021 Mileage: "), (F.col("p_size") + 10000).cast("string"), F.lit(" KM"))).otherwise(" call us")
    pages = _made_pages(spark, sf_dir, F.concat(F.lit("<title>"), BRAND_NAME(), F.lit(" "), F.col("p_name"), F.lit("</title><p>"), price, facts, F.lit("</p>")))
    return cards.listings(pages, lambda html, url: cards.detail(html, url, MAKERS)).select("page_id", "brand", "price_lakh", "year", "km")


def _stub(url: str) -> Page:
    """A source in memory: nation n has n % 4 + 1 pages, its last one names the first as next; every seventh fails."""
    _, _, _, n, page = url.split("/")
    if int(n) % 7 == 5:
        raise OSError("unreachable")
    following = int(page) % (int(n) % 4 + 1) + 1
    return Page(f'<p>page {page}</p><a rel="next" href="/{n}/{following}">more</a>')


@query("scan_pages", """WITH n AS (SELECT n_name AS source, n_nationkey AS k, n_nationkey % 4 + 1 AS pages FROM nation), p AS (SELECT *, unnest(generate_series(1, CASE WHEN k % 7 = 5 THEN 1 ELSE least(3, pages) END)) AS page FROM n)
  SELECT source, CAST(page AS INTEGER) AS page, 'https://site.example/' || CAST(k AS VARCHAR) || '/' || CAST(page AS VARCHAR) AS url, CASE WHEN k % 7 = 5 THEN 'failed' ELSE 'ok' END AS status, CAST(CASE WHEN k % 7 = 5 THEN 2 ELSE 1 END AS INTEGER) AS attempts,
         CASE WHEN k % 7 = 5 THEN 'https://site.example/' || CAST(k AS VARCHAR) || '/1' WHEN page = 3 AND pages = 4 THEN 'https://site.example/' || CAST(k AS VARCHAR) || '/4' END AS continuation FROM p""")
def scan_pages(spark, sf_dir):
    """Sources walked page by page over a fetch function: bounded, safe against cycles, failures as rows, and where to go on."""
    sources = table(spark, sf_dir, "nation").select(F.col("n_name").alias("source"), F.concat(F.lit("https://site.example/"), F.col("n_nationkey").cast("string"), F.lit("/1")).alias("start"))
    return scan(sources, _stub, cards.next_page, Policy(pages=3, attempts=2, wait=0.0)).select("source", "page", "url", "status", "attempts", "continuation")


# ------------------------------------------------------------------ states of watches, probes, adapters and caches
@query("watch_states", """WITH e AS (SELECT user_id AS watch_id, ts, event_id, CASE event_type WHEN 'error' THEN 'archived' WHEN 'view' THEN 'paused' ELSE 'active' END AS status FROM events),
  a AS (SELECT watch_id, min(ts) AS gone FROM e WHERE status = 'archived' GROUP BY 1), l AS (SELECT *, row_number() OVER (PARTITION BY watch_id ORDER BY ts DESC, event_id DESC) AS n FROM e)
  SELECT l.watch_id, CASE WHEN gone IS NOT NULL THEN 'archived' ELSE status END AS status, gone AS archived_at, sha256('token-' || CAST(l.watch_id AS VARCHAR)) AS token_hash FROM l LEFT JOIN a USING (watch_id) WHERE n = 1""")
def watch_states(spark, sf_dir):
    """What a log of changes leaves of each watch: archiving is final but deletes nothing, and only the token's hash is kept."""
    status = F.when(F.col("event_type") == "error", "archived").when(F.col("event_type") == "view", "paused").otherwise("active")
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("watch_id"), "ts", "event_id", status.alias("status"))
    last = log.groupBy("watch_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("last"), F.min(F.when(F.col("status") == "archived", F.col("ts"))).alias("archived_at"))
    return last.select("watch_id", F.when(F.col("archived_at").isNotNull(), "archived").otherwise(F.col("last")).alias("status"), "archived_at", F.sha2(F.concat(F.lit("token-"), F.col("watch_id").cast("string")), 256).alias("token_hash"))


@query("fenced_finish", """WITH c AS (SELECT o_custkey AS probe, max(o_orderkey) AS attempt FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
  SELECT o_custkey AS probe, o_orderkey AS attempt, o_orderstatus AS outcome, o_orderkey = attempt AS accepted FROM orders JOIN c ON probe = o_custkey WHERE o_orderstatus = 'F'""")
def fenced_finish(spark, sf_dir):
    """A finished probe counts only for the attempt that holds the claim; results of attempts that were overtaken are refused, not lost."""
    orders = table(spark, sf_dir, "orders")
    claims = orders.filter("o_orderstatus <> 'P'").groupBy(F.col("o_custkey").alias("probe")).agg(F.max("o_orderkey").alias("claimed"))
    done = orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("probe"), F.col("o_orderkey").alias("attempt"), F.col("o_orderstatus").alias("outcome"))
    return done.join(claims, "probe").select("probe", "attempt", "outcome", (F.col("attempt") == F.col("claimed")).alias("accepted"))


@query("adapter_snapshot", """WITH a AS (SELECT s_nationkey % 7 AS adapter, s_suppkey AS version, s_acctbal > 0 AS verified, s_acctbal FROM supplier), r AS (SELECT *, row_number() OVER (PARTITION BY adapter ORDER BY version DESC) AS n FROM a WHERE verified)
  SELECT n.adapter, r.version, r.s_acctbal AS score FROM (SELECT DISTINCT adapter FROM a) n LEFT JOIN r ON r.adapter = n.adapter AND r.n = 1""")
def adapter_snapshot(spark, sf_dir):
    """The latest verified adapter of each name; names without one stay, with nothing to show."""
    rows = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 7).alias("adapter"), F.col("s_suppkey").alias("version"), "s_acctbal")
    sound = F.when(F.col("s_acctbal") > 0, F.col("version"))
    return rows.groupBy("adapter").agg(F.max(sound).alias("version"), F.max_by("s_acctbal", sound).alias("score"))


@query("cache_hits", f"""SELECT count(*) FILTER (WHERE age <= 15 AND size <= 512000) AS hits, count(*) FILTER (WHERE age > 15) AS stale, count(*) FILTER (WHERE age <= 15 AND size > 512000) AS too_large FROM (SELECT epoch((SELECT max(ts) FROM events) - ts) / 60 AS age, event_id * 997 % 600000 AS size FROM events)""")
def cache_hits(spark, sf_dir):
    """Entries that may be served: young enough and small enough; the rest are misses, and why."""
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts")).first()[0]
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6 / 60
    young, small = age <= 15, F.col("event_id") * 997 % 600_000 <= 512_000
    return events.agg(F.count_if(young & small).alias("hits"), F.count_if(~young).alias("stale"), F.count_if(young & ~small).alias("too_large"))


@query("stage_timing", """WITH s AS (SELECT user_id AS request, event_type AS stage, epoch(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) - ts) AS took FROM events)
  SELECT stage, count(took) AS runs, round(avg(took), 3) AS mean_s, round(max(took), 3) AS longest_s FROM s GROUP BY stage""")
def stage_timing(spark, sf_dir):
    """How long each stage of a request took: until the request's next stage began."""
    following = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    took = (F.unix_micros(following.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), took.alias("took"))
    return rows.groupBy("stage").agg(F.count("took").alias("runs"), F.round(F.avg("took"), 3).alias("mean_s"), F.round(F.max("took"), 3).alias("longest_s"))
