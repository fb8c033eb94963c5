"""Golden cases on small tables, and plans."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyloft.functions import discovery, identity, scores, text, timing, url
from tallyloft.operators import coverage, deals, dedupe, eligibility, extract, folding, ledger, planning
from tallyloft.operators import offers as O
from tallyloft.operators.latest import change, failure_streaks, latest, latest_as_of
from tallyloft.plans.search import Intent, grouped, search, zero_result_reason

T0 = datetime(2026, 1, 1)


def value(spark, column, kind="string", given=None):
    return spark.createDataFrame([(given,)], f"x {kind}").select(column).first()[0]


OBS = "listing_id long, observation_id long, observed_at timestamp, price double, negative boolean"


def test_newest_row_decides_before_any_filter(spark):
    rows = [(1, 1, T0, 30.0, False), (1, 2, T0 + timedelta(1), 45.0, False), (2, 3, T0, 30.0, False), (2, 4, T0, 45.0, False), (3, 5, T0, 9.0, False), (3, 6, T0 + timedelta(1), None, True), (4, 7, None, 5.0, False), (4, 8, T0, 6.0, None)]
    last = latest(spark.createDataFrame(rows, OBS), ["listing_id"], "observed_at", "observation_id")
    assert {r["listing_id"]: r["price"] for r in last.collect()} == {1: 45.0, 2: 45.0, 3: None, 4: 6.0}
    assert [r["listing_id"] for r in last.filter("price <= 40 AND NOT negative").collect()] == []


def test_filters_stay_above_the_latest(spark):
    df = spark.createDataFrame([], OBS)
    plan = latest(df, ["listing_id"], "observed_at", "observation_id").filter("listing_id = 3 AND NOT negative")._jdf.queryExecution().optimizedPlan().toString()
    window = plan.index("Window")
    assert plan.index("NOT negative") < window < plan.rindex("listing_id")


def test_as_of_takes_equal_times_and_gives_nulls(spark):
    left = spark.createDataFrame([(1, "a", T0), (1, "b", T0 + timedelta(2)), (2, "c", T0)], "k long, ask string, at timestamp")
    right = spark.createDataFrame([(1, T0, 5), (1, T0 + timedelta(1), 6), (2, T0 + timedelta(1), 7)], "k long, seen timestamp, v int")
    got = {r["ask"]: r["v"] for r in latest_as_of(left, right, ["k"], "at", "seen", "v", ["v"]).collect()}
    assert got == {"a": 5, "b": 6, "c": None}


def test_change_and_streaks(spark):
    rows = [(1, i, T0 + timedelta(hours=i), p, n) for i, (p, n) in enumerate([(100.0, True), (101.0, True), (104.0, True), (None, False), (90.0, None), (90.0, True)])]
    df = spark.createDataFrame(rows, OBS)
    assert [r["changed"] for r in change(df, ["listing_id"], "observed_at", "observation_id", "price").orderBy("observation_id").collect()] == [True, False, True, False, True, False]
    streak = failure_streaks(df, ["listing_id"], "observed_at", "observation_id", F.col("negative"))
    assert [r["streak"] for r in streak.orderBy("observation_id").collect()] == [1, 2, 3, 0, 0, 1]


def test_reasons_fail_closed(spark):
    df = spark.createDataFrame([(1, 5.0, True), (2, None, True), (3, -1.0, None)], "id int, p double, ok boolean")
    rules = {"priced": F.col("p") > 0, "ok": F.col("ok")}
    got = {r["id"]: (r["eligible"], r["exclusion_reasons"]) for r in eligibility.judged(df, rules).collect()}
    assert got == {1: (True, []), 2: (False, ["priced"]), 3: (False, ["priced", "ok"])}
    assert {r["reason"]: r["n"] for r in eligibility.reason_counts(df, rules).collect()} == {"priced": 2, "ok": 1}


OFFER = "listing_id long, vehicle_id long, source string, location string, brand string, model string, variant string, title string, mfg_year int, condition string, price_basis string, price_lakh double, km long, owners int, observed_at timestamp, active boolean, data_consistent boolean, identity_confidence double, source_tier int"


def offer(i, price, vehicle=None, source="s", km=20000, ok=True, variant=None, year=2022, active=True, title="t"):
    return (i, vehicle or i, source, "Pune", "BMW", "X5", variant, title, year, "used", "asking", price, km, 1, T0, active, ok, 0.9, 1)


def test_cohort_median_and_gap(spark):
    rows = [offer(1, 20.0), offer(2, 30.0), offer(3, 40.0)]
    got = grouped(spark.createDataFrame(rows, OFFER), Intent(brand="bmw", phrase="X5")).orderBy("price_lakh").collect()
    assert [r["comp_median"] for r in got] == [30.0] * 3 and got[0]["gap"] == pytest.approx(100 / 3)
    rows[2] = offer(3, 50.0, ok=False)
    got = grouped(spark.createDataFrame(rows, OFFER), Intent()).collect()
    assert {(r["comparable_count"], r["comp_median"]) for r in got} == {(2, None)}


def test_refinements_do_not_move_the_cohort(spark):
    rows = [offer(i, 10.0 + i / 10, km=1000 * i) for i in range(1, 66)]
    found = grouped(spark.createDataFrame(rows, OFFER), Intent(max_km=38000, budget_min=12.9))
    got = O.page(found, "km", 3, 7).collect()
    assert found.count() == 10 and [r["km"] for r in got] == [36000, 37000, 38000] and [r["result_order"] for r in got] == [8, 9, 10]
    assert {(r["comparable_count"], round(r["comp_median"], 6)) for r in got} == {(65, 13.3)}


def test_roll_up_carries_the_cheapest_and_its_nulls(spark):
    rows = [offer(1, 30.0, 7, "b", km=None), offer(2, 32.0, 7, "a", km=5), offer(3, None, 7, "c", km=6)]
    got = O.roll_up(spark.createDataFrame(rows, OFFER), ["vehicle_id"], ["km", "source"]).first()
    assert (got["price_lakh"], got["km"], got["source"], got["source_count"]) == (30.0, None, "b", 3)
    assert [o["listing_id"] for o in got["offers"]] == [1, 2, 3]


def test_empty_page_keeps_total_and_sorts_put_nulls_last(spark):
    found = grouped(spark.createDataFrame([offer(i, 20.0 + i, year=2020 if i else None, variant="v" if i else None) for i in range(3)], OFFER), Intent())
    got = O.page_with_total(found, O.page(found, "price", 10, 99)).collect()
    assert len(got) == 1 and got[0]["total_count"] == 3 and got[0]["vehicle_id"] is None
    assert O.page(found, "year", 10).orderBy("result_order").collect()[-1]["mfg_year"] is None
    assert O.page(found, "gap", 5000, -3).count() == 3
    assert (zero_result_reason(0, 5, 2), zero_result_reason(0, 0, 2), zero_result_reason(0, 0, 0), zero_result_reason(3, 3, 1)) == ("refinements_exclude_all", "no_observed_inventory", "no_applicable_source", None)


@pytest.mark.parametrize("bad", [{"sort": "x"}, {"budget_min": 5, "budget_max": 1}, {"max_km": -1}])
def test_bad_intents(bad):
    with pytest.raises(ValueError):
        Intent(**bad)


def test_search_needs_no_python_and_gathers_only_a_page(spark):
    plan = search(spark.createDataFrame([offer(1, 20.0)], OFFER).cache(), Intent(sort="match"))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("model,hit", [("X5 xDrive40i M-Sport", True), ("X50", False), ("bmw x5", True), (None, False), ("Citroën X5", True)])
def test_phrases_are_whole_words(spark, model, hit):
    assert value(spark, text.has_phrase(F.col("x"), "X5"), given=model) is hit


def test_extraction_from_a_title(spark):
    t = "2024 BMW X1 M Sport | 14,400 km | 1st owner | ₹39.00 lakh"
    get = lambda c: value(spark, c, given=t)
    assert (get(text.mileage(F.col("x"))), get(text.owners(F.col("x"))), get(text.years(F.col("x")))) == (14400, 1, [2024])
    assert get(extract.price_lakh(F.col("x"))) == 39.0
    assert value(spark, extract.price_lakh(F.col("x")), given="EMI ₹3 lakh down payment and more words here so that it is far away. Asking price ₹21.5 lakh") == 21.5
    assert value(spark, text.owners(F.col("x")), given="No. of owners: second") == 2
    assert value(spark, text.mileage(F.col("x")), given="odometer 120 km") is None
    given = {"Rs 45": 45.0, "10% of ₹3,50,000": 3.5, "₹21,50,000 and ₹24,00,000 offer price": 24.0, "₹39 lakh reservation": None, "Price 12.5 lakh": 12.5, "₹1 lakh": None, None: None, "no amount": None, "₹999": None}
    assert {t: value(spark, extract.price_lakh(F.col("x")), given=t) for t in given} == given
    assert [value(spark, text.owners(F.col("x")), given=t) for t in ("third owner", "owner: 2", "ownership serial 12", "2nd owner, first owner", "no owner", None)] == [3, 2, 12, 2, None, None]
    assert [value(spark, text.mileage(F.col("x")), given=t) for t in ("5 km away, run 45,000 kms", "Mileage (ARAI): 62000", "odometer reading of the car which is 62000", "1,23,456 km")] == [45000, 62000, None, 23456]


@pytest.mark.parametrize("vin,ok", [("WBA8E9C50GK646795", True), ("WBA8E9C50GK64679O", False), ("11111111111111111", False), ("WBAXXXXC50GK64679", False), (None, False), ("", False)])
def test_full_vins(spark, vin, ok):
    assert value(spark, text.vin_ok(F.col("x")), given=vin) is ok


def test_url_keys(spark):
    key = lambda u: value(spark, url.url_key(F.col("x")), given=u)
    assert key("https://A.com/car/?id=1#photo") == key("https://a.com/car?id=1&utm_source=x") != key("https://a.com/car?id=2")
    assert key("https://a.com?b=2&a=1") == "https://a.com/?a=1&b=2" and key("ftp://a.com/x") is None and key(None) is None
    assert value(spark, url.domain(F.col("x")), given="https://www.X.org:8/a") == "x.org:8"


@pytest.mark.parametrize("minutes,state", [(0, "fresh"), (360, "fresh"), (361, "aging"), (1441, "stale"), (10081, "expired"), (None, "expired"), (-5, "fresh")])
def test_freshness(spark, minutes, state):
    at = None if minutes is None else T0 - timedelta(minutes=minutes)
    assert value(spark, timing.freshness(F.col("x"), F.lit(T0)), "timestamp", at) == state


def test_delays(spark):
    delays = [value(spark, timing.retry_delay(F.col("x")), "int", n) for n in range(6)]
    assert delays == [15, 30, 60, 120, 240, 1440]
    assert [value(spark, timing.breaker_cooldown(F.col("x")), "int", n) for n in (2, 3, 4, 9)] == [None, 15, 30, 360]
    assert value(spark, timing.refresh_priority(F.col("x"), F.lit(2), F.lit(0.5), F.lit("stale")), "int", 9) == 16.0


def test_deal_scores(spark):
    assert value(spark, scores.deal_score(F.col("x"), F.lit(100000.0)), "double", 85000.0) == 60.0
    assert value(spark, scores.match_score(F.lit(85.0), F.col("x")), "double", 60.0) == 73.8
    assert value(spark, scores.confidence(F.col("x"), F.lit(True), F.lit(True), F.lit(True)), "double", 1.0) == 1.0


def test_identity(spark):
    kind = "vin string, brand string, model string, year int, km long, fuel string, city string"
    rows = [(None, "BMW", "X1", 2022, 3200, "petrol", "Pune"), ("", "bmw", "x-1", 2022, 3249, "Petrol", "PUNE"), (None, "BMW", "X1", 2022, 9200, "petrol", "Pune"), ("WBA8E9C50GK646795", None, None, None, None, None, None), ("WBA*", "BMW", "X1", 2022, 3200, "petrol", "Pune"), (None, "BMW", "X1", 2022, 3200, None, "Pune"), (None, "BMW", "X1", None, 3200, "petrol", "Pune")]
    got = [r["i"] for r in spark.createDataFrame(rows, kind).select(identity.identity(F.col("vin"), F.col("brand"), F.col("model"), F.col("year"), F.col("km"), F.col("fuel"), F.col("city")).alias("i")).collect()]
    assert got[0]["identity_key"] == got[1]["identity_key"] != got[2]["identity_key"]
    assert got[0]["confidence"] == 0.8 and got[3]["identity_key"] == "vin:WBA8E9C50GK646795" and got[3]["confidence"] == 1.0
    assert [g["mode"] for g in got[4:]] == ["provisional"] * 3
    assert value(spark, identity.mileage_bucket(F.col("x")), "long", 1250) == 1000


def test_coverage_counts_offers_and_vehicles(spark):
    facts = spark.createDataFrame([("s", "Pune", 1, "b", T0, True), ("s", "Pune", 1, "b", T0, True), ("t", None, 2, "b", T0, False)], "source string, city string, vehicle_id long, basis string, last_verified_at timestamp, eligible boolean")
    got = {r["source"]: r for r in coverage.matrix(facts, ["source", "city"], ["vehicle_id", "basis"]).collect()}
    assert (got["s"]["eligible_offers"], got["s"]["eligible_vehicles"], got["t"]["excluded_offers"]) == (2, 1, 1)
    top = coverage.concentration(facts).first()
    assert (top["share_percent"], top["top_share_percent"]) == (100.0, 100.0)
    assert coverage.concentration(facts.limit(0)).count() == 0


def test_capacity(spark):
    df = spark.createDataFrame([("used", 360, True)], "condition string, target int, overdue boolean")
    got = coverage.capacity(df, "condition", F.col("target"), F.col("overdue"), F.col("overdue"), F.lit(True)).first()
    assert (got["demand_per_hour"], got["reserved_per_hour"], got["budgets"]) == (0.17, 20.0, 1)


def test_recall_counts_a_listing_once(spark):
    sample = spark.createDataFrame([("s", "https://a.com/1", "BMW", True), ("s", "https://a.com/2", "BMW", True), ("s", "https://a.com/3", "BMW", False)], "source string, url string, brand string, eligible boolean")
    offers = spark.createDataFrame([("s", "https://a.com/1?utm_x=1", "https://a.com/1", "BMW"), ("s", "https://a.com/1", None, "BMW"), ("s", "https://a.com/2", None, "Audi")], "source string, url string, final_url string, brand string")
    got = {r["dimension"]: r["recall"] for r in coverage.recall(sample, offers, url.url_key(F.col("url")), ["url", "final_url"], ["brand"], ["source"]).collect()}
    assert got == {"all": 0.5, "source": 0.5}


def slots(a, b):
    """One of five slots from b, the other pool when one is empty."""
    a, b, out, k = list(a), list(b), [], 0
    while a or b:
        out.append((b if (k % 5 == 0 and b) or not a else a).pop(0))
        k += 1
    return out


@pytest.mark.parametrize("na,nb", [(0, 4), (7, 0), (3, 9), (30, 3), (17, 17)])
def test_fair_slots_follow_the_loop(spark, na, nb):
    rows = [(i, False) for i in range(na)] + [(100 + i, True) for i in range(nb)]
    got = planning.fair_slots(spark.createDataFrame(rows, "id long, b boolean"), F.col("b"), [F.col("id")]).orderBy("slot").collect()
    assert [r["id"] for r in got] == slots(range(na), range(100, 100 + nb))


def test_folds(spark):
    old = spark.createDataFrame([(1, 1, 10, "a"), (2, 5, 11, "b")], "k int, at int, tie int, v string")
    new = spark.createDataFrame([(1, 2, 1, "c"), (2, 4, 99, "late"), (3, 1, 1, "d")], old.schema)
    assert {r["k"]: r["v"] for r in folding.upsert(old, new, ["k"], "at", "tie").collect()} == {1: "c", 2: "b", 3: "d"}
    assert folding.insert_absent(old, new, ["k"]).count() == 3
    maps = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"}), (None, {"x": "y"}), ({"a": "1"}, None)], "m map<string,string>, n map<string,string>")
    assert [r[0] for r in maps.select(folding.merge_maps(F.col("m"), F.col("n"), ("a",))).collect()] == [{"b": "3"}, {"x": "y"}, {}]
    sent = spark.createDataFrame([(1, "sent"), (2, "failed")], "k int, status string")
    assert {r["k"] for r in folding.outbox(new, sent, ["k"]).collect()} == {2, 3}
    assert {r["k"]: r["v"] for r in old.unionByName(new).groupBy("k").agg(*folding.survivor(["v"], "tie", "at")).collect()} == {1: "c", 2: "b", 3: "d"}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_indel_ratio_and_greedy_groups(spark):
    rng = random.Random(0)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in "ab")
        assert dedupe.indel_ratio(a, b) == pytest.approx(200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100)
    rows = [(1, "BMW", "X1", 2020, 10000, "BMW X1 sDrive"), (2, "BMW", "X1", 2021, 11000, "BMW X1 sDrive 20d"), (3, "BMW", "X1", 2022, 10500, "BMW X1 sDrive"), (4, None, "X1", 2020, 10000, "BMW X1 sDrive"), (5, "BMW", "X1", 2020, 30000, "BMW X1 sDrive"), (6, "BMW", "X1", 2020, 10000, "BMW X1 sDrive"), (7, "BMW", "X1", None, None, None)]
    got = {r["id"]: r["group_id"] for r in dedupe.fuzzy(spark.createDataFrame(rows, "id long, brand string, model string, year long, km long, title string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 1, 7: 1}


def test_groups_against_one_pair_after_the_other():
    rng = random.Random(6)
    n = 300
    year, km = [rng.choice([None, 2019, 2020, 2021]) for _ in range(n)], [rng.choice([None, 0, *range(9000, 14000, 500)]) for _ in range(n)]
    title = [rng.choice([None, "", "".join(rng.choice("ab") for _ in range(7))]) for _ in range(n)]

    def alike(new, old):
        years = year[new] and year[old] and abs(year[new] - year[old]) > 1
        far = km[new] and km[old] and abs(km[new] - km[old]) > max(1500, 0.12 * km[new])
        return not years and not far and not (title[new] and title[old] and dedupe.indel_ratio(title[new], title[old]) < 82)

    heads, want = [], []
    for i in range(n):
        mine = [g for g, h in enumerate(heads) if alike(i, h)]
        want.append(mine[0] if mine else len(heads))
        heads += [] if mine else [i]
    assert dedupe.first_similar(year, km, title) == want


def test_exact_duplicates(spark):
    df = spark.createDataFrame([(1, "A  b"), (2, " a b\n"), (3, None), (4, None), (5, "")], "id long, t string")
    assert {r["id"]: (r["representative"], r["copies"]) for r in dedupe.exact(df, "t", "id").collect()} == {1: (1, 2), 2: (1, 2), 3: (3, 1), 4: (4, 1), 5: (5, 1)}


def test_hard_constraints_fail_closed_and_quality_decides(spark):
    pairs = spark.createDataFrame([(1, 80.0, 100.0, 1000), (2, 80.0, 100.0, None), (3, 99.0, 100.0, 1000)], "id int, price double, fair double, km int")
    got = deals.evaluated(pairs, {"mileage": F.col("km") <= 5000}, F.col("price"), F.col("fair"), F.lit(85.0), F.lit(1.0), F.lit(True), F.lit(True))
    assert {r["id"]: (r["eligible"], r["risks"], r["priority"]) for r in got.collect()} == {1: (True, [], "high"), 2: (False, ["mileage"], "ignore"), 3: (True, [], "low")}
    assert {r["id"] for r in deals.alerts(got, F.lit("exceptional")).collect()} == {1}
    assert {r["id"] for r in deals.alerts(got, F.lit("any")).collect()} == {1, 3}


def test_band_join_forms_no_pairs(spark):
    pool = spark.createDataFrame([("b", 2020, 10.0), ("b", 2021, 20.0), ("b", 2023, 50.0)], "brand string, year int, price_lakh double")
    ask = spark.createDataFrame([("b", 2020), ("b", 2022), ("c", 2020)], "brand string, year int")
    got = {(r["brand"], r["year"]): (r["comparable_count"], r["comp_median"]) for r in deals.comparables(ask, pool, ["brand"], "year").collect()}
    assert got == {("b", 2020): (2, 15.0), ("b", 2022): (2, 35.0), ("c", 2020): (None, None)}


def test_ledger(spark):
    batches = spark.createDataFrame([(1,), (2,)], "b long")
    members = spark.createDataFrame([(1,), (1,)], "b long")
    assert {r["b"]: (r["members"], r["missing"]) for r in ledger.verified(batches, members, "b").collect()} == {1: (2, False), 2: (0, True)}
    assert ledger.append_once(members, batches, "b").count() == 3
    assert [r["b"] for r in ledger.absent_scopes(batches, members, ["b"]).collect()] == [2]


PAGE = """<html><head><title>T</title><script type="application/ld+json">{"@graph": [{"@type": "Car", "name": "BMW X1", "brand": {"name": "BMW"}, "model": "X1",
"mileageFromOdometer": {"value": "14,400"}, "vehicleModelDate": "2022", "image": ["a.jpg", "data:x"], "offers": {"price": "3900000", "priceCurrency": "INR", "availability": "InStock"}, "url": "/car/1"}]}</script></head>
<body><a href="/car/9">2021 Audi A4 ₹21.5 lakh 30,000 km</a></body></html>"""


def test_listings_by_the_first_extractor_that_finds_any(spark):
    broken = PAGE.replace('{"@graph"', '{"@graph')
    state = '<script type="application/json">{"a": [{"title": "Skoda", "make": "Skoda", "price": 5, "status": "Sold"}, {"name": "no price"}]}</script>'
    df = spark.createDataFrame([(1, "https://a.com/x", PAGE), (2, "https://a.com/", broken), (3, None, state), (4, "u", None), (5, "u", "<a <<")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in extract.listings(df).collect()}
    assert set(got) == {1, 2, 3}
    assert (got[1]["method"], got[1]["km"], got[1]["price"], got[1]["url"], got[1]["image_count"], got[1]["sold"]) == ("json_ld", 14400, 3900000.0, "https://a.com/car/1", 1, False)
    assert (got[2]["method"], got[2]["price"], got[2]["year"], got[2]["km"]) == ("visible", 2150000.0, 2021, 30000)
    assert (got[3]["method"], got[3]["sold"]) == ("embedded", True)
    assert {r["page_id"]: r["state"] for r in extract.gate(extract.listings(df)).collect()} == {1: "parsed", 2: "failed", 3: "failed"}


@pytest.mark.parametrize("title,brand,model", [("2022 Hyundai Creta SX(O) diesel", "Hyundai", "Creta"), ("Tata Nexon EV Max used", "Tata", "Nexon"), ("Honda City 35,000 km", "Honda", "City"), ("BMW 2020", "BMW", None), (None, "BMW", None)])
def test_model_from_title(spark, title, brand, model):
    assert value(spark, text.model_from_title(F.col("x"), F.lit(brand)), given=title) == model


def test_brands_months_families_and_slugs(spark):
    get = lambda c, given: value(spark, c, given=given)
    names = {"merc": "Mercedes-Benz", "mercedes benz": "Mercedes-Benz", "ds": "DS"}
    assert [get(text.brand_of(F.col("x"), names), t) for t in ("Mercedes-Benz C", "the kids", "a DS 7", None)] == ["Mercedes-Benz", None, "DS", None]
    assert [get(text.labelled_month(F.col("x"), "mfg"), t) for t in ("Mfg: March 2021", "mfg 2020 Sept", "mfg - 2019", "reg 2019")] == ["2021-03", "2020-09", "2019", None]
    assert get(text.model_family(F.lit("BMW"), F.col("x")), "320d M Sport") == "3 Series" and get(text.model_family(F.lit("Mercedes-Benz"), F.col("x")), "e220") == "E-Class" and get(text.model_family(F.lit("BMW"), F.col("x")), "X5") == "X5"
    assert get(text.slug(F.col("x")), " Citroën & Co. ") == "citroen-and-co"
    assert [get(text.slug(F.col("x")), t) for t in ("Škoda Kodiaq", "Sˇkoda", "S\u030ckoda", "ž ł ő ½ ﬁ", "M&M", "ﷺ", "Ⅳ ㎞", "")] == ["skoda-kodiaq", "skoda", "skoda", "z-o-12-fi", "mandm", "", "iv-km", ""]
    assert get(text.has_phrase(F.col("x"), "Škoda"), "the skoda") is True and get(text.has_phrase(F.col("x"), "skoda"), "Škoda Kodiaq") is True
    assert get(text.known_model(F.col("x")), "BMW X1 and x5") == "X1" and get(text.known_model(F.col("x")), "x50") is None and get(text.variant_of(F.col("x")), "GLA AMG Line 4MATIC") == "AMG Line"


def test_urls_join_and_state(spark):
    assert value(spark, text.condition_of(F.col("x")), given="Demo car, used") == "demo" and value(spark, text.sold(F.col("x"))) is False
    assert value(spark, text.has_personal_data(F.col("x")), given="call +91 98765 43210") is True


def test_discovery_classes_names_and_queries(spark):
    get = lambda c, given: value(spark, c, given=given)
    x = F.col("x")
    assert tuple(get(discovery.source_class(x, F.lit("buy BMW"), F.lit("https://a.b/demo-cars"), F.lit("BMW")), "Approved used dealer")) == ("oem_certified", "demo", 1.0)
    assert tuple(get(discovery.source_class(x, F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("")), None)) == ("unknown", "both", 0.45)
    page = lambda u: discovery.is_landing_page(F.lit("Used cars"), F.lit(""), x) if u else None
    assert [get(page(u), u) for u in ("https://a.b/stock", "ftp://a.b/stock", "https://a.b/listing/7")] == [True, False, True]
    assert get(discovery.is_landing_page(F.lit("BMW X5 demo cars"), F.lit(""), x), "https://a.b/listing/7") is False
    names = {"BMW X5 ₹ 95 Lakh*": "X5", "X5 *": "X5", "BMW": "BMW", "Mercedes Benz GLC": "Mercedes Benz GLC", "X7 upcoming": None, " ": None, None: None}
    assert {t: get(discovery.catalogue_name(x, F.lit("BMW")), t) for t in names} == names
    assert get(discovery.catalogue_name(x, F.lit("Mercedes-Benz")), "mercedes benz GLC") == "GLC"
    assert tuple(get(discovery.split_query(x, ("BMW", "MG", "MG Motor")), "mg motor  Hector")) == ("MG Motor", "hector")
    assert tuple(get(discovery.split_query(x, ("BMW",)), "bmw BMW x5")) == ("BMW", "x5") and tuple(get(discovery.split_query(x, ("BMW",)), None)) == (None, None)
    assert get(discovery.safe_token(x), "a b/ü") == "a_b__" and get(discovery.safe_token(x), None) == "unknown" and get(discovery.safe_path(x), "https://u:p@h/a b?q#f") == "/a_b"
    assert [get(discovery.contact_kind(x), t) for t in ("a@b.c", "+919876543210", "98765", None)] == ["email", "phone", None, None]
    assert get(discovery.field_sentence("Fuel", x), "Unspecified") is None and get(discovery.segment(x), "Audi") == "luxury"


def test_images_slots_and_deferred_jobs(spark):
    html = "<meta content='//c.d/og.png' property='og:image'><IMG SRC='a.jpg' alt='Car'><img src='a.jpg'><img src='/b' width='90'><img alt='nothing'>"
    assert value(spark, extract.images(F.col("x"), F.lit("https://a.b/c/d?e")), given=html) == ["https://c.d/og.png", "https://a.b/c/a.jpg"]
    assert value(spark, extract.images(F.col("x"), F.lit("https://a.b/")), given="") == [] and value(spark, extract.images(F.col("x"), F.lit("https://a.b/")), given=None) is None
    df = spark.createDataFrame([(i, "demo" if i < 3 else "used") for i in range(10)] + [(99, None)], "id int, kind string")
    got = {r["slot"]: r["id"] for r in planning.alternate(df, "kind", ("demo", "used"), ["id"], 8).collect()}
    assert got == {1: 0, 2: 3, 3: 1, 4: 4, 5: 2, 6: 5, 7: 6, 8: 7}
    assert planning.alternate(df.limit(0), "kind", ("demo", "used"), ["id"], 8).count() == 0
    jobs = spark.sql("SELECT 'done' AS status, 1 AS attempts, TIMESTAMP '2024-01-01 00:00:00' AS due, true AS busy UNION ALL SELECT 'done', 0, TIMESTAMP '2024-01-01 00:00:00', null")
    assert [(r["status"], r["attempts"], r["due"].minute) for r in planning.deferred(jobs, F.col("busy")).collect()] == [("queued", 0, 1), ("done", 0, 0)]


def test_outbox_of_sides_dealt_alike_moves_neither(spark):
    rows = [(w, i, i % 5) for w in range(20) for i in range(30)] + [(1, 1, 1), (7, None, 3)]
    found = spark.createDataFrame(rows, "watch int, listing int, event int").repartition(4, "listing")
    sent = found.filter("listing % 3 = 0").withColumn("status", F.when(F.col("watch") == 2, "failed").otherwise("sent"))
    got = folding.outbox(found, sent, ["watch", "listing", "event"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted({r for r in rows if r[1] is None or r[1] % 3 or r[0] == 2}, key=str)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(watch" not in plan and plan.count("Exchange hashpartitioning(listing") == plan.count("Exchange hashpartitioning")
    beside = spark.createDataFrame([(1, "a", 5), (1, "a", 5), (2, "b", 6)], "k int, v string, n int")
    assert sorted(map(tuple, folding.outbox(beside, beside.filter("k = 2").select("k", F.lit("pending").alias("status")), ["k"]).collect())) == [(1, "a", 5)]


def test_offers_judged_ahead_give_what_their_pairs_do(spark):
    rows = [(b, p, f, k) for b in (None, 400.0, 1500.0) for p in (None, 70.0, 90.0, 200.0) for f in (None, 100.0) for k in (None, 10, 99)]
    pairs = spark.createDataFrame(rows, "budget double, price double, fair double, km int")
    rules = {"budget": F.col("price") <= F.col("budget") / 5, "mileage": F.col("km") <= 50}
    by = (F.col("price"), F.col("fair"), F.lit(85.0), F.lit(1.0), F.lit(True), F.lit(True))
    want = deals.evaluated(pairs, rules, *by)
    got = deals.judged_pairs(deals.judged_ahead(pairs, rules, "budget", *by), rules["budget"]).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_page_past_over_a_million_results_is_empty(spark):
    df = spark.range(1_000_020).select(F.col("id").alias("vehicle_id"), F.lit("on_road").alias("price_basis"), F.col("id").cast("double").alias("price_lakh"), F.lit(0).alias("observed_at"))
    assert O.page_with_total(df, O.page(df, "price", 10, 1_000_020, 1_000_020)).select("total_count", "vehicle_id").collect() == [(1_000_020, None)]
    assert [r["vehicle_id"] for r in O.page(df, "price", 10, 1_000_015, 1_000_020).collect()] == list(range(1_000_015, 1_000_020))
    assert O.page(df.limit(20), "price", 10, 15, 20).count() == 5
