"""Cards, detail pages, what pages say of themselves, and scans under a policy."""

import pytest

from tallyloft.operators import cards
from tallyloft.sources import scan
from tallyloft.sources.scan import Page, Policy

BASE, BRANDS = "https://a.example/list", ("BMW", "Mercedes-Benz", "Tata", "Tata Motors")


def one(html, name):
    rows = cards.cards(html, BASE, name, BRANDS)
    assert len(rows) == 1, rows
    return rows[0]


def test_layouts_of_cards():
    r = one('<div class="NewUcExCard z"><a href="/used-car-details/x-1.htm" title="2019 BMW X1 sDrive">2019 BMW X1</a> ₹ 21.5 Lakh EMI ₹ 9,000 <span>45,000 kms</span> Petrol Automatic <i class="distanceText">Delhi</i></div>', "cardekho_cards")
    assert (r["title"], r["brand"], r["model"], r["price_lakh"], r["year"], r["km"], r["fuel"], r["transmission"], r["location"]) == ("2019 BMW X1 sDrive", "BMW", "X1 sDrive", 21.5, 2019, 45000.0, "Petrol", "Automatic", "Delhi")
    r = one('<div class="o-cardFrame-1"><a href="/used/delhi/bmw-x1/ab12cd34/"><h3>2018 Mercedes Benz C-Class</h3></a>₹ 1.2 Crore 10,000 km<img src="data:x"><img data-src="/i.jpg"></div>', "carwale_cards")
    assert (r["brand"], r["model"], r["price_lakh"], r["image"]) == ("Mercedes-Benz", "C-Class", 120.0, "https://a.example/i.jpg")
    r = one('<a href="/buy-used-tata-nexon-1234567/"><img alt="2020 Tata Nexon - front" src="/n.jpg"><img alt="x" src="/y.jpg">EMI ₹ 1 lakh ₹ 8 lakh 30,000 km<div class="p hubAddress9">Pune</div></a>', "cars24_cards")
    assert (r["title"], r["model"], r["price_lakh"], r["image"], r["location"], r["year"]) == ("2020 Tata Nexon", "Nexon", 8.0, "https://a.example/n.jpg", "Pune", 2020)
    r = one('<li class="card-list-container"><b data-share-make="Tata" data-share-model="Harrier" data-share-mfgyear="2021" data-share-cityname="Goa"></b><a href="/second-hand/goa/tata/ab12cd34"><h3>Harrier XZ</h3></a><i class="cr_prc">₹ 15,50,000</i>20,000 km</li>', "cartrade_cards")
    assert (r["brand"], r["model"], r["price_lakh"], r["year"], r["location"]) == ("Tata", "Harrier", 15.5, 2021, "Goa")
    r = one('<article><a href="/buy-used-cars/c/c-class/1"></a><h2 class="main-heading">C-Class</h2><p class="car-price">₹ 45,00,000</p><ul class="car-spec"><li>2022<li>Diesel<li>9,000 km</ul></article>', "mercedes_cards")
    assert (r["brand"], r["price_lakh"], r["year"], r["km"]) == ("Mercedes-Benz", 45.0, 2022, 9000.0)
    for gone in ("Sold", "Booked"):
        assert cards.cards(f'<div class="main-car"><h3><a href="/c">BMW</a></h3><p class="posted_by">₹ 9 lakh</p>9 km {gone}</div>', BASE, "ninthgear_cards", BRANDS) == []
    for html in (None, "", "<a <<", '<div class="main-car"><h3><a href="/c">BMW</a></h3>9 km</div>', '<div class="main-car"><h3><a>BMW</a></h3><p class="posted_by">₹ 9 lakh</p>9 km</div>'):
        assert cards.cards(html, BASE, "ninthgear_cards", BRANDS) == []
    with pytest.raises(KeyError):
        cards.cards("", BASE, "no such layout", BRANDS)
    deep = "<div>" * 50_000 + '<div class="main-car"><h3><a href="/c">BMW X</a></h3><p class="posted_by">₹ 9 lakh</p>9 km</div>'
    assert one(deep, "ninthgear_cards")["model"] == "X"


def test_detail_pages_need_evidence():
    good = "<title>2021 Tata Motors Safari</title><script>₹ 1</script><p>₹ 18.5 Lakh</p> Mileage: 12,000 KM"
    (r,) = cards.detail(good, "https://a.example/car/1", BRANDS)
    assert (r["brand"], r["model"], r["price_lakh"], r["year"], r["km"]) == ("Tata Motors", "Safari", 18.5, 2021, 12000.0)
    assert cards.detail(good, "https://a.example/demo-cars/", BRANDS) == [] and cards.detail(good.replace("Safari", "Safari for sale in India"), BASE, BRANDS) == []
    assert cards.detail("<title>BMW X1</title> ₹ 20 Lakh", BASE, BRANDS) == [] and cards.detail(None, BASE, BRANDS) == []
    (r,) = cards.detail("<h1>BMW X1</h1> Rs. 20,00,000 VIN: WBA8E9C50GK646795", BASE, BRANDS)
    assert (r["price_lakh"], r["year"], r["km"]) == (20.0, None, None)


def test_what_pages_say_of_themselves():
    assert cards.next_page('<a href="?p=1">1</a><a rel="Next" href="?p=2#x">2</a>', BASE) == BASE + "?p=2"
    assert cards.next_page('<a title="go to next" href="/list">x</a>', BASE) is None and cards.next_page('<a class="next page-numbers" href="/p2">', BASE) == "https://a.example/p2" and cards.next_page(None, BASE) is None
    assert cards.advertised_total("<h1>1,234 Used <b>BMW X1</b> cars</h1>") == 1234 and cards.advertised_total("<h1>Used cars</h1>") is None
    assert cards.advertised_total("<h1>99 Used BMW X1 cars</h1>", "bmw-x1") == 99 and cards.advertised_total("<h1>99 Used cars</h1>", "bmw-x1") is None
    html = '<a href="/used-cars-in-pune" title="Used cars in Pune">x</a><a href="/used-cars-in-goa?x=1" title="Used cars in Goa">x</a><a href="/dealer/7/">Seven</a><a href="https://b.example/dealer/8">Eight</a>'
    got = cards.advertised_scopes(html, BASE, r"/used-cars-in-\w+", r"Used cars in (\w+)", r"/dealer/\d+/")
    assert [(x["kind"], x["label"], x["url"]) for x in got] == [("city", "Pune", "https://a.example/used-cars-in-pune"), ("dealer_catalogue", "Seven", "https://a.example/dealer/7")]
    assert cards.page_is_stalled('<span class="page-numbers current">1</span>', BASE + "?paged=2") and not cards.page_is_stalled("", BASE + "?paged=2")


def test_scans_retry_bound_and_go_on():
    waits, calls = [], []

    def fetch(url):
        calls.append(url)
        if url.endswith("/flaky") and calls.count(url) < 3:
            raise OSError("busy")
        if url.endswith("/down"):
            raise TimeoutError("no answer")
        if url.endswith("/pdf"):
            return Page("x", "application/pdf")
        return Page("y" * (20 if url.endswith("/big") else 3), "text/html; charset=utf-8")

    policy = Policy(attempts=3, wait=1.0, bytes=10, hosts=("a.b",))
    got = {u: scan.fetched(f"https://a.b/{u}", fetch, policy, waits.append)[1:3] for u in ("ok", "flaky", "down", "pdf", "big")}
    assert got == {"ok": ("ok", 1), "flaky": ("ok", 3), "down": ("failed", 3), "pdf": ("wrong_kind", 1), "big": ("too_large", 1)}
    assert waits == [1.0, 2.0, 1.0, 2.0]
    assert scan.fetched("https://other/", fetch, policy)[1] == scan.fetched("file:///etc", fetch, policy)[1] == "refused"
    circle = {"https://a.b/1": "https://a.b/2", "https://a.b/2": "https://a.b/1"}
    rows = list(scan.walk("s", "https://a.b/1", lambda u: Page("z"), lambda html, u: circle[u], Policy(), waits.append))
    assert [(r["page"], r["continuation"]) for r in rows] == [(1, None), (2, None)]
    rows = list(scan.walk("s", "https://a.b/1", lambda u: Page("z"), lambda html, u: u + "x", Policy(pages=3), waits.append))
    assert [r["continuation"] for r in rows] == [None, None, "https://a.b/1xxx"]


def test_a_scan_goes_on_where_it_stopped(spark):
    sources = spark.createDataFrame([("a", "https://a.b/1"), ("b", None), ("c", "ftp://x")], "source string, start string")
    policy = Policy(pages=2, attempts=1)
    first = scan.scan(sources, lambda u: Page(u), lambda html, u: u + "1" if len(u) < 16 else None, policy, parallel=2)
    rows = {(r["source"], r["page"]): (r["status"], r["continuation"]) for r in first.collect()}
    assert rows == {("a", 1): ("ok", None), ("a", 2): ("ok", "https://a.b/111"), ("c", 1): ("refused", None)}
    assert {tuple(r) for r in scan.resumed(sources, first).collect()} == {("a", "https://a.b/111"), ("b", None), ("c", "ftp://x")}
