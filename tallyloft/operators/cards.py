"""Listings from the cards of result pages, from single-vehicle pages, and what a page says of its pages and totals.

A site's cards are described by a ``Layout``: what a card is, and where in it the link, title, price and other fields
stand. One reader serves all layouts. It runs in Arrow batches on the standard library's HTML parser.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import parse_qs, urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame

CARD = "page_id long, layout string, title string, brand string, model string, price_lakh double, year int, km double, fuel string, transmission string, location string, condition string, url string, image string"

# Tags without an end, and how cards write amounts, mileage, years, states and kinds.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
PRICE = re.compile(r"(?:₹|Rs\.?)\s*([\d,]+(?:\.\d+)?)\s*(lakhs?|lacs?|crores?|cr|l)?\b", re.I)
KM = re.compile(r"([\d,]+(?:\.\d+)?)\s*kms?\b", re.I)
YEAR = re.compile(r"\b((?:19|20)\d{2})\b")
GONE = re.compile(r"\b(?:sold out|sold|reserved|booked|just missed|no longer available)\b", re.I)
FUEL = re.compile(r"\b(Petrol|Diesel|Electric|Hybrid|CNG)\b", re.I)
GEAR = re.compile(r"\b(Automatic|Manual|Auto)\b", re.I)
DEMO = re.compile(r"\b(?:demo|demonstrator)\b", re.I)
NOT_A_PHOTO = re.compile(r"icon|logo|dummy|placeholder|\.svg(?:\?|$)", re.I)


class Node:
    """An element: tag, attributes, children (elements and strings), parent."""

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        """This element and all below it, in page order; without recursion, so depth is no limit."""
        stack: list = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(x for x in reversed(node.children) if isinstance(x, Node))

    def text(self) -> str:
        stack, out = [self], []
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in ("script", "style"):
                stack.extend(reversed(x.children))
        return " ".join(" ".join(out).split())

    def is_a(self, what: str) -> bool:
        """Whether it fits ``tag``, ``.class``, ``tag.class``, ``.part*`` (a class that holds ``part``) or ``[attribute]``."""
        tag, _, rest = what.partition(".")
        if what.startswith("["):
            return what.strip("[]") in self.attrs
        if tag and self.tag != tag:
            return False
        classes = self.attrs.get("class", "").split()
        return not rest or (any(rest[:-1] in c for c in classes) if rest.endswith("*") else rest in classes)

    def all(self, path: str) -> list[Node]:
        """Elements below that fit the last of the path's steps, inside ones that fit those before."""
        steps = path.split()
        found = [n for n in self.walk() if n is not self and n.is_a(steps[-1])]
        for n in list(found):
            above, left = n.parent, steps[:-1]
            while left and above is not None:
                left = left[:-1] if above.is_a(left[-1]) else left
                above = None if above is self else above.parent
            if left:
                found.remove(n)
        return found

    def one(self, path: str | None) -> Node | None:
        return next(iter(self.all(path)), None) if path else None


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(html: str | None) -> Node:
    reader = _Tree()
    reader.feed(html or "")
    reader.close()
    return reader.root


@dataclass(frozen=True)
class Layout:
    """Where the parts of a site's cards stand; what is not named is looked for in the whole card's text.

    ``path``: what the link's path must look like. ``title_from``: an attribute that holds the title instead of the text.
    ``fields``: attributes of the card or below it that name a value outright. ``bare``: units of an amount without a word that make a lakh.
    """

    card: str
    link: str = "a"
    path: str = r"/.*"
    title: str | None = None
    title_from: str | None = None
    price: str | None = None
    year: str | None = None
    location: str | None = None
    image: str = "img"
    photo: str = ""
    last_price: bool = False
    bare: float = 100_000
    brand: str | None = None
    fields: dict[str, str] = field(default_factory=dict)


# The layouts of the sites that are read, as their pages are written.
LAYOUTS = {
    "cardekho_cards": Layout(card=".NewUcExCard", path=r"/used-car-details/[^/]+\.htm", title_from="title", location=".distanceText"),
    "carwale_cards": Layout(card=".cardFrame*", path=r"(?i)/used/[^/]+/[^/]+/[a-z0-9]{8}/?", title="h3"),
    "cars24_cards": Layout(card="a", link="", path=r"/buy-used-[^/]+-\d{6,}/?", title="img", title_from="alt", location=".hubAddress*", photo=r"^(?:19|20)\d{2} ", last_price=True),
    "cartrade_cards": Layout(
        card="li.card-list-container", path=r"(?i)/second-hand/[^/]+/[^/]+/[a-z0-9]{8}", title="a h3", price=".cr_prc", photo=r"^Used ",
        fields={"brand": "data-share-make", "model": "data-share-model", "year": "data-share-mfgyear", "location": "data-share-cityname"},
    ),
    "bbt_cards": Layout(card="[data-product-id]", path=r".*-detail-page.*", title="h6", price="a p", year="a span"),
    "autobest_cards": Layout(card="a", link="", title=".abe_car_lfttxt span", title_from="title", price=".abe_car_rghttxt p", year=".abe_car_rghttxt span"),
    "luxuryride_cards": Layout(card=".listing-post", link="h3.title a", title="h3.title a", price=".price", year=".date-car", location=".location"),
    "ninthgear_cards": Layout(card=".main-car", link="h3 a", title="h3 a", price=".posted_by", year=".comment", image="img.car-image"),
    "mercedes_cards": Layout(card="article", path=r".*/buy-used-cars/.*", title=".main-heading", price=".car-price", brand="Mercedes-Benz"),
}


def amount(shown: str, last: bool = False, bare: float = 100_000) -> float | None:
    """The first (or last) amount with a currency mark, in lakh; of one without a word, ``bare`` units make a lakh."""
    found = PRICE.findall(shown)
    if not found:
        return None
    number, word = found[-1 if last else 0]
    digits = number.replace(",", "")
    if not digits.strip("."):
        return None
    return float(digits) * 100 if word.lower().startswith("cr") else float(digits) if word else float(digits) / bare


def split_title(title: str, brands: tuple[str, ...]) -> tuple[str | None, str | None]:
    """Brand (the longest that the title starts with, years aside) and the rest, as the model; hyphens and spaces alike."""
    plain = " ".join(YEAR.sub(" ", title).split())
    for brand in sorted(brands, key=len, reverse=True):
        if found := re.match(r"[\s-]+".join(map(re.escape, re.split(r"[\s-]+", brand))) + r"\b[\s:-]*(.*)", plain, re.I):
            return brand, found[1].strip() or None
    return None, plain or None


def cards(html: str | None, base: str, name: str, brands: tuple[str, ...], layouts: dict[str, Layout] = LAYOUTS) -> list[dict]:
    """A page's cards with title, price, mileage and a link of the same host; cards of sold vehicles and repeats go."""
    lay, rows = layouts[name], {}
    for card in tree(html).all(lay.card):
        said = card.text()
        links = [card] if not lay.link else [a for a in card.all(lay.link) if "href" in a.attrs]
        link = next((a for a in links if re.fullmatch(lay.path, urlsplit(urljoin(base, a.attrs.get("href", ""))).path)), None)
        if link is None or not link.attrs.get("href") or GONE.search(said):
            continue
        url = urljoin(base, link.attrs["href"]).split("#")[0]
        photos = [i for i in card.all(lay.image) if re.search(lay.photo, i.attrs.get("alt", ""))]
        holder = (photos[0] if photos else None) if lay.title == "img" else card.one(lay.title) if lay.title else link
        title = (holder.attrs.get(lay.title_from or "") or holder.text()).split(" - ")[0] if holder is not None else ""
        given = {k: next((n.attrs[a] for n in card.walk() if n.attrs.get(a)), None) for k, a in lay.fields.items()}
        priced, dated = card.one(lay.price), card.one(lay.year)
        price = amount(priced.text() if priced is not None else said if not lay.price else "", lay.last_price, lay.bare)
        km, year = KM.search(said), YEAR.search(given.get("year") or (dated.text() if dated is not None else title)) or YEAR.search(said)
        if not title or not price or not km or not km[1].strip(",.") or urlsplit(url).hostname != urlsplit(base).hostname or url in rows:
            continue
        brand, model = split_title(title, brands)
        sources = [i.attrs.get("data-original") or i.attrs.get("data-src") or i.attrs.get("src") or "" for i in photos]
        image = next((urljoin(base, s) for s in sources if s and not s.startswith("data:") and not NOT_A_PHOTO.search(s)), None)
        place = card.one(lay.location)
        rows[url] = {
            "layout": name, "title": title, "brand": given.get("brand") or lay.brand or brand, "model": given.get("model") or model, "price_lakh": price,
            "year": int(year[1]) if year else None, "km": float(km[1].replace(",", "")), "fuel": (m := FUEL.search(said)) and m[1], "transmission": (m := GEAR.search(said)) and m[1],
            "location": given.get("location") or (place.text() or None if place is not None else None), "condition": "demo" if DEMO.search(said) else "used", "url": url, "image": image,
        }
    return list(rows.values())


# Routes and headings of pages that list several vehicles.
CATALOGUE_ROUTES = ("/all", "/buy-used-cars", "/demo-cars", "/pre-owned-cars")
CATALOGUE_HEADING = re.compile(r"\b(?:discover|browse|search|view all)\b|for sale in india", re.I)
MADE = re.compile(r"(?:Manufacturing|Mfg\.?)\s*Year[^0-9]{0,20}(?:\d{1,2}/)?((?:20|19)\d{2})", re.I)
RUN = re.compile(r"(?:Current\s+Mileage|Mileage)[^0-9]{0,20}([\d,]+)\s*(?:KM|KMs|Kilomet)", re.I)
VIN = re.compile(r"(?:VIN|Chassis(?: Number)?)[ :]+([A-HJ-NPR-Z0-9]{17})\b", re.I)


def detail(html: str | None, base: str, brands: tuple[str, ...]) -> list[dict]:
    """The vehicle of a page of its own: a heading with brand and model, a price, and either year and mileage or a VIN. Catalogue pages give none."""
    root = tree(html)
    heading = " ".join(n.text() for n in root.walk() if n.tag in ("title", "h1"))
    if urlsplit(base).path.rstrip("/").lower().endswith(CATALOGUE_ROUTES) or CATALOGUE_HEADING.search(heading):
        return []
    brand, model = split_title(heading, brands)
    said = root.text()
    # A bare amount of up to 100,000 is in lakh already.
    price = amount(said, bare=1)
    price = price / 100_000 if price is not None and price > 100_000 else price
    year, km, vin = MADE.search(said) or YEAR.search(heading), RUN.search(said), VIN.search(said)
    if not brand or not model or not price or not ((year and km) or vin):
        return []
    named = next((n.attrs.get("content") for n in root.walk() if n.tag == "meta" and (n.attrs.get("property") or n.attrs.get("name")) in ("og:image", "twitter:image")), None)
    return [
        {
            "layout": "detail", "title": heading, "brand": brand, "model": model, "price_lakh": price, "year": int(year[1]) if year else None, "km": float(km[1].replace(",", "")) if km else None,
            "fuel": None, "transmission": None, "location": None, "condition": "demo" if DEMO.search(heading) else "used", "url": base, "image": urljoin(base, named) if named else None,
        }
    ]


def next_page(html: str | None, base: str) -> str | None:
    """The page that the page itself names as the next: by ``rel``, by a label with the word, or by the classes of a pager."""
    for n in tree(html).walk():
        if n.tag in ("a", "link") and n.attrs.get("href"):
            label = " ".join(n.attrs.get(k, "") for k in ("aria-label", "title", "data-testid"))
            if "next" in n.attrs.get("rel", "").lower().split() or re.search(r"\bnext\b", label, re.I) or {"next", "page-numbers"} <= set(n.attrs.get("class", "").lower().split()):
                url = urljoin(base, n.attrs["href"]).split("#")[0]
                return url if url != base.split("#")[0] else None
    return None


def advertised_total(html: str | None, scope: str | None = None) -> int | None:
    """How many vehicles the page's heading claims; with ``scope``, only if the heading names all its words."""
    head = tree(html).one("h1")
    shown = head.text() if head is not None else ""
    found = re.match(r"([\d,]+)\s+(?:Used|Second Hand)\b", shown, re.I)
    words = set(re.findall(r"[a-z0-9]+", shown.lower()))
    wanted = {w for w in (scope or "").lower().split("-") if w}
    return int(found[1].replace(",", "")) if found and found[1].strip(",") and wanted <= words else None


def advertised_scopes(html: str | None, base: str, city_path: str | None = None, city_title: str | None = None, catalogue: str | None = None, most: int = 200) -> list[dict]:
    """Links of the same host, without query, to the pages of cities (by path and title) and of dealers (by path), each once."""
    found: dict[str, dict] = {}
    for a in tree(html).all("a"):
        url = urlsplit(urljoin(base, a.attrs.get("href", "")))
        if "href" not in a.attrs or url.scheme not in ("http", "https") or url.hostname != urlsplit(base).hostname or url.query or url.fragment:
            continue
        key, title = url.geturl().rstrip("/"), " ".join(a.attrs.get("title", "").split())
        if city_path and city_title and re.fullmatch(city_path, url.path) and (m := re.fullmatch(city_title, title)):
            found[key] = {"url": key, "kind": "city", "label": m[1]}
        if catalogue and re.fullmatch(catalogue, url.path):
            found[key] = {"url": key, "kind": "dealer_catalogue", "label": a.text()}
    return list(found.values())[:most]


def page_is_stalled(html: str | None, url: str) -> bool:
    """Whether a page shows itself as another page of the pager than was asked for."""
    asked = parse_qs(urlsplit(url).query).get("paged", [""])[0]
    shown = next((n.text() for n in tree(html).walk() if {"page-numbers", "current"} <= set(n.attrs.get("class", "").split())), "")
    return asked.isdigit() and shown.isdigit() and int(asked) != int(shown)


def listings(pages: DataFrame, reader: Callable[[str | None, str], list[dict]]) -> DataFrame:
    """What ``reader`` finds on each of the pages (page_id, url, html): one pass, no shuffle. Null pages give nothing."""
    names = [c.strip().split(" ")[0] for c in CARD.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"page_id": i, **r} for i, u, h in zip(batch["page_id"], batch["url"], batch["html"]) for r in reader(h, u or "")]
            yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "year": "Int32", "price_lakh": "float64", "km": "float64"})

    return pages.select("page_id", "url", "html").mapInPandas(run, CARD)
