"""Functions of source discovery and catalogues, all JVM-side: classes of sources, segments, landing pages, model names, safe tokens, contacts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloft.functions import text, url

# Brands by segment, and the words that tell classes of sources and kinds of pages.
LUXURY = ("BMW", "Mercedes-Benz", "Audi", "Volvo", "Lexus", "Jaguar", "Land Rover", "Porsche", "Maserati", "Ferrari", "Lamborghini", "Aston Martin", "Bentley", "Rolls-Royce", "McLaren", "Lotus", "Mini", "MINI")
PREMIUM = ("Jeep", "Skoda", "Volkswagen", "Toyota", "BYD", "MG Motor", "MG")
CONDITION_WORDS = {"demo": ("demo car", "demo vehicle", "demonstrator", "demo cars"), "used": ("used car", "second hand", "pre-owned", "pre owned", "certified used")}
TYPE_WORDS = {
    "oem_certified": ("certified", "approved used", "oem"),
    "dealer_network": ("dealer", "dealership", "showroom", "dealer network"),
    "classifieds": ("classified", "owner", "direct seller"),
    "luxury_specialist": ("luxury", "premium", "pre-owned luxury"),
    "marketplace": ("marketplace", "second hand cars", "used cars"),
}
STOCK_WORDS = ("buy", "inventory", "cars for sale", "used cars")
DETAIL_PATHS = ("/used-car-details/", "/used/", "/cars/", "/listing/", "/vehicle/")
CATALOGUE_WORDS = ("used cars", "pre-owned", "cars for sale", "dealer", "certified")
LANDING_WORDS = ("used cars", "second hand", "pre-owned", "certified", "approved", "demo cars", "dealer", "dealership", "marketplace", "cars for sale", "luxury cars", "pre owned")
GONE_MODEL = r"(?i)\bdiscontinued\b|\b(?:expected launch|upcoming|estimated)\b"
PRICE_TAIL = r"(?i)\s+(?:₹|Rs\.?)\s*[\d.,]+(?:\s*-\s*[\d.,]+)?(?:\s*(?:Cr|Crore|Crores|Lakh|Lakhs))?\s*\*?\s*$"
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
PHONE = r"^\+[1-9][0-9]{7,14}$"


def holds_any(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def first_class(c: Column, classes: dict[str, tuple[str, ...]], other: str) -> Column:
    """The first class, in their order, one of whose words the text contains."""
    out = F
    for name, words in classes.items():
        out = out.when(holds_any(c, words), name)
    return out.otherwise(other)


def evidence_text(title: Column, snippet: Column, address: Column, words_only: bool = True) -> Column:
    """Title, snippet and the path of the URL in lower case; the query that found a page is no evidence about it."""
    path = F.lower(F.coalesce(url.path(address), F.lit("")))
    path = F.regexp_replace(path, "[^a-z0-9]+", " ") if words_only else path
    return F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit("")), path))


def source_class(title: Column, snippet: Column, address: Column, brand: Column) -> Column:
    """A struct of ``source_type``, ``condition`` and ``confidence`` (0.45 to 1) of a page that a discovery found."""
    said = evidence_text(title, snippet, address)
    condition, kind = first_class(said, CONDITION_WORDS, "both"), first_class(said, TYPE_WORDS, "unknown")
    point = lambda ok, n: F.when(ok, n).otherwise(0)
    hundredths = 45 + point(F.contains(said, F.lower(brand)) & (brand != ""), 15) + point(condition != "both", 10) + point(kind != "unknown", 20) + point(holds_any(said, STOCK_WORDS), 10)
    return F.struct(kind.alias("source_type"), condition.alias("condition"), (F.least(F.lit(100), hundredths) / 100).alias("confidence"))


def is_landing_page(title: Column, snippet: Column, address: Column) -> Column:
    """Whether a result looks like a catalogue, dealer or marketplace page rather than the page of one vehicle."""
    said = evidence_text(title, snippet, address, words_only=False)
    web = F.coalesce(url.scheme(address).isin("http", "https") & (url.host(address) != ""), F.lit(False))
    detail = holds_any(F.lower(F.coalesce(url.path(address), F.lit(""))), DETAIL_PATHS)
    return web & holds_any(said, LANDING_WORDS) & (~detail | holds_any(said, CATALOGUE_WORDS))


def segment(brand: Column) -> Column:
    return F.when(brand.isin(*LUXURY), "luxury").when(brand.isin(*PREMIUM), "premium").otherwise("mass_market")


def catalogue_name(label: Column, brand: Column) -> Column:
    """A model's name from a catalogue's label, without price, stars and the brand before it; null for labels of models gone or to come."""
    clean = text.collapse(label)
    shown = F.trim(F.regexp_replace(F.trim(F.regexp_replace(clean, PRICE_TAIL, "")), r"\s+\*+$", ""))
    # The brand goes if the label's first words spell it, hyphen or not, and words are left after it.
    words = lambda c: F.filter(F.split(F.trim(text.token_text(c)), " "), lambda w: w != "")
    mine, its = words(shown), words(F.coalesce(brand, F.lit("")))
    leads = (F.size(its) > 0) & (F.size(mine) > F.size(its)) & (F.slice(mine, F.lit(1), F.greatest(F.size(its), F.lit(1))) == its)
    pattern = F.concat(F.lit(r"(?i)^"), F.array_join(its, r"[^a-zA-Z0-9]+"), F.lit(r"[\s:-]+"))
    bare = F.when(leads, F.regexp_replace(shown, pattern, F.lit(""))).otherwise(shown)
    return F.when(~clean.rlike(GONE_MODEL), F.nullif(F.trim(bare), F.lit("")))


def split_query(query: Column, brands: tuple[str, ...]) -> Column:
    """A struct of ``brand`` (the longest that the query contains) and ``model`` (what else it says, a second mention of the brand aside)."""
    q = text.collapse(F.coalesce(query, F.lit("")))
    low = text.fold_accents(q)
    out = F
    for b in sorted(brands, key=lambda b: (-len(b), b)):
        rest = F.trim(F.regexp_replace(F.regexp_replace(low, rf"^(.*?)\Q{b.lower()}\E", "$1"), rf"^(.*?)\Q{b.lower()}\E", "$1"))
        out = out.when(F.contains(low, F.lit(b.lower())), F.struct(F.lit(b).alias("brand"), F.nullif(text.collapse(rest), F.lit("")).alias("model")))
    return out.otherwise(F.struct(F.lit(None).cast("string").alias("brand"), F.nullif(low, F.lit("")).alias("model")))


def safe_token(c: Column, limit: int = 80) -> Column:
    """A value fit for a line of a log: other characters become ``_``, bounded in length; ``unknown`` for none."""
    clean = F.substring(F.regexp_replace(F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown")), "[^A-Za-z0-9._-]", "_"), 1, limit)
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("unknown"))


def safe_path(address: Column, limit: int = 120) -> Column:
    """The path of a URL fit for a log: never credentials, query or fragment."""
    return F.substring(F.regexp_replace(F.coalesce(url.path(address), F.lit("")), "[^A-Za-z0-9/_-]", "_"), 1, limit)


def contact_kind(c: Column) -> Column:
    """email, phone (E.164) or null."""
    return F.when(c.rlike(EMAIL), "email").when(c.rlike(PHONE), "phone")


def money_sentence(hundredths: Column, basis: Column) -> Column:
    """The sentence that states a recorded price, given in hundredths of a lakh."""
    shown = F.concat((F.floor(hundredths / 100)).cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"))
    return F.concat(F.lit("Recorded asking price: INR "), shown, F.lit(" lakh; price basis: "), F.coalesce(F.nullif(basis, F.lit("")), F.lit("unspecified")), F.lit("."))


def field_sentence(label: str, value: Column) -> Column:
    """The sentence that states a field of the canonical record; null where nothing is known."""
    known = F.when(~F.lower(value).isin("", "unknown", "unspecified"), value)
    return F.concat(F.lit(f"Canonical inventory record — {label}: "), known, F.lit(". Attribute provenance is not independently verified by this guide."))
