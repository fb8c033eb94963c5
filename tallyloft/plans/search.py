"""Offer search: an intent becomes Columns, the Columns a plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloft.functions import text
from tallyloft.operators import offers as O
from tallyloft.operators.eligibility import holds

VEHICLE = ["vehicle_id", "brand", "model", "variant", "mfg_year", "condition", "location", "identity_confidence", "price_basis"]
CARRIED = ["km", "owners", "observed_at", "source", "source_tier", "listing_id"]


@dataclass(frozen=True)
class Intent:
    """What a buyer asks for. ``brand``, ``phrase`` and ``condition`` define the market; the rest only refines."""

    brand: str | None = None
    brand_aliases: tuple[str, ...] = ()  # other names the market may carry the brand under
    phrase: str | None = None
    condition: str | None = None
    budget_min: float | None = None
    budget_max: float | None = None
    max_age: int | None = None
    year: int | None = None
    max_km: int | None = None
    max_owners: int | None = None
    city: str | None = None
    sources: tuple[str, ...] = ()
    fuels: tuple[str, ...] = ()
    transmissions: tuple[str, ...] = ()  # classes: automatic, manual
    bodies: tuple[str, ...] = ()
    sort: str = "price"
    limit: int = 50
    offset: int = 0
    vehicle_ids: tuple[int, ...] = field(default=())

    def __post_init__(self):
        if self.sort not in O.ORDERS:
            raise ValueError(f"unknown sort {self.sort!r}")
        for low, high in ((self.budget_min, self.budget_max),):
            if low is not None and high is not None and low > high:
                raise ValueError("the least budget is above the greatest")
        for v in (self.budget_min, self.budget_max, self.max_age, self.max_km, self.max_owners):
            if v is not None and v < 0:
                raise ValueError("limits are not negative")

    def market(self) -> dict[str, Column]:
        """Predicates of the cohort: whatever is not asked for is left out of the plan."""
        rules = {"active": F.col("active"), "priced": F.col("price_lakh") > 0}
        if self.brand:
            names = dict.fromkeys(b.strip().lower() for b in (self.brand, *self.brand_aliases))
            rules["brand"] = F.lower(F.trim("brand")).isin(*names)
        if self.phrase:
            rules["phrase"] = text.has_phrase(F.col("model"), self.phrase) | text.has_phrase(F.col("variant"), self.phrase) | text.has_phrase(F.col("title"), self.phrase)
        if self.condition in ("used", "demo", "new"):
            rules["condition"] = F.col("condition") == self.condition
        elif self.condition == "both":
            rules["condition"] = F.col("condition").isin("used", "demo")
        return rules

    def refinements(self, this_year: int) -> dict[str, Column]:
        """Predicates of the buyer. A null in a column that is constrained fails."""
        rules: dict[str, Column] = {}
        if self.budget_min is not None:
            rules["budget_min"] = F.col("price_lakh") >= self.budget_min
        if self.budget_max is not None:
            rules["budget_max"] = F.col("price_lakh") <= self.budget_max
        if self.max_age is not None:
            rules["max_age"] = F.col("mfg_year") >= this_year - self.max_age
        if self.year is not None:
            rules["year"] = F.col("mfg_year") == self.year
        if self.max_km is not None:
            rules["max_km"] = F.col("km") <= self.max_km
        if self.max_owners is not None:
            rules["max_owners"] = F.col("owners") <= self.max_owners
        if self.city:
            rules["city"] = F.lower(F.trim("location")) == self.city.strip().lower()
        if self.sources:
            rules["sources"] = F.col("source").isin(*self.sources)
        if self.fuels:
            rules["fuels"] = F.lower("fuel").isin(*(x.lower() for x in self.fuels))
        if self.transmissions:
            rules["transmissions"] = text.transmission_class(F.col("transmission")).isin(*(x.lower() for x in self.transmissions))
        if self.bodies:
            rules["bodies"] = F.lower("body_type").isin(*(x.lower() for x in self.bodies))
        return rules


def grouped(latest_offers: DataFrame, intent: Intent, this_year: int = 2024) -> DataFrame:
    """All results with cohort, gap and match rank, before sorting and paging."""
    market = latest_offers.filter(holds(intent.market()))
    rolled = O.roll_up(market.filter(holds(intent.refinements(this_year))), VEHICLE, CARRIED)
    if intent.vehicle_ids:
        rolled = rolled.filter(F.col("vehicle_id").isin(*intent.vehicle_ids))
    return O.gapped(O.with_cohorts(rolled, O.cohorts(market)))


def search(latest_offers: DataFrame, intent: Intent, this_year: int = 2024) -> DataFrame:
    return O.page(grouped(latest_offers, intent, this_year), intent.sort, intent.limit, intent.offset)


def zero_result_reason(total: int, market_total: int, planned_sources: int) -> str | None:
    """Why a search came back empty."""
    if total:
        return None
    if not planned_sources:
        return "no_applicable_source"
    return "refinements_exclude_all" if market_total else "no_observed_inventory"
