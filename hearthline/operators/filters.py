"""Shared filters: what a board's controls do to its fact tables before anything is aggregated."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X

ALL = "All"


def where_multi(df: DataFrame, column: str, values: Iterable[str] | None) -> DataFrame:
    """Keeps the chosen values; no choice, or All among it, keeps every row."""
    values = list(values or [ALL])
    return df if ALL in values else df.where(F.col(column).isin(values))


def where_category(df: DataFrame, column: str, values: Iterable[str] | None) -> DataFrame:
    """where_multi on a column in which null is the value unknown."""
    values = list(values or [ALL])
    return df if ALL in values else df.where(X.known(column).isin(values))


def where_bounds(df: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Inclusive bounds; null fails a bound that is set and passes one that is not."""
    if low is not None:
        df = df.where(F.col(column) >= low)
    return df if high is None else df.where(F.col(column) <= high)


def where_deal(df: DataFrame, deal: str | None) -> DataFrame:
    """"sell" means sales; All leaves out nightly rentals."""
    deal = {"sell": "sale", None: ALL}.get(deal, deal)
    return df.where("deal <> 'daily_rent'") if deal == ALL else df.where(F.col("deal") == deal)


def active(entities: DataFrame) -> DataFrame:
    return entities.where("closed_at is null")


def exits(lifecycle: DataFrame) -> DataFrame:
    return lifecycle.where("event = 'closed'").withColumn("days_listed", F.datediff("occurred_on", "opened_on"))


@dataclass(frozen=True)
class Window:
    """Days after `start` up to and with `end`; the previous window is as long and ends where this one starts."""

    start: date
    end: date

    def holds(self, column: Column | str) -> Column:
        c = X.col(column)
        return (c > F.lit(self.start)) & (c <= F.lit(self.end))

    def holds_time(self, column: Column | str) -> Column:
        """The closed range on timestamps; a date counts as its midnight."""
        return X.col(column).cast("timestamp_ntz").between(F.lit(self.start).cast("timestamp_ntz"), F.lit(self.end).cast("timestamp_ntz"))

    @property
    def days(self) -> int:
        return (self.end - self.start).days

    @property
    def previous(self) -> Window:
        return Window(self.start - timedelta(days=self.days), self.start)


def when_covered(window: Window, coverage: Column, value: Column) -> Column:
    """value, if the window before starts on the first covered day or later."""
    return F.when(F.lit(window.previous.start) >= coverage, value)


def covered_days(window: Window, coverage: Column) -> Column:
    return F.nullif(F.datediff(F.lit(window.end), F.greatest(F.lit(window.start), coverage)), F.lit(0))


# -- the catalogue of controls ------------------------------------------------------------------------------------

#: Fixed yes/no amenities of the source: control and attribute codes.
AMENITIES = {
    "balcony": ("balkon",), "air_conditioning": ("klima",), "electricity": ("struja",), "water": ("voda",), "sewerage": ("kanalizacija",), "gas": ("plin",), "registered": ("uknjizeno-zk",),
    "internet": ("internet",), "cable_tv": ("kablovska-tv",), "security_door": ("blindirana-vrata",), "telephone": ("telefonski-priklju-ak", "telefonski-prikljucak"), "video_surveillance": ("video-nadzor",),
    "storage": ("ostava-pajz", "ostava-spajz"), "basement_attic": ("podrum-tavan",), "alarm": ("alarm",), "students": ("za-studente",), "bills_included": ("ukljucen-trosak-rezija",), "pets": ("kucni-ljubimci",),
    "pool": ("bazen",), "new_build": ("novogradnja",), "recently_renovated": ("nedavno-adaptiran",),
}
#: Fixed texts that are searched in, and spellings that are one value.
SEARCHES = {"address": ("adresa",), "agent_license": ("ime-i-broj-licence-agenta",), "agency_contract": ("broj-posrednickog-ugovora",)}
HEATINGS, CONDITIONS, FURNISHINGS = {"Drugo": "Ostalo"}, {"Renovirana": "Renoviran"}, {"true": "Namješten", "false": "Nenamješten"}
EVENT_OWN = ("deal", "property_type", "neighborhood", "rooms", "sqm")


def attribute(*codes: str) -> Column:
    return X.attribute("characteristics", *codes)


def flat(name: str) -> Column:
    return F.col("extra")[name]


def either(typed: str, *codes: str) -> Column:
    """A typed column, else the attribute."""
    return F.coalesce(F.col(typed).cast("string"), attribute(*codes))


def bam(value: Column) -> Column:
    return F.when(F.col("currency") == "BAM", value)


def furnishing() -> Column:
    return F.coalesce(attribute("opremljenost", "namjesten", "namjestena"), flat("furnished"))


def rate_of() -> Column:
    return F.col("price") / F.nullif(F.col("sqm"), F.lit(0.0))


def respelled(spellings: dict[str, str]) -> Callable[[Column], Column]:
    return lambda c: X.text_value(X.renamed(c, spellings))


#: What each control reads and the value of it that it compares with its setting; fixed codes of the source. Money counts
#: in one currency only.
SELECTS = {
    "deal": (lambda: F.col("deal"), X.text_value), "property_type": (lambda: F.col("kind"), X.text_value), "neighborhood": (lambda: F.col("area_key"), X.text_value), "rooms": (lambda: F.col("rooms"), X.text_value),
    "seller_type": (lambda: F.col("seller"), X.text_value),
    "floor_num": (lambda: either("floor_num", "sprat"), X.text_value),
    "elevator": (lambda: either("elevator", "lift"), X.boolean_value),
    "heating": (lambda: F.coalesce(flat("heating"), attribute("vrsta-grijanja", "grijanje")), respelled(HEATINGS)),
    "condition": (lambda: either("condition", "stanje"), respelled(CONDITIONS)),
    "parking": (lambda: either("parking", "parking"), X.boolean_value),
    "furnished": (furnishing, respelled(FURNISHINGS)),
    "garage": (lambda: F.coalesce(flat("garage"), attribute("gara-a", "garaza")), X.boolean_value),
    "orientation": (lambda: F.coalesce(flat("orientation"), attribute("primarna-orjentacija")), X.text_value),
    "flooring": (lambda: attribute("vrsta-poda"), X.text_value),
}
RANGES = {
    **{name: (of, lambda c: c) for name, of in {"price_bam": lambda: bam(F.col("price")), "ppm2_bam": lambda: bam(rate_of()), "sqm": lambda: F.col("sqm"), "year_built": lambda: F.col("year_built")}.items()},
    "bathrooms": (lambda: F.coalesce(flat("bathrooms"), attribute("broj-kupatila", "broj-kupatil")), X.numeric_value),
    "floors_total": (lambda: F.coalesce(flat("floors_total"), attribute("broj-spratova", "ukupno-spratova")), X.numeric_value),
    "unit_levels": (lambda: F.coalesce(flat("unit_levels"), attribute("broj-etaza")), X.numeric_value),
    "plot_sqm": (lambda: F.coalesce(flat("plot_sqm"), attribute("okucnica-kvadratura")), X.numeric_value),
    "balcony_sqm": (lambda: attribute("kvadratura-balkona"), X.numeric_value), "views": (lambda: flat("views"), X.numeric_value), "favorites": (lambda: flat("favorites"), X.numeric_value),
}
CONTROLS = (*SELECTS, *RANGES, *AMENITIES, *SEARCHES)


def control_parts(name: str) -> tuple[Column, Callable[[Column], Column]]:
    """What a control reads, and how its value comes of that."""
    if name in AMENITIES:
        return attribute(*AMENITIES[name]), X.boolean_value
    if name in SEARCHES:
        return attribute(*SEARCHES[name]), X.folded
    read, value = SELECTS.get(name) or RANGES[name]
    return read(), value


def control(name: str) -> Column:
    """What a control compares with its setting."""
    read, value = control_parts(name)
    return value(read)


def control_counts(df: DataFrame, controls: Iterable[str], text: Callable[[Column], Column] = lambda value: value) -> DataFrame:
    """(control, value, n): rows by control and value, in one pass; text makes the result's text of a value's text.

    What the controls read is counted first, as texts, and only the different ones are turned into values."""
    parts = {c: control_parts(c) for c in controls}
    read = df.select(*(of.cast("string").alias(c) for c, (of, _) in parts.items()))
    given = read.select(F.posexplode(F.array(*parts)).alias("k", "given")).groupBy("k", "given").agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*(F.lit(c) for c in parts))
    value = F.coalesce(*(F.when(F.col("k") == k, of(F.col("given")).cast("string")) for k, (_, of) in enumerate(parts.values())))
    valued = given.select(F.get(names, "k").alias("control"), value.alias("value"), "n").select("control", text(F.col("value")).alias("value"), "n")
    return valued.groupBy("control", "value").agg(F.sum("n").alias("n"))


def setting_test(name: str, value, event: bool = False) -> Column | None:
    """The test that one setting makes, or None while it is unset."""
    values = value if isinstance(value, (list, tuple)) else [value]
    if not values or values[0] in (None, "", ALL) or (isinstance(values[0], str) and not values[0].strip()):
        return None
    base = name.removesuffix("_min").removesuffix("_max")
    if base != name and base in RANGES:
        c = {"price_bam": F.col("price"), "ppm2_bam": rate_of()}[base] if event and base in ("price_bam", "ppm2_bam") else control(base)
        return c >= float(values[0]) if name.endswith("_min") else c <= float(values[0])
    if name in SEARCHES:
        return X.contains_folded(attribute(*SEARCHES[name]), values[0])
    return control(name).isin(list(values))


def property_filters(df: DataFrame, chosen: dict) -> DataFrame:
    """Settings by control: a list for selects and amenities, NAME_min and NAME_max for ranges, a text for searches."""
    tests = [t for t in (setting_test(*c) for c in chosen.items()) if t is not None]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def cross_test(column: str, op: str, value) -> Column:
    """One chart predicate; IN knows null."""
    c = F.col(column)
    if op in ("IN", "NOT IN"):
        known = [v for v in value if v is not None]
        inside = c.isin(known) if known else F.lit(False)
        if None in value:
            inside = F.coalesce(inside, F.lit(False)) | c.isNull()
        return inside if op == "IN" else ~inside
    if op == "LIKE":
        return c.like(value)
    if op in ("IS NULL", "IS NOT NULL"):
        return c.isNull() if op == "IS NULL" else c.isNotNull()
    return {"=": c == value, "<>": c != value, "<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value}[op]


def cross_filter(df: DataFrame, predicates: list[tuple]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, (cross_test(*p) for p in predicates))) if predicates else df


def filter_populations(populations: dict[str, DataFrame], predicates: list[tuple]) -> dict[str, DataFrame]:
    """The same predicates on all; a dimension that one of them lacks is left out everywhere."""
    shared = set.intersection(*(set(df.columns) for df in populations.values()))
    usable = [p for p in predicates if p[0] in shared]
    return {name: cross_filter(df, usable) for name, df in populations.items()}


def event_property(lifecycle: DataFrame, entities: DataFrame, chosen: dict) -> DataFrame:
    """Filters on events: an event's own deal, type, area, rooms, size and price, whatever its currency; everything else
    through the entity's latest details."""
    base = lambda name: name.removesuffix("_min").removesuffix("_max")
    own = {k: v for k, v in chosen.items() if base(k) in (*EVENT_OWN, "price_bam", "ppm2_bam")}
    tests = [t for t in (setting_test(k, v, True) for k, v in own.items()) if t is not None]
    out = lifecycle.where(reduce(lambda a, b: a & b, tests)) if tests else lifecycle
    other = {k: v for k, v in chosen.items() if k not in own and setting_test(k, v) is not None}
    return out.join(property_filters(entities, other).select("entity_id"), "entity_id", "left_semi") if other else out


def option_lists(df: DataFrame, controls: Iterable[str] = (*SELECTS, *AMENITIES)) -> DataFrame:
    """(control, value): distinct values of every select, in one pass."""
    return control_counts(df, controls).select("control", "value")


def option_order(column: str = "value") -> list[Column]:
    """1, 2, 10, then texts, Unknown last."""
    c = F.col(column)
    return [F.lower(c).isin("unknown"), F.regexp_extract(c, r"^(\d+)", 1).try_cast("long").asc_nulls_last(), c.asc()]


#: Fixed form of a link to an item.
LISTING_LINK = r"(?i)^https?://(?:www\.)?olx\.ba/artikal/(\d{1,12})(?:[/?#]\S*)?$"


def listing_reference(text: Column | str, strict: bool = False) -> Column:
    """Id of a bare number of at most 12 digits or of an item's link; null for an empty text. Anything else is null, or
    an error if strict."""
    s = X.trimmed(text)
    found = F.coalesce(F.nullif(F.regexp_extract(s, r"^(\d{1,12})$", 1), F.lit("")), F.nullif(F.regexp_extract(s, LISTING_LINK, 1), F.lit(""))).try_cast("long")
    return F.when(found.isNull() & (s != ""), F.raise_error(F.lit("Expected a listing link or id")).cast("long")).otherwise(found) if strict else found


def search_rows(df: DataFrame, text: str) -> DataFrame:
    """Rows of which any column contains the text, whatever the case."""
    return df.where(reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower())), F.lit(False)) for c in df.columns)))


def sort_rows(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """By number where the text is one, then by text; nulls last."""
    n, c = F.col(column).cast("string").try_cast("double"), F.col(column)
    return df.orderBy(*(x.desc_nulls_last() if descending else x.asc_nulls_last() for x in (n, c)))


@dataclass(frozen=True)
class Selection:
    """A board's filters."""

    category: tuple = (ALL,)
    rooms: tuple = (ALL,)
    area: tuple = (ALL,)
    min_sqm: float | None = None
    max_sqm: float | None = None
    deal: str = ALL
    properties: dict = field(default_factory=dict)
    cross: tuple = ()

    def apply(self, df: DataFrame) -> DataFrame:
        """Category, rooms, area and size: both for entities and for events."""
        df = where_multi(df, "kind", self.category)
        df = where_category(where_category(df, "rooms", self.rooms), "area_key", self.area)
        return where_bounds(df, "sqm", self.min_sqm, self.max_sqm)
