"""Normalisation of payloads as one Spark job of Column expressions; rejected rows keep their reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..sources import payloads as P

#: Fixed names of the source: labels of cards, a text for unpriced items, the address of an item, kinds of sellers.
SQM_LABEL, ROOMS_LABEL, UNPRICED_TEXT, ITEM_URL, SELLERS = "Kvadrata", "Broj Soba", "Na upit", "https://olx.ba/artikal/", ("shop", "private")

#: Fixed attribute codes of the source, with what a typed column makes of their text. Of several codes of a column the
#: last one in an item's list counts.
ATTRIBUTES = {
    "rooms_detail": (("broj-soba",), lambda v: X.text_max(v, 40)),
    "bathrooms": (("broj-kupatila", "broj-kupatil"), lambda v: X.small_int(v, 0, 50)),
    "unit_levels": (("broj-etaza",), lambda v: X.small_int(v, 1, 50)),
    "floor_num": (("sprat",), lambda v: X.small_int(v, -5, 200)),
    "floors_total": (("ukupno-spratova", "broj-spratova"), lambda v: X.small_int(v, 1, 200)),
    "heating": (("grijanje", "vrsta-grijanja"), lambda v: X.text_max(v, 60)),
    "condition": (("stanje",), lambda v: X.text_max(v, 60)),
    "parking": (("parking",), X.bool_text),
    "garage": (("garaza", "gara-a"), X.bool_text),
    "elevator": (("lift",), X.bool_text),
    "year_built": (("godina-izgradnje",), lambda v: X.small_int(v, 1800, 2100)),
    "plot_sqm": (("okucnica-kvadratura",), lambda v: X.num_in(v, 1, 1_000_000)),
    "orientation": (("primarna-orjentacija",), lambda v: X.text_max(v, 40)),
}
FURNISHED_DETAIL, FURNISHED_FLAGS = "opremljenost", ("namjesten", "namjestena")
AREA_CODES, ROOMS_CODE, DECLARED_CODE = ("kvadrata", "kvadratura"), "broj-soba", "vrsta-oglasa"


PLACE = "lat:string,lon:string"
#: A card's fields as texts, whatever they came as; those of which it matters whether they came as a text stay variants.
ITEM = f"struct<id:string,title:variant,category_id:string,listing_type:string,price:variant,display_price:variant,currency:string,price_currency:string,currency_code:string,user_type:string,status:variant,date:string,special_labels:array<struct<label:string,value:string>>,location:struct<{PLACE},location:struct<{PLACE}>>>"


def read_items(items: DataFrame) -> DataFrame:
    """items with `_s`, the fields of `item` (a variant, which goes) in one reading, null if it is no object; `_title` is null
    unless it came as a text."""
    return P.read_once(items, "item", ITEM).withColumn("_title", X.trimmed(P.text_of(F.col("_s")["title"])))


def labelled(labels: Column, name: str) -> Column:
    """The text of the first value with this label."""
    return F.get(F.filter(labels, lambda x: x["label"] == name), 0)["value"]


def pin_of(place: Column) -> Column:
    """struct(latitude, longitude): a place may hold its point directly or under location."""
    at = lambda c: X.locale_number(F.when(place["location"].isNotNull(), place["location"][c]).otherwise(place[c]))
    return X.pin(at("lat"), at("lon"))


def one_of(value: Column, known: tuple[str, ...]) -> Column:
    return F.when(value.isin(*known), value)


CURRENCY_FIELDS = ("currency", "price_currency", "currency_code")


def currency(item: Column) -> Column:
    return X.currency_of(P.text_field(item, "price"), P.text_field(item, "display_price"), *(P.field(item, f) for f in CURRENCY_FIELDS))


def price_columns(rows: DataFrame, deal: Column, declared: Column) -> DataFrame:
    """Adds what is read from an item's price: rows with `kind`, `sqm`, `title`, and _price, _text (it came as a text), _display
    and currency, which go but for the last."""
    shown = X.trimmed(F.coalesce("_display", F.lit("")))
    rows = rows.withColumns({"_deal": deal, "_declared": declared, "_shown": shown})
    rows = rows.withColumn("_read", X.read_price("_price", "_deal", "kind", "sqm", "title", "_declared", "_shown", "_text"))
    price_text = F.when(F.col("_shown") != "", F.col("_shown")).when(F.col("_read.state") == "unpriced", UNPRICED_TEXT).otherwise(F.coalesce("_price", F.lit("")))
    made = {"deal": "_read.deal", "price": "_read.price", "price_state": "_read.state", "price_reason": "_read.reason", "price_basis": "_read.basis"}
    return rows.withColumns({k: F.col(v) for k, v in made.items()} | {"price_text": price_text}).drop("_deal", "_declared", "_shown", "_display", "_price", "_text", "_read")


def rejection() -> Column:
    """Why an item (read_items) is no card, or null. An expression cannot fail on a row, so no item is lost to an exception."""
    short = F.coalesce(F.char_length("_title"), F.lit(0)) <= 2
    return F.when(F.col("_s").isNull(), "not_an_object").when(X.norm_id("_s.id").isNull(), "invalid_id").when(short, "invalid_title")


CARD = (
    "entity_id", "title", "url", "kind", "category_id", "sqm", "rooms", "deal", "price", "price_text", "price_state", "price_reason", "price_basis", "currency", "latitude", "longitude",
    "renewed_at", "seller", "source_status",
)


def normalize_search_items(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of rows with an `item` (a variant)."""
    s, keep = F.col("_s"), [c for c in items.columns if c != "item"]
    marked = read_items(items).withColumn("reason", rejection())
    rows = marked.where("reason is null").withColumns({
        "entity_id": X.norm_id(s["id"]), "title": F.col("_title"), "category_id": X.norm_id(s["category_id"]),
        "sqm": X.norm_area(labelled(s["special_labels"], SQM_LABEL)), "_rooms": labelled(s["special_labels"], ROOMS_LABEL), "_pin": pin_of(s["location"]),
        "renewed_at": X.norm_unix_seconds(s["date"]), "seller": one_of(s["user_type"], SELLERS), "source_status": P.text_of(s["status"]),
        "_price": P.any_text(s["price"]), "_text": P.is_text(s["price"]), "_display": P.text_of(s["display_price"]),
    })
    rows = rows.withColumns({
        "kind": X.kind_of("category_id"), "currency": X.currency_of(F.when(F.col("_text"), F.col("_price")), "_display", *(s[f] for f in CURRENCY_FIELDS)),
        "url": F.concat(F.lit(ITEM_URL), F.col("entity_id").cast("string")), "latitude": F.col("_pin.latitude"), "longitude": F.col("_pin.longitude"),
        "rooms": F.when(F.col("title").rlike("(?i)garsonjera"), "0").otherwise(X.rooms_from("_rooms")),
    })
    rows = price_columns(rows, X.deal_for("category_id", X.deal_type(s["listing_type"])), F.lit(False))
    return rows.select(*keep, *CARD), marked.where("reason is not null").select(*keep, "reason")


#: An attribute's fields as texts.
CODED = "struct<attr_code:string,value:string>"


def attribute_entries(attributes: Column) -> Column:
    """entries_of of an array of variants."""
    return entries_of(F.transform(attributes, lambda a: F.try_variant_get(a, "$", CODED)))


def entries_of(attributes: Column) -> Column:
    """array<struct<code, value>> of an array<CODED>: the first value of each code that is not empty, in the order of the list."""
    named = F.transform(attributes, lambda a: F.struct(a["attr_code"].alias("code"), X.trimmed(a["value"]).alias("value")))
    every = F.filter(named, lambda e: (e["code"] != "") & (e["value"] != ""))

    def first(entries: Column) -> Column:  # the codes are listed once, not for every entry
        return X.let(entries["code"], lambda codes: F.filter(entries, lambda e, k: F.array_position(codes, e["code"]) == k + 1))

    return X.let(every, first)


def by_place(attributes: Column, found: dict[str, Column], last: bool = False) -> Column:
    """Of what was found for codes, what is not null and stands first (or last) in the map of attributes."""
    if len(found) == 1:
        return next(iter(found.values()))
    at = (F.when(v.isNotNull(), F.struct(F.array_position(F.map_keys(attributes), F.lit(c)).alias("place"), v.alias("value"))) for c, v in found.items())
    return (F.greatest if last else F.least)(*at)["value"]


def value_of(attributes: Column, *codes: str, last: bool = False) -> Column:
    return by_place(attributes, {c: attributes[c] for c in codes}, last)


def attributes_to_columns(df: DataFrame, entries: str = "entries") -> DataFrame:
    """Typed columns of the known codes; all codes stay in `characteristics`, numbers in plain form. A detailed
    furnishing text goes before a yes or no. The entries become a map once, and every code is one look into it."""
    a = F.col("_by_code")
    detail = value_of(a, FURNISHED_DETAIL)
    flags = by_place(a, {c: X.bool_text(a[c]) for c in FURNISHED_FLAGS})
    typed = {name: rule(value_of(a, *codes, last=True)) for name, (codes, rule) in ATTRIBUTES.items()}
    return df.withColumn("_by_code", F.map_from_entries(entries)).withColumns(typed | {
        "characteristics": F.transform_values(a, lambda _, v: X.plain_text(v)), "furnished": F.when(detail.isNotNull(), X.furnished_text(detail)).otherwise(flags),
        "sqm": X.norm_area(value_of(a, *AREA_CODES)), "rooms": X.rooms_from(value_of(a, ROOMS_CODE)), "declared": X.deal_type(value_of(a, DECLARED_CODE)),
    }).drop("_by_code")


REPORT = "struct<at:string,price:string,is_text:boolean,currency:string>"


def reports_of(detail: Column) -> Column:
    """array<REPORT> of a payload's price history; null where it is no array (also none in a text)."""
    return reports_in(P.field(detail, "price_history", "variant"))


def reports_in(history: Column) -> Column:
    """reports_of, of the price history itself."""
    given = F.coalesce(F.try_variant_get(history, "$", "array<variant>"), F.try_variant_get(F.try_parse_json(P.text_of(history)), "$", "array<variant>"))
    at = lambda r: F.coalesce(P.field(r, "created_at"), P.field(r, "date"))
    return F.transform(given, lambda r: F.struct(at(r).alias("at"), P.field(r, "price").alias("price"), P.is_text(P.field(r, "price", "variant")).alias("is_text"), currency(r).alias("currency")))


def normalize_history(details: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) reports of details (entity_id, deal, kind, price_basis, sqm, reports array<REPORT>).

    Accepted: (entity_id, place, reported_at, price, currency), place in the order of time, then price. A report is read
    like the present price: as a total of the same deal, or per square metre. Rejected: (entity_id, place, reason),
    place in the payload; of reports equal in time, price and currency the first stays."""
    each = details.select("entity_id", "deal", "kind", "price_basis", "sqm", F.posexplode("reports").alias("place", "r"))
    rate = X.total_from_rate(X.number("r.price", "r.is_text", True), "sqm")
    p = F.when(F.col("price_basis") == "per_sqm", rate).otherwise(X.norm_price("r.price", "deal", "kind", None, "r.is_text"))
    each = each.withColumns({"reported_at": X.norm_unix_seconds("r.at"), "_p": p})
    reason = F.when(F.col("reported_at").isNull(), "invalid_timestamp").when(F.col("reported_at") > F.lit(as_of).cast("timestamp"), "future_timestamp").when(F.col("_p.state") != "valid", F.col("_p.reason"))
    each = each.withColumns({"reason": reason, "price": F.col("_p.price"), "currency": F.col("r.currency")})
    same = Window.partitionBy("entity_id", "reported_at", "price", "currency", F.col("reason").isNull()).orderBy("place")
    judged = each.withColumn("reason", F.coalesce("reason", F.when(F.row_number().over(same) > 1, "duplicate"))).select("entity_id", "place", "reason", "reported_at", "price", "currency")
    order = Window.partitionBy("entity_id").orderBy("reported_at", "price", "place")
    good = judged.where("reason is null").withColumn("place", F.row_number().over(order))
    return good.drop("reason"), judged.where("reason is not null").select("entity_id", "place", "reason")


DETAIL = (
    "entity_id", "title", "kind", "category_id", "deal", "declared", "price", "price_text", "price_state", "price_reason", "price_basis", "currency", "latitude", "longitude", "sqm", "rooms",
    *ATTRIBUTES, "furnished", "characteristics", "views", "favorites", "seller", "source_status", "published_at", "renewed_at", "reports",
)


#: A detail's fields, read as a card's are.
DETAIL_ITEM = f"struct<id:string,title:string,category_id:string,listing_type:string,price:variant,display_price:variant,currency:string,price_currency:string,currency_code:string,user:struct<type:string>,status:variant,views:string,favorites:string,created_at:string,date:string,location:struct<{PLACE},location:struct<{PLACE}>>,attributes:array<{CODED}>,price_history:variant>"


def map_details(details: DataFrame, fallback_id: str | None = None) -> DataFrame:
    """Details (rows with `detail`, a variant) as typed rows; rows that are no object or have no id go. The kind of
    offer that an item's own attributes declare beats its listing type, which follows the category it was posted in."""
    return mapped(details, fallback_id).where("entity_id is not null")


def mapped(details: DataFrame, fallback_id: str | None = None) -> DataFrame:
    """map_details with the rows that it drops, which have no entity_id."""
    s, keep = F.col("_s"), [c for c in details.columns if c != "detail"]
    number = lambda c, most: X.small_int(s[c], 0, most)
    ids = F.coalesce(X.norm_id(s["id"]), *([X.norm_id(fallback_id)] if fallback_id else []))
    rows = P.read_once(details, "detail", DETAIL_ITEM).withColumns({
        "entity_id": F.when(s.isNotNull(), ids), "entries": entries_of(s["attributes"]), "category_id": X.norm_id(s["category_id"]), "title": s["title"], "_pin": pin_of(s["location"]),
        "views": number("views", 100_000_000), "favorites": number("favorites", 1_000_000), "seller": one_of(s["user"]["type"], SELLERS), "source_status": P.text_of(s["status"]),
        "published_at": X.norm_unix_seconds(s["created_at"]), "renewed_at": X.norm_unix_seconds(s["date"]), "reports": reports_in(s["price_history"]),
        "_price": P.any_text(s["price"]), "_text": P.is_text(s["price"]), "_display": P.text_of(s["display_price"]),
    })
    rows = attributes_to_columns(rows).withColumns({
        "kind": X.kind_of("category_id"), "latitude": F.col("_pin.latitude"), "longitude": F.col("_pin.longitude"),
        "currency": X.currency_of(F.when(F.col("_text"), F.col("_price")), "_display", *(s[f] for f in CURRENCY_FIELDS)),
    })
    rows = price_columns(rows, X.deal_for("category_id", F.coalesce("declared", X.deal_type(s["listing_type"]))), F.col("declared").isNotNull())
    return rows.select(*[c for c in keep if c not in DETAIL], *DETAIL)


def replay(archive: DataFrame) -> DataFrame:
    """Archived responses (id, kind, diagnostic, payload of details, source_payload of searches) under the present rules,
    one row each and nothing written: parsed and rejected items and the reasons of a search, the mapped summary of
    a detail; diagnostics have no source."""
    live = lambda kind: F.coalesce(~F.col("diagnostic") & (F.col("kind") == kind), F.lit(False))
    shown = archive.select("id", "kind", "diagnostic")
    summary = lambda rows: rows.withColumn("outcome", F.when(F.col("diagnostic"), "no_source").otherwise("replayed"))
    found = replayed_searches(archive.where(live("search"))).withColumns({"kind": F.lit("search"), "diagnostic": F.lit(False)})
    d = mapped(P.parse_details(archive.where(live("detail")).select("id", "payload"), "payload").drop("payload"))
    read = {"entity_id": "entity_id", "deal": "deal", "property_type": "kind", "price_state": "price_state", "price": "price", "sqm": "sqm"}
    told = d.select("id", F.lit("detail").alias("kind"), F.lit(False).alias("diagnostic"), *(F.when(F.col("entity_id").isNotNull(), F.col(c)).alias(k) for k, c in read.items()), F.when(F.col("entity_id").isNotNull(), F.col("latitude").isNotNull()).alias("has_pin"))
    rest = shown.where(~live("search") & ~live("detail"))
    out = found.unionByName(told, allowMissingColumns=True).unionByName(rest, allowMissingColumns=True)
    return summary(out.select("id", "kind", "diagnostic", "parsed_items", "rejected_items", "rejections", *read, "has_pin"))


def replayed_searches(searches: DataFrame) -> DataFrame:
    """(id, parsed_items, rejected_items, rejections) of archived searches; a page without items is one row without an item."""
    array = lambda c: F.try_variant_get(F.col("_page")[c], "$", "array<variant>")
    pages = searches.select("id", F.from_json("source_payload", P.PAGE).alias("_page")).select("id", F.coalesce(array("data"), array("items")).alias("data"))
    each = pages.select("id", F.col("data").isNull().alias("_none"), F.explode_outer("data").alias("item")).withColumn("_item", F.col("item").isNotNull())
    reason = F.when(F.col("_none"), "data_not_array").when(F.col("_item"), rejection())
    counts = read_items(each).groupBy("id", reason.alias("reason"), "_none").agg(F.count(F.when(F.col("_item"), 1)).alias("n"))
    named = F.when(F.col("_none"), "data_not_array:1").otherwise(F.concat("reason", F.lit(":"), F.col("n").cast("string")))
    total = lambda which: F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0)).cast("long")
    good = F.col("reason").isNull()
    return counts.groupBy("id").agg(
        total(good).alias("parsed_items"), total(~good).alias("rejected_items"),
        F.when((F.sum("n") > 0) | F.max("_none"), F.array_join(F.array_sort(F.collect_list(named)), ",")).alias("rejections"),  # a handful of reasons
    )
