"""Column expressions shared by operators and plans. All are built-in functions: nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(x: ColumnLike, digits: int = 0) -> Column:
    """Half away from zero on decimals, so that binary fractions make no false ties; digits may be negative."""
    return F.round(col(x).cast("decimal(20,6)"), digits).cast("double")


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is named. It has no generated code: for what is rare or
    costly. What a projection names several times is computed once in any case."""
    return F.get(F.transform(F.array(value), use), 0)


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def median(x: ColumnLike, condition: Column | None = None, at: float = 0.5) -> Column:
    """Exact continuous percentile over the rows that meet the condition; nulls are ignored."""
    value = col(x).cast("double")
    return F.percentile(value if condition is None else F.when(condition, value), at)


def share_pct(condition: Column, base: Column | None = None, digits: int = 1) -> Column:
    whole = F.count(F.lit(1)) if base is None else count_if(base)
    return rounded(100.0 * count_if(condition) / F.nullif(whole, F.lit(0)), digits)


def local_date(ts: ColumnLike, zone: str = "Europe/Sarajevo") -> Column:
    return F.to_date(F.from_utc_timestamp(col(ts), zone))


def known(x: ColumnLike) -> Column:
    """unknown is a value of its own in every filter and group."""
    return F.coalesce(col(x), F.lit("unknown"))


# -- attributes ------------------------------------------------------------------------------------------


def attribute(extra: ColumnLike, *codes: str) -> Column:
    """The first attribute among alias codes that is not empty. By [], so that a filter which meets a map that a projection
    makes need not make it."""
    filled = lambda v: F.when(v != "", v)
    return F.coalesce(*(filled(col(extra)[c]) for c in codes))


def text_value(x: ColumnLike) -> Column:
    """Unknown for null, empty and single-letter texts, which are stray input."""
    c = col(x).cast("string")
    return F.when(c.isNull() | c.rlike("^[A-Za-z]?$"), F.lit("Unknown")).otherwise(c)


def renamed(x: ColumnLike, spellings: dict[str, str]) -> Column:
    """Several spellings of a value as one."""
    c = col(x).cast("string")
    return F.coalesce(F.element_at(F.create_map(*(F.lit(w) for pair in spellings.items() for w in pair)), c), c)


def numeric_value(x: ColumnLike) -> Column:
    return F.when(col(x).rlike(r"^-?\d+(\.\d+)?\z"), col(x).try_cast("double"))


#: Fixed words of the source for yes and no.
YES_WORDS, NO_WORDS = ("true", "1", "da", "yes"), ("false", "0", "ne", "no")


def boolean_value(x: ColumnLike) -> Column:
    word = F.lower(col(x).cast("string"))
    return F.when(word.isin(*YES_WORDS), "Yes").when(word.isin(*NO_WORDS), "No").otherwise("Unknown")


#: Fixed letters that lose their marks; đ becomes dj.
FOLD_FROM, FOLD_TO = "čćžš", "cczs"


def folded(x: ColumnLike) -> Column:
    """Lower case without the letters' marks."""
    return F.translate(F.replace(F.lower(col(x).cast("string")), F.lit("đ"), F.lit("dj")), FOLD_FROM, FOLD_TO)


def contains_folded(x: ColumnLike, text: str) -> Column:
    """Substring of the folded text; % and _ mean themselves."""
    return F.contains(folded(x), folded(F.lit(text.strip())))


# -- numbers and prices as texts -----------------------------------------------------------------------------

#: Fixed: white space (also the unbreakable kinds) and units that may stand by a number.
SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
UNITS = rf"(?i){SPACE}|KM|BAM|EUR|USD|€|\$"
#: What a text must be made of to be a number of any form; most texts are told by their first letter.
NUMBER_LIKE = rf"(?i)^(?:[-+.,\d]|{UNITS[4:]})*$"
#: The white space of SPACE as letters.
SPACES = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def locale_number(x: ColumnLike, integer_like: bool = False) -> Column:
    """Number of a text in either convention: 1.234,50 or 1,234.50. Groups after the first must have three digits;
    a single mark is decimal, but with integer_like a single group of three after it is thousands. Else null."""

    def read(s: Column) -> Column:
        bare = lambda t: F.regexp_replace(t, "[.,]", "")
        cases = (
            F.when(s.rlike(r"^[+-]?\d{1,3}(\.\d{3})+,\d+$"), F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
            .when(s.rlike(r"^[+-]?\d{1,3}(,\d{3})+\.\d+$"), F.replace(s, F.lit(","), F.lit("")))
            .when(s.rlike(r"^[+-]?\d{1,3}((,\d{3}){2,}|(\.\d{3}){2,})$"), bare(s))
        )
        if integer_like:
            cases = cases.when(s.rlike(r"^[+-]?\d{1,3}[.,]\d{3}$"), bare(s))
        return cases.when(s.rlike(r"^[+-]?\d*[.,]?\d*$"), F.replace(s, F.lit(","), F.lit("."))).try_cast("double")

    plain = r"^[+-]?\d{1,15}$" if integer_like else r"^[+-]?\d{1,15}(?:\.\d{1,15})?$"  # as most numbers are

    def either(t: Column) -> Column:
        return F.when(t.rlike(plain), t.try_cast("double")).when(t.rlike(NUMBER_LIKE), let(F.regexp_replace(t, UNITS, ""), read))

    return either(col(x).cast("string"))


def trimmed(x: ColumnLike) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(col(x).cast("string"), F.lit(SPACES))


def number(x: ColumnLike, is_text: ColumnLike, integer_like: bool = False) -> Column:
    """locale_number of texts; what came as a number is one already."""
    return F.when(col(is_text), locale_number(x, integer_like)).otherwise(col(x).try_cast("double"))


def plain_number(n: Column) -> Column:
    """A double as a text without an exponent or idle zeros."""
    return F.regexp_replace(n.cast("decimal(30,10)").cast("string"), r"\.?0+$", "")


def plain_text(x: ColumnLike) -> Column:
    """A text, or its plain_number if it is a number."""
    t = col(x)
    return F.when(t.rlike(r"^[1-9]\d{0,14}\z") | ~t.rlike(NUMBER_LIKE), t).otherwise(F.coalesce(plain_number(locale_number(t)), t))


def norm_id(x: ColumnLike) -> Column:
    """A positive whole number up to 2 ** 53 - 1."""
    s = col(x).cast("string")
    n = F.when(s.rlike(r"^\s*\d+\s*$"), s.try_cast("bigint"))  # casts trim
    return F.when((n > 0) & (n <= 2**53 - 1), n)


#: Fixed bounds of an area in square metres.
SQM_MINIMUM, SQM_MAXIMUM = 5, 999_999


def norm_area(x: ColumnLike) -> Column:
    """Square metres within the bounds; groups of three are thousands, so 7.500 is a plot of 7500."""
    s = F.regexp_replace(col(x).cast("string"), SPACE, "")
    n = locale_number(x)
    v = F.when(n.isNotNull() & s.rlike(r"^\d{1,3}([.,]\d{3})+$"), F.regexp_replace(s, "[.,]", "").try_cast("double")).otherwise(n)
    return F.when(v.between(SQM_MINIMUM, SQM_MAXIMUM), v)


#: Fixed: 2100-01-01. Milliseconds are beyond.
UNIX_SECONDS_MAX = 4_102_444_800


def norm_unix_seconds(x: ColumnLike) -> Column:
    """Time of whole seconds up to the year 2100."""
    n = locale_number(x)
    return F.when((n == F.floor(n)) & (n > 0) & (n <= UNIX_SECONDS_MAX), F.timestamp_seconds(n.cast("bigint")))


def num_in(x: ColumnLike, low: float, high: float) -> Column:
    n = locale_number(x)
    return F.when(n.between(low, high), n)


def small_int(x: ColumnLike, low: int, high: int) -> Column:
    """A number rounded half up, within bounds."""
    n = F.floor(locale_number(x) + 0.5).cast("int")
    return F.when(n.between(low, high), n)


def text_max(x: ColumnLike, most: int) -> Column:
    s = trimmed(x)
    return F.when((s != "") & (F.char_length(s) <= most), s)


def bool_text(x: ColumnLike) -> Column:
    s = F.lower(trimmed(x))
    return F.when(s.isin(*YES_WORDS), True).when(s.isin(*NO_WORDS), False)


def furnished_text(x: ColumnLike) -> Column:
    """Yes, no, or null: also for half furnished."""

    s = F.lower(trimmed(x))
    named = F.when(s.contains("namješten") | s.contains("namjesten"), ~s.contains("ne"))
    return F.when(~s.startswith("polu"), F.coalesce(bool_text(s), named))


def rooms_from(x: ColumnLike) -> Column:
    """Studios have "0" rooms; a number in brackets counts, and so does a bare one; a plus stays."""

    s = trimmed(x)
    counted = F.regexp_extract(s, r"\((\d+)\)", 1)
    return F.when(s.rlike("(?i)garsonjera"), "0").when(counted != "", counted).when(s.rlike(r"^\d+\+?$"), s)


#: Fixed kinds by category code of the source; other codes are "other".
PROPERTY_TYPES = {
    23: "apartments", 2668: "daily_rent", 24: "houses", 29: "land", 25: "commercial", 26: "vacation_homes", 30: "garages", 1193: "prefab", 2672: "warehouses", 28: "rooms", 270: "other",
}
DAILY_RENT_CATEGORY = 2668


def property_type(category: ColumnLike) -> Column:
    """Unknown codes are other; a missing or malformed one stays missing."""
    return kind_of(norm_id(category))


def kind_of(code: ColumnLike) -> Column:
    """property_type of a code that is a norm_id already."""
    table = F.create_map(*(F.lit(x) for pair in PROPERTY_TYPES.items() for x in pair))
    return F.when(col(code).isNotNull(), F.coalesce(F.try_element_at(table, col(code).try_cast("int")), F.lit("other")))


#: Fixed words of the source that name a deal; rents are asked first.
RENT_WORDS, SALE_WORDS = "rent|iznajm|najam|izdavanje|iznajmlj", "sell|sale|prodaj|kup|prodaja"


def deal_type(text: ColumnLike) -> Column:
    """rent, sale, or null where neither is named."""
    s = F.lower(col(text).cast("string"))
    return F.when(s.rlike(RENT_WORDS), "rent").when(s.rlike(SALE_WORDS), "sale")


def deal_for(category: ColumnLike, deal: ColumnLike) -> Column:
    """Nightly rents are posted as sales; only their category tells them apart."""
    return F.when(norm_id(category) == DAILY_RENT_CATEGORY, F.lit("daily_rent")).otherwise(col(deal))


#: Fixed signs and words of currencies in texts.
CURRENCY_WORDS = r"(?i)((?<![A-Za-z0-9_])(?:KM|BAM|EUR|USD)(?![A-Za-z0-9_])|[€$])"
CURRENCY_CODES = {"KM": "BAM", "€": "EUR", "$": "USD"}


def currency_of(price: ColumnLike, display: ColumnLike, *fields: ColumnLike) -> Column:
    """The one currency that the fields and texts name; conflict for several, unknown for a malformed field, null
    without any evidence. fields: as texts, whatever they came as."""
    code = lambda c: renamed(F.upper(trimmed(c)), CURRENCY_CODES)
    given = F.filter(F.array(*(F.nullif(col(f).cast("string"), F.lit("")) for f in fields)).cast("array<string>"), lambda f: f.isNotNull())
    named = lambda t: F.coalesce(F.regexp_extract_all(col(t).cast("string"), F.lit(CURRENCY_WORDS), F.lit(1)), F.array().cast("array<string>"))

    def judge(codes: Column, texts: Column) -> Column:
        every = F.array_distinct(F.concat(codes, texts))
        return F.when(F.exists(codes, lambda c: ~c.rlike("^[A-Z]{3}$")), F.lit("unknown")).when(F.size(every) > 1, F.lit("conflict")).otherwise(F.get(every, 0))

    texts = F.coalesce(col(price).cast("string").rlike(CURRENCY_WORDS), F.lit(False)) | F.coalesce(col(display).cast("string").rlike(CURRENCY_WORDS), F.lit(False))
    evidence = F.coalesce(*(col(f).cast("string") for f in fields)).isNotNull() | texts if fields else texts
    return F.when(evidence, judge(F.transform(given, code), F.transform(F.concat(named(price), named(display)), code)))


#: Fixed least prices by deal, and of two kinds that are sold for less.
LEAST_PRICE = {"sale": 3000, "rent": 50, "daily_rent": 10}
LEAST_SALE = {"garages": 1000, "prefab": 500}
#: Fixed texts that stand where a price would.
NO_PRICE_TEXT = r"(?i)^(?:na\s+upit|po\s+dogovoru|dogovor|cijena\s+na\s+upit|call)$"


def least_price(deal: Column, kind: Column) -> Column:
    sale = F.when(kind == "garages", LEAST_SALE["garages"]).when(kind == "prefab", LEAST_SALE["prefab"]).otherwise(LEAST_PRICE["sale"])
    return F.when(deal == "rent", LEAST_PRICE["rent"]).when(deal == "daily_rent", LEAST_PRICE["daily_rent"]).otherwise(sale)


def norm_price(price: ColumnLike, deal: ColumnLike, kind: ColumnLike, display: ColumnLike | None = None, is_text: ColumnLike | None = None) -> Column:
    """struct(price, state, reason). Missing, zero and on-request prices are unpriced; what is no number, negative or
    below its deal's minimum is invalid. A deal that is not known is judged as a sale."""
    text = F.lit(True) if is_text is None else col(is_text)
    shown = F.lit(None).cast("string") if display is None else col(display)

    def judge(n: Column) -> Column:
        return let(F.coalesce(_no_price(n, col(price).cast("string"), text, shown), _bad_price(n, col(deal), col(kind))), lambda why: F.struct(*_judged(n, why)))

    return let(number(price, text, True), judge)


def _no_price(n: Column, raw: Column, text: Column, display: Column) -> Column:
    """Why there is no price at all, or null."""
    asked = (text & trimmed(raw).rlike(NO_PRICE_TEXT)) | F.coalesce(trimmed(display).rlike(NO_PRICE_TEXT), F.lit(False))
    return F.when(raw.isNull() | (text & (trimmed(raw) == "")), "missing").when(~text & (n == 0), "zero").when(asked, "not_priced")


def _bad_price(n: Column, deal: Column, kind: Column) -> Column:
    """Why a number is no price of its deal, or null."""
    below = F.concat(F.lit("below_"), F.when(deal.isin("rent", "daily_rent"), deal).otherwise("sale"), F.lit("_minimum"))
    return F.when(n.isNull(), "not_numeric").when(n == 0, "zero").when(n < 0, "negative").when(n < least_price(deal, kind), below)


def _judged(price: Column, why: Column) -> list[Column]:
    state = F.when(why.isNull(), "valid").when(why.isin("missing", "zero", "not_priced"), "unpriced").otherwise("invalid")
    return [F.when(why.isNull(), price).alias("price"), state.alias("state"), why.alias("reason")]


def bad_rate(rate: Column, area: Column) -> Column:
    """Why a price per square metre makes no total, or null."""
    return F.when(rate.isNull() | (rate <= 0), "not_numeric").when(area.isNull() | (area < SQM_MINIMUM), "per_sqm_without_area")


def total_of(rate: Column, area: Column) -> Column:
    return F.floor(rate * area + 0.5).cast("double")


def total_from_rate(rate: ColumnLike, area: ColumnLike) -> Column:
    """struct(price, state, reason) of a price per square metre."""
    return let(col(rate), lambda n: F.struct(*_judged(total_of(n, col(area)), bad_rate(n, col(area)))))


#: Fixed readings of a sale price below its minimum, by kind; other kinds have none.
LOW_SALE_PRICE_READINGS = {
    "land": "per_sqm", "apartments": "per_sqm_or_rent", "houses": "per_sqm_or_rent", "commercial": "rent", "garages": "rent", "rooms": "rent", "vacation_homes": "rent", "warehouses": "rent",
}
#: Fixed bounds of those readings.
HOME_PER_SQM_MINIMUM, DECLARED_HOME_PER_SQM_MINIMUM, LAND_PER_SQM_MAXIMUM, NIGHTLY_MAXIMUM = 1000, 300, 500, 300
#: Fixed words of titles.
RENT_TITLE, SALE_TITLE = r"(?i)iznajm|izmajm|izdaj|izdavanj|(?<![A-Za-z0-9_])najam|(?<![A-Za-z0-9_])zakup|podstanar", "(?i)prodaj"


def read_price(price: ColumnLike, deal: ColumnLike, kind: ColumnLike, area: ColumnLike, title: ColumnLike | None = None, declared: ColumnLike | None = None, display: ColumnLike | None = None, is_text: ColumnLike | None = None) -> Column:
    """struct(price, state, reason, deal, basis): what a price means for its kind. A "sale" below the minimum may be a
    monthly rent or a price per square metre; a cheap holiday home is let by the night. An item that its details
    declare for sale never becomes a rent. A deal that is not known stays so unless the price tells."""
    text = F.lit(True) if is_text is None else col(is_text)
    sure = F.lit(False) if declared is None else F.coalesce(col(declared), F.lit(False))
    words = F.coalesce(F.lit(None).cast("string") if title is None else col(title), F.lit(""))
    shown = F.lit(None).cast("string") if display is None else col(display)
    posted, kind, area = col(deal), col(kind), col(area)
    sale = F.coalesce(~posted.isin("rent", "daily_rent"), F.lit(True))
    reading = F.try_element_at(F.create_map(*(F.lit(w) for pair in LOW_SALE_PRICE_READINGS.items() for w in pair)), kind)
    least_rate = F.when(sure | words.rlike(SALE_TITLE), DECLARED_HOME_PER_SQM_MINIMUM).otherwise(HOME_PER_SQM_MINIMUM)

    def read(x: Column) -> Column:
        n, none = x["n"], x["none"]
        night = (kind == "vacation_homes") & (n > 0) & (n < NIGHTLY_MAXIMUM) & ~(sure & sale)
        low = none.isNull() & sale & (n > 0) & (n < least_price(F.lit("sale"), kind)) & reading.isNotNull()
        per_sqm = ((reading == "per_sqm") & (n <= LAND_PER_SQM_MAXIMUM)) | ((reading == "per_sqm_or_rent") & (n >= least_rate))
        path = F.when(night, "daily_rent").when(~F.coalesce(low, F.lit(False)), "posted").when(~sure & words.rlike(RENT_TITLE), "rent").when(per_sqm, "per_sqm").when(sure, "posted").otherwise("rent")
        return let(path, lambda path: judge(n, none, path))

    def judge(n: Column, none: Column, path: Column) -> Column:
        found = F.when(path == "per_sqm", "sale").when(path == "posted", posted).otherwise(path)
        why = F.when(path == "per_sqm", bad_rate(n, area)).otherwise(F.coalesce(none, _bad_price(n, found, kind)))
        total = F.when(path == "per_sqm", total_of(n, area)).otherwise(n)
        return let(why, lambda w: F.struct(*_judged(total, w), found.alias("deal"), F.when(path == "per_sqm", "per_sqm").otherwise("total").alias("basis")))

    return let(let(number(price, text, True), lambda n: F.struct(n.alias("n"), _no_price(n, col(price).cast("string"), text, shown).alias("none"))), read)


#: Fixed box of the country.
LAT_RANGE, LON_RANGE = (42.4, 46.4), (15.5, 19.9)


def pin(lat: ColumnLike, lon: ColumnLike) -> Column:
    """struct(latitude, longitude), or null outside the country's box."""
    both = F.struct(col(lat).alias("latitude"), col(lon).alias("longitude"))
    return F.when(col(lat).between(*LAT_RANGE) & col(lon).between(*LON_RANGE), both)


#: Fixed: parameters that come first in a key, and such as are not part of it.
PREFERRED_PARAMETERS, DROPPED_PARAMETERS = ("category_id", "canton", "cities"), ("page", "olx_scrape")


def canonical_url(url: ColumnLike, preferred: tuple[str, ...] = PREFERRED_PARAMETERS, dropped: tuple[str, ...] = DROPPED_PARAMETERS) -> Column:
    """Path and query in one order and one encoding: preferred parameters first, then by name; dropped ones and the
    hash go, repeated ones stay in their order."""
    bare = F.regexp_replace(col(url), "#.*$", "")
    path = F.regexp_replace(F.regexp_replace(bare, r"(?s)\?.*$", ""), r"^[A-Za-z][\w+.-]*://[^/?]*", "")
    query = F.regexp_extract(bare, r"(?s)\?(.*)$", 1)
    decoded = lambda c: F.coalesce(F.try_url_decode(c), c)
    rank = lambda n: F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(x) for x in preferred)), n), F.lit(0)), F.lit(99))
    given = F.filter(F.split(query, "&"), lambda p: p != "")
    named = F.transform(given, lambda p, i: F.struct(decoded(F.regexp_replace(p, "(?s)=.*$", "")).alias("n"), i.alias("i"), decoded(F.regexp_extract(p, "(?s)=(.*)$", 1)).alias("v")))
    ranked = F.array_sort(F.transform(F.filter(named, lambda p: ~p["n"].isin(*dropped)), lambda p: F.struct(rank(p["n"]).alias("r"), p["n"].alias("n"), p["i"].alias("i"), p["v"].alias("v"))))
    text = F.array_join(F.transform(ranked, lambda p: F.concat(F.url_encode(p["n"]), F.lit("="), F.url_encode(p["v"]))), "&")
    return F.concat(F.when(path == "", F.lit("/")).otherwise(path), F.when(text != "", F.concat(F.lit("?"), text)).otherwise(F.lit("")))
