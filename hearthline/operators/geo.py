"""Areas: which polygon holds a pin, else the nearest boundary, else what was known.

Polygons become a table of grid cells: of every cell the polygons that meet it, each with the edges in the cell and with
whether it holds the cell's south-east corner. A pin is looked up by its cell and counts crossings on the way to that
corner: east to the cell's border, then south along it. So a pin meets the edges of its own cell only, inner cells need
none, and items are neither multiplied nor grouped. The same row of a cell holds the edges that can be nearest to a pin of
it: those whose distance from the cell's middle does not rule them out, first for the cell and then for each of its parts,
so a pin compares a few edges however many lie round it. One lookup by cell answers both. Spark sends the cell table around
where it is small enough and deals both sides by cell where it is not. No Python and no geometry library.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Degrees of a cell, and into how many parts each way it falls for nearness. Cells begin at an odd offset, so that no round
#: coordinate lies on their borders.
CELL, PARTS, OFFSET = 0.01, 4, 0.0012345678901
METRES = 111_320.0
RING = "array<array<struct<x:double,y:double>>>"
EDGE = ("x0", "y0", "x1", "y1")


def edges(areas: DataFrame) -> DataFrame:
    """areas (name, polygons array of polygons, a polygon an array of rings, the first the outer one) -> edges."""
    polygons = areas.select("name", F.posexplode("polygons").alias("polygon", "rings"))
    rings = polygons.select("name", "polygon", F.explode("rings").alias("ring"))
    nth = F.sequence(F.lit(0), F.size("ring") - 2)
    return rings.where(F.size("ring") >= 2).select("name", "polygon", "ring", F.explode(nth).alias("i")).select("name", "polygon", *(F.get("ring", F.col("i") + k)[c].alias(f"{c}{k}") for k in (0, 1) for c in ("x", "y")))


def cell(x: Column, size: float = CELL) -> Column:
    return F.floor((x - OFFSET) / size).cast("int")


def border(n: Column, size: float = CELL) -> Column:
    """Where cell n begins."""
    return n * size + OFFSET


def span(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(low, high))


def lower(a: str) -> Column:
    return F.least(f"{a}0", f"{a}1")


def upper(a: str) -> Column:
    return F.greatest(f"{a}0", f"{a}1")


def x_at(e, y: Column) -> Column:
    """Where an edge that is not level crosses a latitude."""
    return e["x0"] + (y - e["y0"]) * (e["x1"] - e["x0"]) / (e["y1"] - e["y0"])


def y_at(e, x: Column) -> Column:
    return e["y0"] + (x - e["x0"]) * (e["y1"] - e["y0"]) / (e["x1"] - e["x0"])


def straddles(e, axis: str, at: Column) -> Column:
    return (e[f"{axis}0"] > at) != (e[f"{axis}1"] > at)


def holding_cells(areas: DataFrame) -> DataFrame:
    """(cx, cy, holders: array of (name, odd, edges)): the polygons that meet each cell; odd: they hold its south-east
    corner."""
    e, key = edges(areas), ["name", "polygon"]
    box = e.groupBy(*key).agg(*(f(c).alias(f"{n}_{a}") for a in ("x", "y") for n, f, c in (("lo", F.min, lower(a)), ("hi", F.max, upper(a)))))
    rows = box.withColumn("cy", span(cell(F.col("lo_y")), cell(F.col("hi_y"))))
    mine = {c: F.col(c) for c in EDGE}
    south = e.withColumn("cy", span(cell(lower("y")), cell(upper("y")))).withColumn("_y", border(F.col("cy"))).where(straddles(mine, "y", F.col("_y")))
    south = south.groupBy(*key, "cy").agg(F.collect_list(x_at(mine, F.col("_y"))).alias("xs"))  # a polygon's crossings of one line
    cells = rows.join(south, [*key, "cy"], "left").withColumn("cx", span(cell(F.col("lo_x")), cell(F.col("hi_x"))))
    east = border(F.col("cx") + 1)
    cells = cells.select(*key, "cx", "cy", (F.size(F.filter(F.coalesce("xs", F.array().cast("array<double>")), lambda x: x > east)) % 2 == 1).alias("odd"))
    touched = e.withColumn("cx", span(cell(lower("x")), cell(upper("x")))).withColumn("cy", span(cell(lower("y")), cell(upper("y"))))
    touched = touched.groupBy(*key, "cx", "cy").agg(F.collect_list(F.struct(*EDGE)).alias("edges"))
    met = cells.join(touched, [*key, "cx", "cy"], "left").where("odd or edges is not null")
    return met.groupBy("cx", "cy").agg(F.collect_list(F.struct("name", "odd", F.coalesce("edges", F.array().cast(met.schema["edges"].dataType)).alias("edges"))).alias("holders"))


def holds(h: Column, px: Column, py: Column, cx: Column, cy: Column) -> Column:
    """Whether a holder covers a pin of its cell, boundary included."""
    east, south = border(cx + 1), border(cy)

    def crossings(e: Column) -> Column:
        along = straddles(e, "y", py) & (x_at(e, py) > px) & (x_at(e, py) <= east)
        down = straddles(e, "x", east) & (y_at(e, east) > south) & (y_at(e, east) <= py)
        one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
        return one(along) + one(down)

    def on_edge(e: Column) -> Column:
        cross = (e["x1"] - e["x0"]) * (py - e["y0"]) - (e["y1"] - e["y0"]) * (px - e["x0"])
        return (F.abs(cross) < 1e-12) & px.between(F.least(e["x0"], e["x1"]), F.greatest(e["x0"], e["x1"])) & py.between(F.least(e["y0"], e["y1"]), F.greatest(e["y0"], e["y1"]))

    n = F.aggregate(h["edges"], h["odd"].cast("int"), lambda n, e: n + crossings(e))
    return (n % 2 == 1) | F.exists(h["edges"], on_edge)


def placed(pins: DataFrame) -> DataFrame:
    """pins with their cell. Rows without a pin get cells of their own that no area meets, dealt evenly."""
    nowhere = -1_000_000 - F.pmod(F.xxhash64("entity_id"), F.lit(1000)).cast("int")
    known = F.col("longitude").isNotNull() & F.col("latitude").isNotNull()
    return pins.withColumns({"cx": F.when(known, cell(F.col("longitude"))).otherwise(nowhere), "cy": F.when(known, cell(F.col("latitude"))).otherwise(0)})


def covering(pins: DataFrame, areas: DataFrame) -> DataFrame:
    """(entity_id, name) for every area that covers a pin, boundary included, holes counted."""
    met = placed(pins.select("entity_id", "longitude", "latitude")).join(holding_cells(areas), ["cx", "cy"])
    found = F.filter("holders", lambda h: holds(h, F.col("longitude"), F.col("latitude"), F.col("cx"), F.col("cy")))
    return met.select("entity_id", F.explode(F.array_distinct(F.transform(found, lambda h: h["name"]))).alias("name"))


def metres_to(e, px: Column, py: Column) -> Column:
    """From a pin to an edge, on a plane round the pin (under 1 % off at 5 km)."""
    k = F.cos(F.radians(py))
    dx, dy, ex, ey = (e["x1"] - e["x0"]) * k, e["y1"] - e["y0"], (px - e["x0"]) * k, py - e["y0"]
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce((ex * dx + ey * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))))
    return METRES * F.sqrt(F.pow(ex - t * dx, 2) + F.pow(ey - t * dy, 2))


def part_of(px: Column, py: Column, cx: Column, cy: Column) -> Column:
    """The part of its cell that a pin lies in."""
    nth = lambda at, n: F.least(F.lit(PARTS - 1), F.greatest(F.lit(0), F.floor((at - border(n)) / (CELL / PARTS)))).cast("int")
    return nth(py, cy) * PARTS + nth(px, cx)


def possible(rows: DataFrame, key: list[str], x: Column, y: Column, size: float, radius: float) -> DataFrame:
    """rows (key and edge) without the edges that cannot be nearest, or not within the radius, for any pin of the square of
    `size` degrees round (x, y). A pin is at most half a diagonal from the middle; five metres more are for the plane's turning."""
    half, slack = 0.5 * size * METRES * 2**0.5, 5.0
    far = rows.withColumn("_d", metres_to({c: F.col(c) for c in EDGE}, x, y))
    least = F.min("_d").over(Window.partitionBy(*key))
    return far.withColumn("_least", least).where((F.col("_d") <= radius + half + slack) & (F.col("_d") <= F.col("_least") + 2 * half + slack)).drop("_d", "_least")


def near_cells(areas: DataFrame, radius: float) -> DataFrame:
    """(cx, cy, near: map of a cell's parts to edges with their names): the edges that can be nearest to a pin there."""
    reach = radius / METRES * 1.6
    spread = lambda a: span(cell(lower(a) - reach), cell(upper(a) + reach))
    rows = edges(areas).select("name", *EDGE).withColumn("cx", spread("x")).withColumn("cy", spread("y"))
    middle = lambda n, at=F.lit(PARTS / 2): border(F.col(n)) + at * (CELL / PARTS)
    rows = possible(rows, ["cx", "cy"], middle("cx"), middle("cy"), CELL, radius).withColumn("part", span(F.lit(0), F.lit(PARTS * PARTS - 1)))
    rows = possible(rows, ["cx", "cy", "part"], middle("cx", F.col("part") % PARTS + 0.5), middle("cy", F.floor(F.col("part") / PARTS) + 0.5), CELL / PARTS, radius)
    lists = rows.groupBy("cx", "cy", "part").agg(F.collect_list(F.struct("name", *EDGE)).alias("edges"))
    return lists.groupBy("cx", "cy").agg(F.map_from_entries(F.collect_list(F.struct("part", "edges"))).alias("near"))


def closest(near: Column, px: Column, py: Column, radius: float) -> Column:
    """struct(metres, name) of the nearest of the edges within the radius, to the millimetre; ties go to the lower name."""
    every = F.transform(near, lambda e: F.struct(F.round(metres_to(e, px, py), 3).alias("metres"), e["name"].alias("name")))
    return F.array_min(F.filter(every, lambda x: x["metres"] <= radius))


def near_pin(radius: float) -> Column:
    x, y = F.col("longitude"), F.col("latitude")
    return closest(F.try_element_at("near", part_of(x, y, F.col("cx"), F.col("cy"))), x, y, radius)


def nearest(pins: DataFrame, areas: DataFrame, radius: float = 5000.0) -> DataFrame:
    """(entity_id, name, metres): the nearest boundary within the radius."""
    met = placed(pins.select("entity_id", "longitude", "latitude")).join(near_cells(areas, radius), ["cx", "cy"])
    return met.select("entity_id", near_pin(radius).alias("b")).where("b is not null").select("entity_id", "b.name", "b.metres")


#: Fixed letters that older spellings of names lack.
MARKED, PLAIN = "čćšžČĆŠŽ", "ccszCCSZ"


def names_of(areas: DataFrame) -> DataFrame:
    """(_spelled, _named): every name and its spelling without marks; the lowest name for each."""
    plain = F.replace(F.translate("name", MARKED, PLAIN), F.lit("đ"), F.lit("dj"))
    return areas.select(F.explode(F.array("name", plain)).alias("_spelled"), F.col("name").alias("_n")).groupBy("_spelled").agg(F.min("_n").alias("_named"))


def assign_area(items: DataFrame, areas: DataFrame, radius: float = 5000.0) -> DataFrame:
    """items (entity_id, latitude, longitude, source_area, area_key): an area's name in the source (also without marks),
    the first covering area by name, the nearest boundary within the radius, or the old key; `how` says which. Only
    items that have no area by then are looked up by nearness."""
    named = items.withColumn("_spelled", F.nullif(F.trim("source_area"), F.lit(""))).join(names_of(areas), "_spelled", "left").drop("_spelled")
    cover = holding_cells(areas).join(near_cells(areas, radius), ["cx", "cy"], "full")
    met = placed(named).join(cover, ["cx", "cy"], "left")
    covers = F.filter("holders", lambda h: holds(h, F.col("longitude"), F.col("latitude"), F.col("cx"), F.col("cy")))
    met = met.withColumn("_inside", F.when(F.col("_named").isNull(), F.array_min(F.transform(covers, lambda h: h["name"]))))
    met = met.withColumn("_near", F.when(F.coalesce("_named", "_inside").isNull(), near_pin(radius)["name"]))
    how = F.when(F.col("_named").isNotNull(), "name").when(F.col("_inside").isNotNull(), "inside").when(F.col("_near").isNotNull(), "near").otherwise("kept")
    out = met.withColumns({"how": how, "area_key": F.coalesce("_named", "_inside", "_near", "area_key")})
    return out.select(*items.columns, "how")


def outline_join(areas: DataFrame, metrics: DataFrame) -> DataFrame:
    """Every area with its metrics, or nulls."""
    return areas.join(metrics, areas["name"] == metrics["area_key"], "left").drop("area_key")


def features(areas: DataFrame) -> DataFrame:
    """GeoJSON features with coordinates of four digits; empty geometries are left out."""
    point = lambda p: F.array(F.round(p["x"], 4), F.round(p["y"], 4))
    shape = F.transform("polygons", lambda rings: F.transform(rings, lambda ring: F.transform(ring, point)))
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), shape.alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("name")).alias("properties"), geometry.alias("geometry"))
    return areas.where(F.size("polygons") > 0).select("name", F.to_json(feature).alias("feature"))


def to_multipolygon(geojson: Column) -> Column:
    """Polygons array of a GeoJSON Polygon or MultiPolygon text."""
    kind = F.get_json_object(geojson, "$.type")
    rings = F.from_json(F.get_json_object(geojson, "$.coordinates"), "array<array<array<double>>>")
    many = F.from_json(F.get_json_object(geojson, "$.coordinates"), "array<array<array<array<double>>>>")
    points = lambda polygons: F.transform(polygons, lambda p: F.transform(p, lambda r: F.transform(r, lambda c: F.struct(c[0].alias("x"), c[1].alias("y")))))
    return F.when(kind == "Polygon", points(F.array(rings))).when(kind == "MultiPolygon", points(many))
