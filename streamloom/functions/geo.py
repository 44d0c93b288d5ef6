"""Geography as column expressions, so that filters on it stay in the generated code."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The city's box, the grid and the length of a degree.
LON_EAST, LON_WEST, LAT_NORTH, LAT_SOUTH = -73.7, -74.05, 41.0, 40.5
CELL_LON, CELL_LAT, CELLS_X = 0.0014, 0.00125, 250
DEGREE_KM = 110.25


def _double(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def in_nyc(lon: Column | str, lat: Column | str) -> Column:
    """Inside the box, borders included. A null coordinate gives null; NaN counts as outside."""
    return _double(lon).between(LON_WEST, LON_EAST) & _double(lat).between(LAT_SOUTH, LAT_NORTH)


def _cell_xy(lon: Column | str, lat: Column | str) -> tuple[Column, Column]:
    return F.floor((F.lit(-LON_WEST) - F.abs(_double(lon))) / CELL_LON), F.floor((F.lit(LAT_NORTH) - _double(lat)) / CELL_LAT)


def grid_cell(lon: Column | str, lat: Column | str) -> Column:
    x, y = _cell_xy(lon, lat)
    return (x + y * CELLS_X).cast("int")


def cell_lon(cell: Column | str) -> Column:
    return (-(F.lit(-LON_WEST) - _double(cell) % CELLS_X * CELL_LON - CELL_LON / 2).cast("float")).cast("float")


def cell_lat(cell: Column | str) -> Column:
    cell = F.col(cell) if isinstance(cell, str) else cell
    y = ((cell - cell % CELLS_X) / CELLS_X).cast("double")
    return (F.lit(LAT_NORTH) - y * CELL_LAT - CELL_LAT / 2).cast("float")


def euclid_km(lon1: Column | str, lat1: Column | str, lon2: Column | str, lat2: Column | str) -> Column:
    """Flat distance as the trip streams define it: single-precision differences, degrees given to cos as they are."""
    lon1, lat1, lon2, lat2 = (F.col(c) if isinstance(c, str) else c for c in (lon1, lat1, lon2, lat2))
    dy = (lat1.cast("float") - lat2.cast("float")).cast("double")
    dx = (lon1.cast("float") - lon2.cast("float")).cast("double") * F.cos(_double(lat2))
    return F.sqrt(dy * dy + dx * dx) * DEGREE_KM


def direction_angle(lon1: Column | str, lat1: Column | str, lon2: Column | str, lat2: Column | str) -> Column:
    """Whole degrees from -1 to 359."""
    lon1, lat1, lon2, lat2 = (F.col(c) if isinstance(c, str) else c for c in (lon1, lat1, lon2, lat2))
    x = (lon2.cast("float") - lon1.cast("float")).cast("double") * F.cos(_double(lat1))
    y = (lat2.cast("float") - lat1.cast("float")).cast("double")
    # between equal points the sign of cos alone decides, as with a signed zero
    still = F.when(F.cos(_double(lat1)) < 0, 180).otherwise(0)
    return F.when((x == 0) & (y == 0), still).otherwise(F.degrees(F.atan2(y, x)).cast("int")) + 179


def direction_bucket(angle: Column) -> Column:
    return (angle / 45).cast("int")


def cells_on_way(lon1: Column | str, lat1: Column | str, lon2: Column | str, lat2: Column | str) -> Column:
    """Cells that the line between the centres of two places' cells passes through, from west to east.

    Whole numbers only: of the column i cells east of its start, the line leaves by the height
    ((2i + 1) rows - columns) / (2 columns), and at a corner it goes on in the cell diagonally across.
    """
    (x1, y1), (x2, y2) = _cell_xy(lon1, lat1), _cell_xy(lon2, lat2)
    turned = x1 > x2
    x, y, rows = F.when(turned, x2).otherwise(x1), F.when(turned, y2).otherwise(y1), F.when(turned, y1 - y2).otherwise(y2 - y1)
    line = F.struct(x.alias("x"), y.alias("y"), F.abs(x2 - x1).alias("columns"), F.abs(rows).alias("rows"), F.signum(rows).cast("long").alias("step"))

    def cells(at: Column) -> Column:
        def height(i: Column) -> Column:
            return (2 * i + 1) * at["rows"] - at["columns"]

        def leaves(i: Column) -> Column:
            up = F.ceil(height(i) / (2 * at["columns"])).cast("long")
            return F.when(i == at["columns"], at["rows"]).otherwise(F.greatest(up, F.lit(0).cast("long")))

        def enters(i: Column) -> Column:
            corner = (height(i - 1) >= 0) & (F.pmod(height(i - 1), 2 * at["columns"]) == 0)
            return F.when(i == 0, F.lit(0).cast("long")).otherwise(leaves(i - 1) + corner.cast("long"))

        column = lambda i: F.transform(F.sequence(enters(i), leaves(i)), lambda j: (at["x"] + i + (at["y"] + at["step"] * j) * CELLS_X).cast("int"))
        return F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), at["columns"]), column))

    return F.element_at(F.transform(F.array(line), cells), 1)


def random_nyc_lon(seed: int | None = None) -> Column:
    return (F.lit(LON_WEST) + F.rand(seed) * (LON_EAST - LON_WEST)).cast("float")


def random_nyc_lat(seed: int | None = None) -> Column:
    return (F.lit(LAT_SOUTH) + F.rand(seed) * (LAT_NORTH - LAT_SOUTH)).cast("float")


def register(spark: SparkSession) -> None:
    """SQL functions is_in_nyc, to_cell_id, to_coords and time_diff_ms, expanded by the analyzer."""
    box = f"CAST(lon AS DOUBLE) BETWEEN {LON_WEST}D AND {LON_EAST}D AND CAST(lat AS DOUBLE) BETWEEN {LAT_SOUTH}D AND {LAT_NORTH}D"
    cell = f"CAST(floor(({-LON_WEST}D - abs(CAST(lon AS DOUBLE))) / {CELL_LON}D) + floor(({LAT_NORTH}D - CAST(lat AS DOUBLE)) / {CELL_LAT}D) * {CELLS_X} AS INT)"
    x = f"CAST(-CAST({-LON_WEST}D - (cell % {CELLS_X}) * {CELL_LON}D - {CELL_LON / 2}D AS FLOAT) AS FLOAT)"
    y = f"CAST({LAT_NORTH}D - (cell div {CELLS_X}) * {CELL_LAT}D - {CELL_LAT / 2}D AS FLOAT)"
    for name, arguments, kind, body in (
        ("is_in_nyc", "lon FLOAT, lat FLOAT", "BOOLEAN", box),
        ("to_cell_id", "lon FLOAT, lat FLOAT", "INT", cell),
        ("to_coords", "cell INT", "STRUCT<lon: FLOAT, lat: FLOAT>", f"named_struct('lon', {x}, 'lat', {y})"),
        ("time_diff_ms", "t1 TIMESTAMP, t2 TIMESTAMP", "BIGINT", "unix_millis(t2) - unix_millis(t1)"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
