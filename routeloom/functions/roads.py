"""Scalar functions of roads, measurements and the formats they come in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model: seconds, metres per second.
MIN_EDGE_WEIGHT = 0.0
FREE_FLOW_FACTOR = 1.0
DEFAULT_SPEED = 13.9
MAX_TRAVEL_TIME = 100_000.0
#: Vehicles per hour and lane by road class: (speed up to, capacity), the last without bound.
LANE_CAPACITY = {
    1: ((None, 2000.0),),
    2: ((11.0, 1333.33), (16.0, 1500.0), (None, 2000.0)),
    3: ((11.0, 800.0), (13.0, 875.0), (16.0, 1500.0), (None, 1800.0)),
    4: ((5.0, 200.0), (7.0, 412.5), (9.0, 600.0), (11.0, 800.0), (13.0, 1125.0), (16.0, 1583.0), (18.0, 1100.0), (22.0, 1200.0), (26.0, 1300.0), (None, 1400.0)),
}


def speed_or_default(speed: Column) -> Column:
    return F.coalesce(speed, F.lit(DEFAULT_SPEED))


def length_or_distance(length: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.coalesce(length, F.hypot(x2 - x1, y2 - y1))


def weight_ms(length: Column, speed: Column) -> Column:
    """Free-flow travel time in whole milliseconds, cut, not rounded."""
    return (F.greatest(length / (speed * FREE_FLOW_FACTOR), F.lit(MIN_EDGE_WEIGHT)) * 1000).cast("bigint")


def _steps(steps, speed: Column) -> Column:
    out = F.lit(steps[-1][1])
    for limit, capacity in reversed(steps[:-1]):
        out = F.when(speed <= limit, capacity).otherwise(out)
    return out


def capacity(lanes: Column, priority: Column, speed: Column, given: Column | None = None) -> Column:
    """Vehicles per hour: none without lanes, the given number, or lanes times a table's step.

    ``given`` is the text of the edge's own parameter; it counts if it is a number.
    """
    road, v = F.coalesce(-priority, F.lit(-1)), speed_or_default(speed)
    per_lane = F.when(road.isin(0, 1), _steps(LANE_CAPACITY[1], v)).when(road == 2, _steps(LANE_CAPACITY[2], v)).when(road == 3, _steps(LANE_CAPACITY[3], v)).otherwise(_steps(LANE_CAPACITY[4], v))
    table = F.coalesce(lanes.cast("double"), F.lit(1.0)) * per_lane
    own = F.lit(None).cast("double") if given is None else given.try_cast("double")
    return F.when(lanes == 0, 0.0).otherwise(F.coalesce(own, table))


def lane_density(sampled: Column, overlap: Column, period: Column, length: Column, lanes: Column) -> Column:
    """Vehicles per kilometre and lane over an interval of ``period`` seconds."""
    none = sampled.isNull() | overlap.isNull() | (sampled == 0) | (length == 0)
    return F.when(none, 0.0).otherwise(1000.0 * sampled / (period * length) / lanes)


def modified_lee(density: Column, free_flow: Column, jam: Column, a: Column, e: Column, theta: Column) -> Column:
    """Speed at a density: free_flow * (1 - d^a) / (1 + e * d^theta), d = density / jam."""
    d = density / jam
    return free_flow * (1 - F.pow(d, a)) / (1 + e * F.pow(d, theta))


def estimated_travel_time(length: Column, speed_kmh: Column) -> Column:
    """Seconds at a speed, with the largest value for a standstill or negative speed."""
    t = length / (speed_kmh / 3.6)
    stuck = (F.abs(speed_kmh) < 1e-6) | (speed_kmh < 0)
    return F.when(stuck | (t > MAX_TRAVEL_TIME), MAX_TRAVEL_TIME).otherwise(t)


def live_travel_time(distance: Column, speed: Column) -> Column:
    """Milliseconds for metres at whole km/h, rounded down; null at speed 0."""
    return F.when(speed > 0, F.call_function("div", (distance * 3600).cast("bigint"), speed.cast("bigint")))


def category_speed(category: Column, limit: Column, speeds: dict[int, float]) -> Column:
    """Metres per second: the category's speed, or the limit (km/h, 999 where unknown) if lower."""
    table = F.create_map(*[F.lit(x) for kv in speeds.items() for x in kv])
    return F.least(F.try_element_at(table, category), F.coalesce(limit, F.lit(999)) / 3.6)


def seconds_of(clock: Column) -> Column:
    """HH:MM:SS, hours beyond 23 allowed, as seconds."""
    p = F.split(clock, ":")
    return F.when(clock.rlike(r"^\d+:\d{1,2}:\d{1,2}(\.\d+)?$"), p[0].cast("double") * 3600 + p[1].cast("double") * 60 + p[2].cast("double"))


def duration_ns(text: Column) -> Column:
    """A number of nanoseconds, or H:MM:SS with microseconds, as nanoseconds."""
    micro = F.round(seconds_of(text) * 1_000_000).cast("bigint")
    return F.when(text.rlike(r"^\d+$"), text.cast("bigint")).otherwise(micro * 1000)


def located_edge(text: Column) -> Column:
    """The edge of a place written ``(lat,lon: edge, position)``."""
    edge = F.regexp_extract(text, r"^\(\s*[^,]+,[^:]+:\s*([^,]+?)\s*,[^)]*\)$", 1)
    return F.when(edge != "", edge)


def node_of_expanded(node: Column) -> Column:
    """The node of an internal id ``node"edge``."""
    return F.split_part(node, F.lit('"'), F.lit(1))


def connection_id(a: Column, b: Column) -> Column:
    return F.concat(a, F.lit("$$"), b)


def route_file(prefix: Column, iteration: Column) -> Column:
    return F.concat(prefix, F.lit("_"), F.lpad(iteration.cast("string"), 3, "0"), F.lit(".rou.xml"))


def breakpoints(begin: Column, end: Column, interval: Column) -> Column:
    """Interval starts in [begin, end); none if both are equal. Defaults: the whole day at once."""
    b, e = F.coalesce(begin, F.lit(0)), F.coalesce(end, F.lit(86400))
    step = F.coalesce(interval, e - b)
    return F.when(b < e, F.sequence(b, e - 1, F.greatest(step, F.lit(1)))).otherwise(F.array().cast("array<int>"))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of 6 371 008.8 m; within 0.6 % of the ellipsoid's."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6_371_008.8 * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def crossing(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, dx: Column, dy: Column) -> Column:
    """The point (x, y) where the segments ab and cd meet; null if they don't, or are parallel."""
    det = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
    u = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / F.nullif(det, F.lit(0.0))
    v = ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / F.nullif(det, F.lit(0.0))
    meet = (F.abs(det) > 1e-9) & u.between(0, 1) & v.between(0, 1)
    return F.when(meet, F.struct((ax + u * (bx - ax)).alias("x"), (ay + u * (by - ay)).alias("y")))


def counter_clockwise(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    return (bx - ax) * (cy - ay) - (cx - ax) * (by - ay) > 1e-9
