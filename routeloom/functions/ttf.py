"""Travel-time functions as arrays of structs (at, val), in built-in higher-order functions.

Points are sorted by ``at``; a constant function has one point at 0, any other begins at 0
and ends at the period with the same value. Integer functions interpolate the arrival with
floor division, floating ones the travel time. Null functions or times give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS, DAY_S = 86_400_000, 86_400.0
#: Tolerance of comparisons between floating times, a fixed value.
EPSILON = 1e-6


def feq(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= EPSILON


def flt(a: Column, b: Column) -> Column:
    return (a - b) < -EPSILON


def fleq(a: Column, b: Column) -> Column:
    return (a - b) <= EPSILON


def div(a: Column, b: Column) -> Column:
    """Floor division of integers that aren't negative."""
    return F.call_function("div", a, b)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, computed once: a lambda's variable is not inlined again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def collect(at: str = "at", val: str = "val") -> Column:
    """Aggregate of a group's points to a function."""
    return F.sort_array(F.collect_list(F.struct(F.col(at).alias("at"), F.col(val).alias("val"))))


def _around(f: Column, x: Column, body) -> Column:
    """``body`` of the points before (or at) and after ``x``; null where x is past the end."""
    before = F.try_element_at(F.filter(f, lambda p: p["at"] <= x), F.lit(-1))
    after = F.try_element_at(F.filter(f, lambda p: p["at"] > x), F.lit(1))
    return let(F.struct(before.alias("b"), after.alias("a")), lambda s: body(s["b"], s["a"]))


def eval_ms(f: Column, t: Column, period: int = DAY_MS) -> Column:
    """Integer evaluation: up to two points is constant; a hit is exact; between points the
    arrival is interpolated and rounded down."""

    def at(g: Column, x: Column) -> Column:
        def between(b: Column, a: Column) -> Column:
            rise = (a["at"] + a["val"]) - (b["at"] + b["val"])
            arrival = b["at"] + b["val"] + div((x - b["at"]) * rise, a["at"] - b["at"])
            return F.when(a.isNull() | (b["at"] == x), b["val"]).otherwise(arrival - x)

        return F.when(F.size(g) <= 2, g[0]["val"]).otherwise(_around(g, x, between))

    return let(F.struct(f.alias("f"), F.pmod(t, F.lit(period)).alias("x")), lambda s: at(s["f"], s["x"]))


def eval_s(f: Column, t: Column, period: float = DAY_S) -> Column:
    """Floating evaluation; a point within EPSILON of the time counts as hit."""

    def at(g: Column, x: Column) -> Column:
        def between(b: Column, a: Column) -> Column:
            line = b["val"] + (x - b["at"]) * (a["val"] - b["val"]) / (a["at"] - b["at"])
            return F.when(a.isNull() | feq(b["at"], x), b["val"]).when(feq(a["at"], x), a["val"]).otherwise(line)

        return F.when(F.size(g) <= 1, g[0]["val"]).otherwise(_around(g, x, between))

    return let(F.struct(f.alias("f"), F.pmod(t, F.lit(period)).alias("x")), lambda s: at(s["f"], s["x"]))


def departure_for(f: Column, arrival: Column, period: float = DAY_S) -> Column:
    """Inverse evaluation: the latest departure that arrives at ``arrival`` (first-in-first-out)."""

    def at(g: Column, y: Column) -> Column:
        before = F.try_element_at(F.filter(g, lambda p: p["at"] + p["val"] <= y), F.lit(-1))
        after = F.try_element_at(F.filter(g, lambda p: p["at"] + p["val"] > y), F.lit(1))

        def between(b: Column, a: Column) -> Column:
            b_arr, a_arr = b["at"] + b["val"], a["at"] + a["val"]
            return F.when(a.isNull() | feq(b_arr, y), b["at"]).otherwise(b["at"] + (y - b_arr) * (a["at"] - b["at"]) / (a_arr - b_arr))

        return F.when(F.size(g) <= 1, y - g[0]["val"]).otherwise(let(F.struct(before.alias("b"), after.alias("a")), lambda s: between(s["b"], s["a"])))

    # An arrival before the first one belongs to a departure of the period before.
    first = f[0]["val"]
    shifted = F.when(arrival < first, arrival + period).otherwise(arrival)
    return let(F.struct(f.alias("f"), shifted.alias("y"), (shifted - arrival).alias("d")), lambda s: at(s["f"], s["y"]) - s["d"])


def lower_bound(f: Column) -> Column:
    return F.array_min(F.transform(f, lambda p: p["val"]))


def upper_bound(f: Column) -> Column:
    return F.array_max(F.transform(f, lambda p: p["val"]))


def _bound_in(f: Column, start: Column, end: Column, period: int, fold) -> Column:
    """Bound over [start, end], which may pass the period's end."""

    def part(a: Column, b: Column) -> Column:
        inside = F.transform(F.filter(f, lambda p: (p["at"] >= a) & (p["at"] <= b)), lambda p: p["val"])
        return F.when(a < b, fold(F.concat(inside, F.array(eval_ms(f, a, period), _value_at_end(f, b, period)))))

    wrapped = F.array_compact(F.array(part(start, F.least(end, F.lit(period))), part(F.lit(0), end - period)))
    return F.when(F.size(f) == 1, f[0]["val"]).otherwise(fold(wrapped))


def _value_at_end(f: Column, t: Column, period: int) -> Column:
    return F.when(t == period, F.element_at(f, -1)["val"]).otherwise(eval_ms(f, t, period))


def lower_bound_in(f: Column, start: Column, end: Column, period: int = DAY_MS) -> Column:
    return _bound_in(f, start, end, period, F.array_min)


def upper_bound_in(f: Column, start: Column, end: Column, period: int = DAY_MS) -> Column:
    return _bound_in(f, start, end, period, F.array_max)


def _segments(f: Column) -> Column:
    n = F.size(f)
    return F.zip_with(F.slice(f, 1, n - 1), F.slice(f, 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def average(f: Column, start: Column, end: Column, period: int = DAY_MS) -> Column:
    """Time-weighted mean over a range that may wrap (equal ends: the whole period).

    A segment counts with the mean of its own end values, for as long as it overlaps the
    range; its values are not interpolated at the range's ends.
    """
    stop = F.when(start >= end, end + period).otherwise(end)

    def part(a: Column, b: Column) -> Column:
        overlap = lambda s: F.greatest(F.lit(0), F.least(s["b"]["at"], b) - F.greatest(s["a"]["at"], a))
        return F.aggregate(_segments(f), F.lit(0).cast("bigint"), lambda n, s: n + (s["a"]["val"] + s["b"]["val"]) * overlap(s))

    total = part(start, F.least(stop, F.lit(period))) + part(F.lit(0), stop - period)
    return F.when(F.size(f) == 1, f[0]["val"]).otherwise(div(div(total, F.lit(2)), stop - start))


def slopes(f: Column) -> Column:
    return F.transform(_segments(f), lambda s: (s["b"]["val"] - s["a"]["val"]).cast("double") / (s["b"]["at"] - s["a"]["at"]))


def at_least(f: Column, value: int = 1) -> Column:
    """Travel times below ``value`` raised to it."""
    return F.transform(f, lambda p: F.struct(p["at"].alias("at"), F.greatest(p["val"], F.lit(value).cast("bigint")).alias("val")))


def without_period(f: Column, period: int = DAY_MS) -> Column:
    return F.filter(f, lambda p: p["at"] != period)


def normalised(f: Column, period: int = DAY_MS) -> Column:
    """Points at 0 and at the period added where missing; a constant becomes one point at 0."""
    same = F.size(F.array_distinct(F.transform(f, lambda p: p["val"]))) <= 1
    first = F.array(F.struct(F.lit(0).cast("bigint").alias("at"), f[0]["val"].alias("val")))
    whole = F.filter(f, lambda p: (p["at"] > 0) & (p["at"] < period))
    last = F.array(F.struct(F.lit(period).cast("bigint").alias("at"), f[0]["val"].alias("val")))
    return F.when(same, first).otherwise(F.concat(first, whole, last))


def fifo(f: Column) -> Column:
    """Travel times cut so that nobody overtakes: the least arrival of a point and all later ones."""
    return F.transform(f, lambda p, i: F.struct(p["at"].alias("at"), (F.array_min(F.transform(F.slice(f, i + 1, F.size(f)), lambda q: q["at"] + q["val"])) - p["at"]).alias("val")))


def fifo_up(f: Column) -> Column:
    """Travel times raised so that nobody overtakes: the latest arrival of a point and all before."""
    return F.transform(f, lambda p, i: F.struct(p["at"].alias("at"), (F.array_max(F.transform(F.slice(f, 1, i + 1), lambda q: q["at"] + q["val"])) - p["at"]).alias("val")))


def is_fifo(f: Column) -> Column:
    return F.forall(_segments(f), lambda s: s["a"]["at"] + s["a"]["val"] <= s["b"]["at"] + s["b"]["val"])


def is_valid(f: Column) -> Column:
    """Begins at 0, strictly increasing, first and last value alike, first-in-first-out."""
    rising = F.forall(_segments(f), lambda s: s["a"]["at"] < s["b"]["at"])
    return (f[0]["at"] == 0) & (F.size(f) >= 1) & rising & (f[0]["val"] == F.element_at(f, -1)["val"]) & is_fifo(f)


def crop(f: Column, start: Column, end: Column) -> Column:
    """The function on [start, end] within one period, with interpolated end points."""
    inner = F.filter(f, lambda p: (p["at"] > start + EPSILON) & (p["at"] < end - EPSILON))
    point = lambda t: F.array(F.struct(t.alias("at"), eval_s(f, t).alias("val")))
    return F.concat(point(start), inner, point(end))


def along(functions: Column, departure: Column, period: int = DAY_MS) -> Column:
    """Travel time along a path, given as the array of its edges' functions."""
    return F.aggregate(functions, departure.cast("bigint"), lambda t, f: t + eval_ms(f, t, period)) - departure


def timed_path(functions: Column, departure: Column, period: int = DAY_MS) -> Column:
    """Arrival at every node of a path: departure first, then after each edge."""
    return F.aggregate(functions, F.array(departure.cast("bigint")), lambda ts, f: F.concat(ts, F.array(F.element_at(ts, -1) + eval_ms(f, F.element_at(ts, -1), period))))


def live_optimistic(f: Column, live: Column, soon: Column, t: Column, period: int = DAY_MS) -> Column:
    """Live until ``soon``; then the live value nears the prediction by one second a second."""
    predicted = eval_ms(f, t, period)
    faster_later = F.greatest(F.greatest(live + soon - t, F.lit(0)), predicted)
    slower_later = F.least(live + t - soon, predicted)
    after = F.when(eval_ms(f, soon, period) < live, faster_later).otherwise(slower_later)
    return F.when(live.isNull(), predicted).when(t < soon, live).otherwise(after)


def live_pessimistic(f: Column, live: Column, until: Column, t: Column, period: int = DAY_MS) -> Column:
    """Never below the prediction; before ``until`` the live value, if waiting isn't better."""
    predicted = eval_ms(f, t, period)
    now = F.when(t >= until, predicted).otherwise(F.least(live, eval_ms(f, until, period) + until - t))
    return F.when(live.isNull(), predicted).otherwise(F.greatest(predicted, now))
