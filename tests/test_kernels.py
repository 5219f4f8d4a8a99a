import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from routeloom.functions import kernels
from routeloom.streaming import link_speed


@st.composite
def functions(draw, period=1000):
    n = draw(st.integers(0, 8))
    at = sorted(draw(st.sets(st.integers(1, period - 1), min_size=n, max_size=n)))
    at = np.array([0, *at, period], float)
    val = np.array([draw(st.integers(1, 400)) for _ in at], float)
    val[-1] = val[0]
    for _ in range(2):  # first-in-first-out, around the period
        for k in range(len(at) - 2, -1, -1):
            val[k] = min(val[k], at[k + 1] + val[k + 1] - at[k])
        val[-1] = val[0]
    return at, val


TIMES = np.linspace(0, 999.9, 173)


@settings(max_examples=150, deadline=None)
@given(functions(), functions())
def test_link_and_merge(f, g):
    a = kernels.value(f, TIMES, 1000)
    h = kernels.link(f, g, 1000)
    assert np.allclose(kernels.value(h, TIMES, 1000), a + kernels.value(g, TIMES + a, 1000), atol=1e-6)
    m, switches = kernels.merge(f, g, 1000)
    assert np.allclose(kernels.value(m, TIMES, 1000), np.minimum(a, kernels.value(g, TIMES, 1000)), atol=1e-6)
    assert switches[0][0] == 0 and all(x[1] != y[1] for x, y in zip(switches, switches[1:], strict=False))


@settings(max_examples=100, deadline=None)
@given(functions(), st.integers(1, 60))
def test_thin_bounds(f, error):
    t = kernels.thin(f, error)
    assert np.abs(kernels.value(t, TIMES, 1000) - kernels.value(f, TIMES, 1000)).max() <= error + 1e-6
    lo, hi = kernels.bounds(f, error)
    v = kernels.value(f, TIMES, 1000)
    assert (kernels.value(lo, TIMES, 1000) <= v + 1e-6).all() and (kernels.value(hi, TIMES, 1000) >= v - 1e-6).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(5, 130), min_size=2, max_size=12), st.integers(10, 60000))
def test_profile(speeds, length):
    starts = [k * 86400 // len(speeds) for k in range(len(speeds))]
    f = kernels.profile_to_ttf(starts, speeds, length)
    edges = np.array([*starts, 86400])
    for t in np.linspace(0, 86399, 37):
        clock, left, n = t, float(length), 0
        while left > 1e-9:
            k = int(np.searchsorted(edges, clock % 86400 + 1e-9, side="right")) - 1
            room = edges[k + 1] - clock % 86400
            step = min(room, left / (speeds[k] / 3.6))
            clock, left, n = clock + step, left - step * speeds[k] / 3.6, n + 1
        assert kernels.value(f, np.array([t]))[0] == pytest.approx(clock - t, abs=1e-2)


def test_fit_is_feasible_and_no_worse(spark):
    d = np.linspace(1, 90, 60)
    s = kernels.lee_speed(d, 50.0, np.array([3.0, 1.0, 1.0, 120.0]))
    start = kernels._feasible(np.array([5.5, 5.0, 5.0, 150.0]), 50)
    p = kernels.fit_speed_model(d, s, 50.0)
    loss = lambda q: ((kernels.lee_speed(d, 50.0, q) - s) ** 2).sum()
    assert loss(p) <= loss(start) and 2 * p[1] * p[2] / (p[1] + 1) - p[0] + 1 <= 1e-9
    rows = spark.createDataFrame([(1, float(a), float(b), 50.0) for a, b in zip(d, s, strict=True)], "edge_id int, density double, speed double, free_flow double")
    assert kernels.calibrated(rows, "edge_id").first().sse == pytest.approx(loss(p))


def test_combined(spark):
    f = "array(struct(0.0D AS at, 10.0D AS val), struct(86400.0D AS at, 10.0D AS val))"
    df = spark.range(2).selectExpr("id", f"{f} AS f", f"CASE WHEN id = 0 THEN {f} END AS g")
    got = {r.id: r.h for r in kernels.combined(df, "id", "link").collect()}
    assert got[1] is None and {p.val for p in got[0]} == {20.0}


CASES = [
    ([(1, 10000, 50)], [(100000, 1, 0.1), (101000, 1, 0.9)], [(1, 99875, 0.8, 28.8)]),
    ([(1, 10000, 80), (2, 30000, 80)], [(100000, 1, 0.5), (101000, 2, 0.5)], [(1, 99750, 0.125, 72), (2, 100250, 0.375, 72)]),
    ([(1, 10000, 80), (2, 30000, 80), (3, 10000, 80)], [(100000, 1, 0.5), (102000, 3, 0.5)], [(1, 99750, 0.0625, 72), (2, 100250, 0.75, 72), (3, 101750, 0.0625, 72)]),
    ([(1, 10000, 100), (2, 10000, 50), (3, 10000, 100)], [(100000, 1, 0.0), (101000, 3, 1.0)], [(1, 100000, 1 / 3, 144), (2, 100250, 1 / 3, 72), (3, 100750, 1 / 3, 144)]),
]


@pytest.mark.parametrize("links, traces, want", CASES)
def test_link_speed_cases(links, traces, want):
    got = link_speed.estimate(links, traces)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.allclose([x[2:] for x in got], [x[2:] for x in want], atol=1e-5)


def _events(spark):
    rows = []
    for v, (links, traces, _) in enumerate(CASES):
        seq = 0
        for link in links:
            rows.append((v, seq, "link", link[0], link[1], link[2], None, None))
            seq += 1
            for ts, i, fr in traces:
                if i == link[0]:
                    rows.append((v, seq, "trace", i, None, None, ts, fr))
                    seq += 1
    rows.append((77, 0, "trace", 1, None, None, 5, 0.5))
    return spark.createDataFrame(rows, "vehicle_id bigint, seq int, kind string, link_id bigint, length int, speed_limit int, ts bigint, fraction double")


def test_batch_and_stream(spark, tmp_path):
    events = _events(spark)
    batch = link_speed.link_speeds(events).collect()
    assert len(batch) == sum(len(w) for *_, w in CASES)
    with pytest.raises(link_speed.TraceError):
        link_speed.estimate([], [])
    src = str(tmp_path / "in")
    events.coalesce(1).write.parquet(src)
    stream = link_speed.link_speeds_stream(spark.readStream.schema(events.schema).parquet(src), 10)
    q = stream.writeStream.format("memory").queryName("speeds").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    seen = {(r.vehicle_id, r.link_id, r.link_entered_ts) for r in spark.sql("SELECT * FROM speeds").collect()}
    # Without a timeout the last link of each vehicle is still open.
    assert seen <= {(r.vehicle_id, r.link_id, r.link_entered_ts) for r in batch} and len(seen) >= 4
