"""Edge cases on literal frames: clock changes, nulls, ties, geometry, folds, formats, streams."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from envgrid.functions import codes, geo, scalars
from envgrid.functions.timebuckets import expected_hours, lead_day, report_day
from envgrid.operators import grid, hosts, index, moisture, series, verify, zonal
from envgrid.plans import registry
from envgrid.sources import io, stages
from envgrid.streaming import refresh


def square(x0, y0, n):
    return [[{"x": x0, "y": y0}, {"x": x0, "y": y0 + n}, {"x": x0 + n, "y": y0 + n}, {"x": x0 + n, "y": y0}, {"x": x0, "y": y0}]]


def polys(spark, rows):
    return spark.createDataFrame(rows, f"basin_id int, rings {geo.RINGS}")


def test_clock_changes(spark):
    days = spark.createDataFrame([(dt.date(2024, 3, 10),), (dt.date(2024, 7, 1),), (dt.date(2024, 11, 3),)], "d date")
    assert [r[0] for r in days.select(expected_hours(F.col("d"))).collect()] == [23, 24, 25]
    t = spark.createDataFrame([(dt.datetime(2024, 3, 10, 11),), (dt.datetime(2024, 3, 11, 11),), (dt.datetime(2024, 3, 11, 12),)], "t timestamp")
    got = t.select(*[report_day("t", r).alias(r) for r in ("abs7", "wall7_left", "wall7_right")]).collect()
    assert got[0]["abs7"] != got[0]["wall7_left"]
    assert (got[1]["wall7_left"], got[1]["wall7_right"]) == (dt.date(2024, 3, 12), dt.date(2024, 3, 11))


def test_pearson_edges(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 1.0), ("b", 2.0, 1.0), ("c", 1.0, 2.0), ("c", 2.0, 4.0), ("c", None, 9.0)], "k string, x double, y double")
    got = {r["k"]: r["r"] for r in df.groupBy("k").agg(verify.pearson("x", "y").alias("r")).collect()}
    assert got["a"] is None and got["b"] is None and got["c"] == pytest.approx(1.0)


def test_missing_values_propagate(spark):
    df = spark.createDataFrame([(None, 1.0), (2.0, 1.0)], "x double, y double")
    assert [tuple(r) for r in df.select(scalars.pmin(F.col("x"), F.col("y")), scalars.ramp(F.col("x"), 1.0, 3.0), scalars.limiter(F.col("y"), F.col("x"))).collect()] == [(None, None, 2), (1.0, 0.5, 1)]
    assert df.select(scalars.score_class(F.col("x"), F.lit(True)), scalars.score_class(F.col("x"), F.lit(True), strict=True)).first()[:] == (1, None)


def test_season_goldens(spark):
    one = spark.range(1)
    s = lambda *x: round(one.select(scalars.season_score(F.lit(278), *map(F.lit, x))).first()[0], 2)
    got = {name: s(*rest[:4]) for name, _, _, _, *rest in codes.SPECIES}
    assert got == {"black_trumpet": 0.24, "bolete": 0.75, "chicken": 1.0, "hen": 1.0, "chanterelle": 0.0}


def test_lead_classes(spark):
    assert [r[0] for r in spark.createDataFrame([(0,), (24,), (25,), (48,), (49,)], "h int").select(lead_day(F.col("h"))).collect()] == [None, 1, 2, 2, None]


def test_rings(spark):
    hole = [{"x": 1.0, "y": 1.0}, {"x": 3.0, "y": 1.0}, {"x": 3.0, "y": 3.0}, {"x": 1.0, "y": 3.0}, {"x": 1.0, "y": 1.0}]
    df = polys(spark, [(1, [*square(0.0, 0.0, 4.0), hole])]).withColumn("x", F.lit(2.0)).withColumn("y", F.lit(2.0))
    r = df.select(geo.polygon_area("rings"), geo.contains_point("rings", "x", "y"), geo.contains_point("rings", "0.5D", "0.5D"), geo.polygon_distance("rings", "5D", "2D"), geo.polygon_valid("rings"), geo.ring_roles("rings").getField("outer")).first()
    assert tuple(r) == (12.0, False, True, 1.0, True, [True, False])
    w = spark.createDataFrame([("POLYGON ((0 0, 0 2, 2 2, 2 0, 0 0))",)], "w string").select(geo.wkt_rings("w").alias("rings"))
    assert w.select(geo.polygon_area("rings")).first()[0] == 4.0


def test_projections(spark):
    p = spark.createDataFrame([(-70.9, 41.6)], "lon double, lat double")
    x, y = geo.to_utm(F.col("lon"), F.col("lat"))
    mx, my = geo.to_mercator(F.col("lon"), F.col("lat"))
    lo, la = geo.from_mercator(mx, my)
    r = p.select(x, y, lo, la, *geo.to_mass_mainland(F.col("lon"), F.col("lat")), *geo.to_hrrr(F.lit(-97.5), F.lit(38.5))).first()
    assert 340000 < r[0] < 343500 and 4606000 < r[1] < 4609000
    assert r[2] == pytest.approx(-70.9) and r[3] == pytest.approx(41.6)
    assert 248000 < r[4] < 252000 and 814000 < r[5] < 819000
    assert abs(r[6]) < 1e-6 and abs(r[7]) < 1e-6


def test_weights_fill_the_polygon(spark):
    spec = grid.GridSpec(0.0, 10.0, 1.0, 10, 10)
    tri = [[{"x": 1.3, "y": 1.1}, {"x": 4.2, "y": 8.7}, {"x": 8.9, "y": 2.2}, {"x": 1.3, "y": 1.1}]]
    w = zonal.cell_weights(polys(spark, [(1, tri)]), spec, "basin_id")
    r = w.agg(F.sum("area"), F.max("poly_area")).first()
    assert r[0] == pytest.approx(r[1])
    field = spark.createDataFrame([(i, j, None if j > 4 else 2.0) for i in range(10) for j in range(10)], "row int, col int, value double")
    m = zonal.polygon_means(field, w, [], "basin_id").first()
    assert m["mean"] == pytest.approx(2.0) and 0 < m["cover_frac"] < 1


def test_burn_and_interior(spark):
    spec = grid.GridSpec(0.0, 10.0, 1.0, 10, 10)
    df = polys(spark, [(1, square(0.0, 0.0, 6.0)), (2, square(4.0, 4.0, 4.0))])
    got = {(r["row"], r["col"]): r["value"] for r in zonal.burn(df, spec, "basin_id", "basin_id").collect()}
    assert got[(5, 5)] == 2 and got[(9, 0)] == 1 and len(got) == 36 + 16 - 4
    assert zonal.interior_cells(df.where("basin_id = 1"), spec, "basin_id", 2.0).count() == 4
    assert zonal.inside_any(spark.createDataFrame([(9, 0), (0, 9)], "row int, col int"), df, spec).count() == 1
    ways = [(1, [(0.5, 0.5), (5.5, 0.5)]), (2, [(0.5, 0.5), (4.5, 0.5), (4.5, 0.7), (0.5, 0.7)]), (3, [(9.5, 9.5), (8.5, 9.5)]), (4, None), (5, [(0.5, 0.5), (0.5, 0.5), (0.7, 0.5)])]
    lines = spark.createDataFrame([(k, p and [{"x": x, "y": y} for x, y in p]) for k, p in ways], "line int, points array<struct<x:double,y:double>>")
    got = {r["line"]: (r["length"], r["crossings"]) for r in zonal.line_crossings(spark.createDataFrame([(9, 0, 7), (9, 1, 7)], "row int, col int, label int"), lines, spec).collect()}
    assert got == {1: (pytest.approx(1.5), 1), 2: (pytest.approx(3.0), 2), 5: (pytest.approx(0.2), 1)}


def test_morphology_and_patches(spark):
    rng = np.random.default_rng(1)
    m = rng.random((20, 20)) < 0.6

    def shift(a, f):
        p = np.pad(a, 1)
        return f([p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]])

    erode, dilate = lambda a: shift(a, np.logical_and.reduce), lambda a: shift(a, np.logical_or.reduce)
    cells = spark.createDataFrame([(int(i), int(j)) for i, j in zip(*np.nonzero(m), strict=True)], "row int, col int")
    as_set = lambda a: {(int(i), int(j)) for i, j in zip(*np.nonzero(a), strict=True)}
    assert {tuple(r) for r in grid.opening(cells, 1, 20, 20).collect()} == as_set(dilate(erode(m)))
    assert {tuple(r) for r in grid.closing(cells, 1, 20, 20).collect()} == as_set(erode(dilate(m)))
    label = np.zeros(m.shape, int)
    k = 0
    for i, j in as_set(m):
        if not label[i, j]:
            k += 1
            todo = [(i, j)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < 20 and 0 <= b < 20 and m[a, b] and not label[a, b]:
                    label[a, b] = k
                    todo += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
    got = grid.components(cells).collect()
    pairs = {(r["label"], label[r["row"], r["col"]]) for r in got}
    assert len(got) == m.sum() and len(pairs) == k == len({a for a, _ in pairs})


def test_soil_fold_against_a_loop(spark):
    rng = np.random.default_rng(2)
    days = [(0, n, float(rng.gamma(0.4, 18)), float(2 + rng.random())) for n in range(120)]
    f = spark.createDataFrame(days, "cell int, n int, p double, pet double")
    caps = spark.createDataFrame([(0, 30.0), (0, 90.0), (0, None)], "cell int, cap double")
    for r in moisture.soil_state(f, caps, ["cell"]).collect():
        cap, armed, wet, soak, states = r["cap"], True, None, None, []
        s = None if cap is None else cap / 2
        for _, n, p, pet in days:
            armed = armed or (cap is not None and s / cap < 0.3)
            if p >= 12.7:
                soak = n if n >= 90 else soak
                if armed:
                    armed, wet = False, n
            if cap is not None:
                s = min(s + 0.85 * p, cap)
                s = max(s - pet * s / cap, 0)
                if n >= 90:
                    states.append(s / cap)
        assert r["days_since_wetup"] == (None if wet is None else 119 - wet) and r["days_since_soak"] == (None if soak is None else 119 - soak)
        if cap is None:
            assert r["sm"] is None and r["mean_7"] is None
        else:
            assert r["sm"] == pytest.approx(s / cap) and r["mean_7"] == pytest.approx(np.mean(states[-7:])) and r["mean_21"] == pytest.approx(np.mean(states[-21:]))


def test_soil_stream_equals_fold(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(c, n, float(rng.gamma(0.5, 20)), 3.0, 40.0) for c in (1, 2) for n in range(12)]
    rng.shuffle(rows)
    schema = "cell int, n int, p double, pet double, cap double"
    for k in range(3):
        spark.createDataFrame([(int(a), int(b), *map(float, c)) for a, b, *c in rows[k::3]], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = refresh.soil_stream(stream).writeStream.format("memory").queryName("soil").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["cell"]: r["s"] for r in spark.table("soil").where("n = 11").collect()}
    f = spark.createDataFrame([(int(a), int(b), float(p), float(e)) for a, b, p, e, _ in rows], "cell int, n int, p double, pet double")
    want = {r["cell"]: r["sm"] * 40 for r in moisture.soil_state(f, f.select("cell", F.lit(40.0).alias("cap")).distinct(), ["cell"]).collect()}
    assert got == pytest.approx(want)


def test_soil_stream_over_gaps(spark, tmp_path):
    """Dropped and late days: the fold goes on as over a table without them, and what waits stays within the watermark's delay."""
    rng = np.random.default_rng(5)
    rows = {(c, n): float(rng.gamma(0.5, 20)) for c in (1, 2, 3) for n in range(60) if (c * n) % 5 != 3 and not (c == 2 and n < 4)}
    schema = "cell int, n int, day timestamp, p double, pet double, cap double"
    row = lambda c, n, p: (c, n, dt.datetime(2024, 1, 1) + dt.timedelta(days=n), p, 3.0, None if c == 3 else 40.0)
    for k in range(6):
        part = [row(c, n, p) for (c, n), p in rows.items() if n // 10 == k] + [row(c, n, 500.0) for c in (1, 2, 3) for n in range(10 * k - 18, 10 * k - 12) if n >= 0 and (c, n) not in rows]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = refresh.soil_stream(stream, day="day").writeStream.format("memory").queryName("gaps").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = {(r["cell"], r["n"]): (r["s"], r["wet"]) for r in spark.table("gaps").collect()}
    assert set(got) >= {k for k in rows if k[1] < 57} and set(got) <= set(rows) and len(got) == spark.table("gaps").count()
    held = max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress)
    assert held < 60  # of three cells: their state and the days of a batch, not the days of the record
    for last in (9, 30, 56):
        f = spark.createDataFrame([(c, n, p, 3.0) for (c, n), p in rows.items() if n <= last and c < 3], "cell int, n int, p double, pet double")
        for r in moisture.soil_state(f, f.select("cell", F.lit(40.0).alias("cap")).distinct(), ["cell"]).collect():
            n = max(n for c, n in rows if c == r["cell"] and n <= last)
            assert got[r["cell"], n][0] == pytest.approx(r["sm"] * 40)


def test_soil_bucket_touches_its_state_once_a_batch():
    """The calls to the state store don't grow with the days of a batch; days before their turn wait, and come back in theirs."""
    calls, value, kept = [], [None], {}

    class Value:
        get = lambda self: calls.append("get") or value[0]
        exists = lambda self: calls.append("exists") or value[0] is not None
        update = lambda self, v: calls.append("update") or value.__setitem__(0, v)

    class Waiting:
        containsKey = lambda self, n: calls.append("contains") or n in kept
        getValue = lambda self, n: calls.append("value") or kept.get(n)
        updateValue = lambda self, n, v: calls.append("put") or kept.__setitem__(n, v)
        removeKey = lambda self, n: calls.append("remove") or kept.pop(n)
        keys = lambda self: calls.append("keys") or iter(list(kept))

    handle = type("Handle", (), {"getValueState": lambda self, *a: Value(), "getMapState": lambda self, *a: Waiting()})()
    bucket = refresh.SoilBucket()
    bucket.init(handle)
    days = lambda ns: iter([Row(cell=1, n=n, p=n % 7 * 4.0, pet=3.0, cap=40.0) for n in ns])
    first = list(bucket.handleInputRows((1,), days(range(300)), None))
    assert [r.n for r in first] == list(range(300)) and len(calls) <= 3
    calls.clear()
    assert list(bucket.handleInputRows((1,), days([301, 303, 302]), None)) == [] and kept == {} and len(calls) == 2
    assert list(bucket.handleInputRows((1,), days(range(450, 303, -1)), None)) == [] and len(kept) == 150 - refresh.NEAR
    rest = list(bucket.handleInputRows((1,), days([300]), None))
    assert [r.n for r in rest] == list(range(300, 451)) and kept == {}
    value[0] = None
    assert list(bucket.handleInputRows((1,), days(range(451)), None)) == first + rest


def test_soil_bucket_waits_within_its_state():
    """Days behind a gap that the watermark has not passed cost no calls each, nor does the timer that lets them go on."""
    calls, value = [], [None]

    class Value:
        get = lambda self: calls.append("get") or value[0]
        exists = lambda self: calls.append("exists") or value[0] is not None
        update = lambda self, v: calls.append("update") or value.__setitem__(0, v)

    timer = lambda name: lambda self, *a: calls.append(name)
    handle = type("Handle", (), {"getValueState": lambda self, *a: Value(), "getMapState": lambda self, *a: None, "registerTimer": timer("register"), "deleteTimer": timer("delete")})()
    at = lambda n: type("Times", (), {"getCurrentWatermarkInMs": lambda self: 1704067200000 + n * refresh.DAY_MS if n else 0})()
    bucket = refresh.SoilBucket(timed=True)
    bucket.init(handle)
    days = lambda ns: iter([Row(cell=1, n=n, day=dt.datetime(2024, 1, 1) + dt.timedelta(days=n), p=5.0, pet=3.0, cap=40.0) for n in ns])
    ns = [n for n in range(40) if n % 7 != 3]
    out = list(bucket.handleInputRows((1,), days(ns), at(0)))
    assert [r.n for r in out] == [0, 1, 2] and calls == ["get", "register", "update"]
    out = list(bucket.handleExpiredTimer((1,), at(38), None))
    assert [r.n for r in out] == [n for n in ns if n > 3] and calls[3:] == ["get", "update"]
    assert list(bucket.handleInputRows((1,), days([3, 38]), at(38))) == []


def test_basin_stream_equals_batch(spark, tmp_path):
    """Missing hours and cells, repeated reports and a clock change."""
    rng = np.random.default_rng(6)
    spec = grid.GridSpec(0.0, 6.0, 1.0, 6, 6)
    shapes = polys(spark, [(1, [[{"x": 0.5, "y": 0.5}, {"x": 0.5, "y": 4.5}, {"x": 4.5, "y": 0.5}, {"x": 0.5, "y": 0.5}]]), (2, square(2.0, 2.0, 3.5))])
    start = dt.datetime(2024, 3, 8, 13)
    rows = [(r, c, start + dt.timedelta(hours=h), None if (r + c + h) % 5 == 0 or (h % 24 > 20 and c < 4) or r == 3 else float(rng.gamma(1, 2))) for r in range(6) for c in range(6) for h in range(150) if (r, c) != (4, 4)]
    h = spark.createDataFrame(rows, "row int, col int, time timestamp, value double")
    h.union(h.where("row = 2")).repartition(4).write.parquet(str(tmp_path / "h"))
    stream = spark.readStream.schema(h.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "h"))
    q = refresh.basin_days(stream, zonal.cell_weights(shapes, spec, "basin_id"), late="30 days").writeStream.format("memory").queryName("basins").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert spark.table("basins").count() == 0  # nothing is over yet
    end = spark.createDataFrame([(0, 0, dt.datetime(2024, 6, 1), 1.0)], h.schema)
    end.write.mode("append").parquet(str(tmp_path / "h"))
    q = refresh.basin_days(stream, zonal.cell_weights(shapes, spec, "basin_id"), late="30 days").writeStream.format("memory").queryName("basins2").option("checkpointLocation", str(tmp_path / "ck2")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    want = {(r["report_date"], r["basin_id"]): r for r in series.basin_daily(h, shapes, spec).collect()}
    got = {(r["report_date"], r["basin_id"]): r for r in spark.table("basins2").collect()}
    assert set(got) == set(want) and {w["n_hours_expected"] for w in want.values()} == {23, 24}
    for k, w in want.items():
        assert (got[k]["n_hours"], round(got[k]["cover_frac"], 4)) == (w["n_hours"], pytest.approx(w["cover_frac"], abs=1e-4)) and got[k]["mean"] == pytest.approx(w["precip_mm"], abs=1e-3)


def test_versioned_commits(spark, tmp_path):
    from envgrid.sources import versions

    path = str(tmp_path / "table")
    rows = lambda *x: spark.createDataFrame([(dt.date(2024, 1, d), b, v) for d, b, v in x], "report_date date, basin_id int, v double")
    read = lambda **k: sorted((r["report_date"].day, r["basin_id"], r["v"]) for r in versions.read_table(spark, path, **k).collect())
    with pytest.raises(ValueError):
        versions.read_table(spark, path)
    assert versions.commit(rows((1, 1, 1.0), (2, 1, 1.0), (2, 2, 1.0)), path, "a") == 1
    before = versions.read_table(spark, path)
    assert versions.commit(rows((2, 1, 5.0), (3, 1, 5.0)), path, "b") == 2
    assert read() == [(1, 1, 1.0), (2, 1, 5.0), (3, 1, 5.0)] and read(version=1) == [(1, 1, 1.0), (2, 1, 1.0), (2, 2, 1.0)]
    assert before.count() == 3  # a reader keeps the state that it began with
    assert versions.commit(rows((1, 9, 9.0)), path, "b") == 2 and len(read()) == 3  # the same batch again
    versions.write_rows(rows((1, 7, 7.0)), path, "dead", "report_date")  # a writer that died before its commit
    assert read() == [(1, 1, 1.0), (2, 1, 5.0), (3, 1, 5.0)] and read(first="2024-01-02", last="2024-01-02") == [(2, 1, 5.0)]
    # another writer takes the next version while this one writes: it goes on from that one's state
    publish, raced = versions.publish, []

    def race(s, p, state):
        if not raced:
            raced.append(publish(s, p, {**versions.manifest(s, p), "version": state["version"], "batches": ["a", "b", "other"]}))
        publish(s, p, state)

    versions.publish = race
    try:
        assert versions.commit(rows((4, 1, 4.0)), path, "c", dates=rows((4, 0, 0.0), (3, 0, 0.0))) == 4
    finally:
        versions.publish = publish
    assert versions.manifest(spark, path)["batches"] == ["a", "b", "other", "c"] and read() == [(1, 1, 1.0), (2, 1, 5.0), (4, 1, 4.0)]
    with pytest.raises(versions.Conflict):
        versions.publish(spark, path, {**versions.manifest(spark, path)})
    assert versions.vacuum(spark, path) > 0 and read() == [(1, 1, 1.0), (2, 1, 5.0), (4, 1, 4.0)] and versions.versions(spark, path) == [4]


def test_blocks_dealt_as_one_by_one(spark):
    """Runs of blocks of one size against dealing them one by one, for few and many, equal and very different sizes."""
    def one_by_one(sizes, folds):
        load, out = [0] * folds, []
        for size, n in sizes:
            for _ in range(n):
                k = min(range(folds), key=lambda i: (load[i], i))
                load[k] += size
                out.append(k)
        return out

    rng = np.random.default_rng(9)
    for _ in range(200):
        folds = int(rng.integers(1, 7))
        sizes = sorted({int(x): int(rng.integers(1, 40)) for x in rng.choice([1, 2, 3, 5, 8, 40, 41, 1000], rng.integers(1, 6))}.items(), reverse=True)
        runs = hosts.dealt_runs(sizes, folds)
        got = [order[j % len(order)] for _, _, n, order in runs for j in range(n)]
        assert got == one_by_one(sizes, folds), (sizes, folds)
    assert len(hosts.dealt_runs([(250_000, 1), (1, 2_000_000)], 5)) < 20
    rows = [(b, i) for b, n in enumerate([9, 1, 4, 4, 7, 1, 1, 2, 30, 4, 1]) for i in range(n)]
    df = spark.createDataFrame(rows, "block int, id int")
    order = sorted(range(11), key=lambda b: (-[9, 1, 4, 4, 7, 1, 1, 2, 30, 4, 1][b], b))
    sizes = [(30, 1), (9, 1), (7, 1), (4, 3), (2, 1), (1, 4)]
    assert {r["block"]: r["fold"] for r in hosts.fold_of_blocks(df).collect()} == dict(zip(order, one_by_one(sizes, 5), strict=True))


def test_staged_tables_are_cleared(spark):
    import glob

    left = lambda: set(glob.glob(f"{stages.shared_dir(spark)}/grid-*"))
    stages.clear_staged()
    before = left()
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "g string, v double")
    assert index.quantiles(df, ["g"], "v", [0.5]).first()["p50"] == 1.5
    assert left() > before and stages.clear_staged() > 0 and left() == before and stages.clear_staged() == 0


def test_report_day_stream(spark, tmp_path):
    hours = [(dt.datetime(2024, 3, 9, 12) + dt.timedelta(hours=h), 1, 1.0) for h in range(1, 24)] + [(dt.datetime(2024, 3, 9, 13), 1, 1.0), (dt.datetime(2024, 3, 20), 1, 0.0)]
    spark.createDataFrame(hours, "time timestamp, cell int, value double").coalesce(1).write.parquet(str(tmp_path / "h"))
    stream = spark.readStream.schema("time timestamp, cell int, value double").parquet(str(tmp_path / "h"))
    q = refresh.report_day_totals(stream, "cell").writeStream.format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    r = spark.table("days").orderBy("window_end").first()
    assert (r["total"], r["n_hours"]) == (23.0, 23)
    assert refresh.gap_alerts(spark.table("days")).where("report_date = DATE'2024-03-10'").count() == 0


def test_nearest_cycle_without_neighbours(spark):
    w = spark.createDataFrame([(dt.datetime(2024, 1, 1, 12),), (dt.datetime(2024, 1, 5, 12),)], "wanted timestamp")
    c = spark.createDataFrame([(dt.datetime(2024, 1, 3, 12),)], "cycle timestamp")
    assert {r["cycle"] for r in verify.nearest_cycle(w, c).collect()} == {dt.datetime(2024, 1, 3, 12)}


def test_nearest_cycle_in_both_directions(spark, capsys):
    """Many times of one hour, equal times, hours without cycles; no frame of the plan begins at its row, which costs the square of an hour's times."""
    rng = np.random.default_rng(12)
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=int(s))
    cycles = sorted({at(s) for s in [*rng.integers(7200, 9000, 40), *rng.integers(200000, 400000, 20)]})
    wanted = {at(s) for s in [*rng.integers(7000, 9500, 150), *rng.integers(0, 500000, 100)]} | set(cycles[::7])
    got = verify.nearest_cycle(spark.createDataFrame([(t,) for t in wanted], "wanted timestamp"), spark.createDataFrame([(t,) for t in cycles], "cycle timestamp"))
    assert {(r["wanted"], r["cycle"], r["substituted"]) for r in got.collect()} == {(t, c := min(cycles, key=lambda x: (abs(x - t), x)), c != t) for t in wanted}
    got.explain(True)
    assert "unboundedfollowing" not in capsys.readouterr().out.lower()


def test_dates_and_upsert(spark, tmp_path):
    assert series.parse_dates(spark, "2024-01-03,2024-02-01:2024-02-03,2024-02-02").count() == 4
    old = spark.createDataFrame([(dt.date(2024, 1, 1), 1, 1.0), (dt.date(2024, 1, 2), 1, 1.0), (dt.date(2024, 1, 2), 2, 1.0)], "report_date date, basin_id int, v double")
    new = spark.createDataFrame([(dt.date(2024, 1, 2), 1, 5.0)], "report_date date, basin_id int, v double")
    once = series.upsert(old, new)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, series.upsert(once, new).collect())) and once.count() == 2
    path = str(tmp_path / "series")
    io.write_series(old, path)
    refresh.upsert_batches(path)(new, 0)
    assert {tuple(r) for r in io.read_series(spark, path, first="2024-01-02", columns=("basin_id", "v")).collect()} == {(1, 5.0)}


def test_formats(spark, tmp_path):
    geojson = '{"features":[{"properties":{"id":"a"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,2],[0,2],[0,0]],[[0.5,0.5],[1,0.5],[1,1],[0.5,1],[0.5,0.5]]]}},{"properties":{"id":"b"},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,6],[5,5]]]]}}]}'
    t = spark.createDataFrame([(geojson,)], "value string")
    got = {r[0]: r[1] for r in io.polygon_features(t, ["id"]).select("id", geo.polygon_area("rings")).collect()}
    assert got == {"a": 3.75, "b": 2.0} and io.features(t, ["id"]).count() == 2
    page = '{"results":[{"stationNumber":"S1","obsDateTime":"2024-01-02T07:00:00","precip":0.5}],"metadata":{"resultset":{"totalCount":2}}}'
    p = spark.createDataFrame([("r", page), ("r", page)], "request string, value string")
    assert io.observations(p).count() == 1 and io.page_completeness(p.limit(1)).first()["complete"] is False
    g = spark.createDataFrame([("S1", 'a "b", c', 1.0, 2.0, dt.date(2024, 1, 2), None)], io.GAUGE_DAILY)
    io.write_csv(g, str(tmp_path / "g"))
    assert io.read_csv(spark, str(tmp_path / "g")).collect() == g.collect()
    cells = spark.createDataFrame([(0, 0, 65535.0), (0, 600, 1.0)], "row int, col int, value double")
    io.write_layer(cells, str(tmp_path / "l"), "oak")
    assert io.read_layer(spark, str(tmp_path / "l"), "oak", nodata=65535.0).where("value IS NULL").count() == 1
    assert io.read_layer(spark, str(tmp_path / "l"), "oak", cols=(500, 700)).count() == 1
    made = []
    for _ in range(2):
        stages.stage_once(spark, str(tmp_path / "once"), lambda: made.append(1) or cells).count()
    assert len(made) == 1


def test_folds_are_disjoint_by_block(spark):
    rng = np.random.default_rng(4)
    rows = [(int(k), int(k) % 2, int(k) // 10, [float(k % 2) * 2 + float(x) for x in rng.normal(size=4)]) for k in range(120)]
    out = hosts.out_of_fold(spark.createDataFrame(rows, "id int, y int, block int, emb array<double>"), iterations=30)
    assert out.count() == 120 and out.groupBy("block").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    assert out.where("abs(aggregate(proba, 0D, (a, p) -> a + p) - 1) > 1e-9").count() == 0
    assert '"balanced_accuracy"' in hosts.report(out).first()[0]


def test_percent_bands_of_every_embedding(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = [(k, k % 2, [float(k % 2) * 4 + float(x) for x in rng.normal(size=3)]) for k in range(7000)] + [(7000, None, [4.0, 4.0, 4.0]), (7001, 1, None)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    e = spark.read.parquet(str(tmp_path / "embeddings.parquet")).select("vec_id", F.col("embedding").alias("emb"), F.col("label").alias("y"))
    done = hosts.predict_all(e, index.capped_sample(e.where("y IS NOT NULL"), ["y"], 3000, F.col("vec_id"))).select("vec_id", "pred", hosts.percent_bytes().alias("bands"))
    got = {r["vec_id"]: r for r in done.collect()}
    assert {r["y"]: r["n"] for r in registry.QUERIES["ml06_percent_bands"](spark, str(tmp_path)).collect()} == {0: 3500, 1: 3501, None: 1}
    assert len(got) == 7002 and got[7000]["pred"] == 1 and got[7001]["bands"] is None
    assert all(abs(sum(r["bands"]) - 100) <= 1 for k, r in got.items() if k < 7001)
    assert sum(got[k]["pred"] == k % 2 for k in range(7000)) > 6900


def test_sampling_is_repeatable(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 2)
    a, b = (sorted(r["id"] for r in index.capped_sample(df, ["g"], 7, F.col("id")).collect()) for _ in range(2))
    assert a == b and len(a) == 14


def test_code_lists(spark):
    df = spark.createDataFrame([("TOWN OF X", "Well drained", 500), ("J. DOE", "none", 77)], "o string, d string, c int")
    got = [tuple(r) for r in df.select(scalars.public_owner(F.col("o")), scalars.drainage_ordinal(F.col("d")), scalars.forest_group(F.col("c"))).collect()]
    assert got == [(True, 3, "Oak/hickory"), (False, None, "unmapped 77")]


def test_score_with_missing_terms(spark):
    from envgrid.operators import score

    cell = "cell int, canopy boolean, oak double, nonhost double, evergreen double, doy int, tmin7 double, frost int, wetup int, sm_14 double, sm_21 double, rain_14 double, rain_21 double"
    rows = [(1, True, 0.3, None, None, 200, None, None, None, 0.9, 0.9, 90.0, 90.0), (2, True, 0.3, 0.0, 0.0, 200, 20.0, 100, 2, None, None, 90.0, 90.0), (3, False, 0.3, None, None, 200, None, None, None, 0.9, 0.9, 90.0, 90.0)]
    got = {(r["species"], r["cell"]): (r["score"], r["class"], r["limiter"]) for r in score.score_species(spark.createDataFrame(rows, cell), score.species_table(spark)).collect()}
    assert got["chanterelle", 1] == (1.0, 3, 0) and got["chanterelle", 2] == (None, 1, 3) and got["chanterelle", 3] == (None, 0, 0)
    assert got["hen", 1][1:] == (1, 2)


def test_trailing_and_unique_streams(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 1, n)
    spark.createDataFrame([(day(1), 1, 2.0), (day(1), 1, 2.0), (day(2), 1, 3.0), (day(30), 1, 0.0)], "day timestamp, cell int, value double").coalesce(1).write.parquet(str(tmp_path / "d"))
    stream = spark.readStream.schema("day timestamp, cell int, value double").parquet(str(tmp_path / "d"))
    q = refresh.trailing_totals(refresh.unique_reports(stream, ["day", "cell"], "day"), "cell", days=2, late=None).writeStream.format("memory").queryName("trail").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["start"]: r["total"] for r in spark.table("trail").select("window.start", "total").collect()}
    assert got[day(1)] == 5.0 and got[day(2)] == 3.0


def clipped(ring, x0, y0, x1, y1):
    """Area with sign of a ring within a box, edge by edge."""
    p = [tuple(v) for v in ring[:-1]]
    for axis, bound, keep in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        out = []
        for a, b in zip(p, p[1:] + p[:1], strict=True):
            u, v = keep * (a[axis] - bound), keep * (b[axis] - bound)
            if u >= 0:
                out.append(a)
            if u * v < 0:
                out.append(tuple(x + (y - x) * u / (u - v) for x, y in zip(a, b, strict=True)))
        p = out
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1], strict=True)) / 2 if p else 0.0


def random_polygons(n, seed=5):
    """Star-shaped outlines with a hole, some of them reaching out of the frame of 20 x 20."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        cx, cy = rng.uniform(-2, 22, 2)
        at = np.sort(rng.uniform(0, 2 * np.pi, 9))[::-1]
        r = rng.uniform(1, 6, 9)
        ring = [(cx + a * np.cos(t), cy + a * np.sin(t)) for a, t in zip(r, at, strict=True)]
        hole = [(cx + 0.2 * np.cos(t), cy + 0.2 * np.sin(t)) for t in np.sort(rng.uniform(0, 2 * np.pi, 5))]
        out.append((k, [[{"x": float(x), "y": float(y)} for x, y in [*q, q[0]]] for q in (ring, hole)]))
    return out


def test_areas_and_centres_of_any_outline(spark, monkeypatch):
    monkeypatch.setattr(zonal, "STRIP", 7)
    spec, shapes = grid.GridSpec(0.0, 20.0, 1.0, 20, 20), random_polygons(12)
    got = {(r["basin_id"], r["row"], r["col"]): r["area"] for r in zonal.cell_weights(polys(spark, shapes), spec, "basin_id").collect()}
    for k, rings in shapes:
        for row in range(20):
            for col in range(20):
                want = abs(sum(clipped([(v["x"], v["y"]) for v in r], col, 19 - row, col + 1, 20 - row) for r in rings))
                assert got.get((k, row, col), 0.0) == pytest.approx(want, abs=1e-7), (k, row, col)
    centres = {(r["basin_id"], r["row"], r["col"]) for r in zonal.centre_cells(polys(spark, shapes), spec, ["basin_id"]).collect()}
    every = polys(spark, shapes).crossJoin(spark.range(400)).select("basin_id", "rings", (F.col("id") % 20 + 0.5).alias("x"), (F.floor(F.col("id") / 20) + 0.5).alias("y"))
    want = {(r["basin_id"], 19 - int(r["y"]), int(r["x"])) for r in every.where(geo.contains_point("rings", "x", "y")).collect()}
    assert centres == want


def test_points_boxes_and_distances_of_any_outline(spark):
    spec, shapes = grid.GridSpec(0.0, 20.0, 1.0, 20, 20), polys(spark, random_polygons(8, 9))
    rng = np.random.default_rng(2)
    pts = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 20, (150, 2)))], "id int, x double, y double")
    both = pts.crossJoin(shapes)
    want = {(r["id"], r["basin_id"]) for r in both.where(geo.contains_point("rings", "x", "y")).select("id", "basin_id").collect()}
    found = zonal.points_inside(pts, shapes, spec, "basin_id").collect()
    assert {(r["id"], r["basin_id"]) for r in found if r["basin_id"] is not None} == want and {r["id"] for r in found} == set(range(150))
    # equal points, missing columns and missing coordinates stay rows of their own
    odd = spark.createDataFrame([(None, 3.3, 3.4), (None, 3.3, 3.4), (7, 3.3, 3.4), (7, 19.9, 0.1), (8, None, 1.0)], "tag int, x double, y double").withColumn("basin_id", F.lit("theirs")).drop("basin_id")
    inside = {k for k, rings in random_polygons(8, 9) if spark.createDataFrame([(3.3, 3.4)], "x double, y double").crossJoin(polys(spark, [(k, rings)])).where(geo.contains_point("rings", "x", "y")).count()}
    rows = [tuple(r) for r in zonal.points_inside(odd, shapes, spec, "basin_id").where("x = 3.3 OR x IS NULL").collect()]
    assert sorted(map(repr, rows)) == sorted([*(repr((t, 3.3, 3.4, k)) for t in (None, None, 7) for k in (inside or {None})), repr((8, None, 1.0, None))])
    far = pts.withColumn("x", 4 * F.col("x") - 30).withColumn("y", 3 * F.col("y") - 20)
    near = {r["id"]: r["d"] for r in far.crossJoin(shapes).groupBy("id").agg(F.min(geo.polygon_distance("rings", "x", "y")).alias("d")).collect()}
    got = {r["id"]: r["distance"] for r in zonal.nearest_distance(far, shapes, "id", 0.7).collect()}
    assert got == pytest.approx(near) and zonal.nearest_distance(far, shapes.limit(0), "id", 1.0).where("distance IS NULL").count() == 150
    assert {r["id"]: r["distance"] for r in zonal.nearest_distance(far.withColumn("x", F.col("x") * 1000 + 1e5), shapes, "id", 0.01).collect()} == pytest.approx(
        {r["id"]: r["d"] for r in far.withColumn("x", F.col("x") * 1000 + 1e5).crossJoin(shapes).groupBy("id").agg(F.min(geo.polygon_distance("rings", "x", "y")).alias("d")).collect()}
    )
    for margin in (0.4, 1.7, 3.0):
        every = shapes.crossJoin(spark.range(400)).select("basin_id", "rings", (F.col("id") % 20 + 0.5).alias("x"), (F.floor(F.col("id") / 20) + 0.5).alias("y")).where(geo.contains_point("rings", "x", "y") & (geo.boundary_distance("rings", "x", "y") >= margin))
        assert {tuple(r) for r in zonal.interior_cells(shapes, spec, "basin_id", margin).collect()} == {(r["basin_id"], 19 - int(r["y"]), int(r["x"])) for r in every.collect()}
    boxes = pts.select("id", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 1.3).alias("x1"), (F.col("y") + 0.6).alias("y1")).where("x1 < 20 AND y1 < 20")
    areas = {(r["id"], k) for r in boxes.collect() for k, rings in random_polygons(8, 9) if abs(sum(clipped([(v["x"], v["y"]) for v in q], r["x0"], r["y0"], r["x1"], r["y1"]) for q in rings)) > 1e-9}
    assert {tuple(r) for r in zonal.boxes_that_meet(boxes, shapes, spec, "basin_id", "id").collect()} == areas


def test_lookup_of_an_unknown_id_fails(spark):
    dim = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    assert [tuple(r) for r in verify.ordered_lookup([2, 1], dim, "id").orderBy("place").collect()] == [(1, 2, "b"), (2, 1, "a")]
    with pytest.raises(Exception, match="no id 3"):
        verify.ordered_lookup([2, 3], dim, "id").collect()


def test_quantiles_of_groups_and_windows_by_date(spark):
    rng = np.random.default_rng(4)
    rows = [("hot", float(v)) for v in rng.integers(0, 40, 4000)] + [("one", 3.0), ("two", 1.0), ("two", 4.0), ("none", None)]
    got = {r["k"]: r for r in index.quantiles(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v", [0.1, 0.5, 0.97]).collect()}
    for k in ("hot", "one", "two"):
        v = [x for g, x in rows if g == k]
        assert (got[k]["p10"], got[k]["p50"], got[k]["p97"]) == pytest.approx(tuple(np.percentile(v, [10, 50, 97]))) and got[k]["n"] == len(v)
    assert "none" not in got and index.coverage(spark.createDataFrame([], "v double"), "v").first()["median"] is None
    days = spark.createDataFrame([(1, dt.date(2024, 1, n), float(n)) for n in (1, 2, 9, 10)], "k int, day date, v double")
    assert [r[0] for r in days.orderBy("day").select(moisture.trailing_sum("v", 7, "k", "day")).collect()] == [1.0, 3.0, 9.0, 19.0]


def test_numbered_rows(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v"))
    assert index.numbered(df.repartition(7), "v").where("k <> v + 1").count() == 0
    assert [r["v"] for r in index.strided(df, 250, "v").orderBy("v").collect()] == [0, 250, 500, 750]


def test_scene_days_and_layers(spark):
    s = spark.createDataFrame([(dt.datetime(2024, 1, 1, 15), 0.0, 0.0, 5.0, 5.0, 10.0), (dt.datetime(2024, 1, 1, 16), 0.0, 0.0, 5.0, 5.0, 10.0), (dt.datetime(2024, 1, 2), 0.0, 0.0, 5.0, 5.0, 60.0), (dt.datetime(2024, 1, 3), 9.0, 9.0, 10.0, 10.0, 1.0)], "datetime timestamp, x0 double, y0 double, x1 double, y1 double, cloud_cover double")
    assert [r[0] for r in index.scene_filter(s, (1, 1, 2, 2), "2024-01-01", "2024-12-31", 40).collect()] == [dt.date(2024, 1, 1)]
    hourly = spark.createDataFrame([(dt.date(2024, 1, 1), h, 1.0 if h % 2 else None) for h in range(24)] + [(dt.date(2024, 1, 2), 1, 1.0)], "day date, h int, value double").withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
    assert moisture.complete_day_totals(hourly, 12).count() == 1
    areas = spark.createDataFrame([(1, 1.0e6)], "basin_id int, area_m2 double")
    m = spark.createDataFrame([(dt.date(2024, 3, 10), 1, 25.4, 0.5)], "report_date date, basin_id int, mean double, cover_frac double")
    r = series.day_records(m, m.select("report_date", "basin_id", F.lit(23).alias("n_hours")), areas).first()
    assert (r["precip_in"], r["volume_m3"], r["n_hours_expected"], r["volume_flux_m3s"]) == (1.0, 25400.0, 23, round(25400 / 23 / 3600, 4))
