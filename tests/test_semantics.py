"""Hand-computed vectors and metamorphic checks for the trickier semantics."""
import hashlib
import math

import pytest
from pyspark.sql import functions as F

from conftest import SF_MED, rows
from metrilake import Grid, MetricFrame
from metrilake import api as A
from metrilake.frame import TS, VALUE, duration_ms


def mf_of(spark, data, labels=("job",)):
    cols = list(labels) + [TS, VALUE]
    df = spark.createDataFrame(data, ", ".join([f"{l} string" for l in labels] + ["ts long", "value double"]))
    return MetricFrame(df.select(*cols), tuple(labels))


def values(mf):
    return sorted((tuple(r[l] for l in mf.labels), r[TS], r[VALUE]) for r in mf.df.collect())


def test_rate_exact_coverage(spark):
    # samples every 15s cover the whole 60s window: no extrapolation beyond the edges
    m = mf_of(spark, [("a", t * 1000, float(t)) for t in range(0, 61, 15)])
    g = Grid.instant(60_000)
    (_, t, v), = values(A.rate(m, "60s", g))
    assert t == 60_000 and v == pytest.approx(1.0)
    (_, _, inc), = values(A.increase(m, "60s", g))
    assert inc == pytest.approx(60.0)


def test_rate_counter_reset_and_extrapolation(spark):
    # 10, 20, reset to 5, 15 at 10s steps inside a 60s window ending at 60s
    m = mf_of(spark, [("a", 20_000, 10.0), ("a", 30_000, 20.0), ("a", 40_000, 5.0), ("a", 50_000, 15.0)])
    g = Grid.instant(60_000)
    (_, _, inc), = values(A.increase(m, "60s", g))
    # raw increase 15 - 10 + 20 = 25 over 30s sampled; avg gap 10s, threshold 11s:
    # start gap 20s > 11 → +5s; end gap 10s < 11 → +10s; zero point 30*10/25 = 12s ≥ 5s
    assert inc == pytest.approx(25 * (30 + 5 + 10) / 30)
    (_, _, ir), = values(A.irate(m, "60s", g))
    assert ir == pytest.approx(10 / 10)


def test_rate_needs_two_samples(spark):
    m = mf_of(spark, [("a", 10_000, 1.0)])
    assert values(A.rate(m, "60s", Grid.instant(60_000))) == []


def test_instant_lookback_is_left_open(spark):
    m = mf_of(spark, [("a", 0, 1.0), ("a", 60_000, 2.0)])
    g = Grid.range(0, 360_000, "1m")
    got = {t: v for _, t, v in values(A.instant(m, g, "5m"))}
    assert got[60_000] == 2.0 and got[300_000] == 2.0 and 360_000 not in got


def test_histogram_quantile_edges(spark):
    data = [("1", 0, 0.0), ("2", 0, 5.0), ("+Inf", 0, 10.0)]
    m = mf_of(spark, data, labels=("le",))
    (_, _, med), = values(A.histogram_quantile(m, 0.5))
    assert med == pytest.approx(2.0)
    (_, _, p25), = values(A.histogram_quantile(m, 0.25))
    assert p25 == pytest.approx(1.5)
    (_, _, p90), = values(A.histogram_quantile(m, 0.9))
    assert p90 == pytest.approx(2.0)           # rank in the +Inf bucket → largest finite bound
    no_inf = mf_of(spark, [("1", 0, 1.0), ("2", 0, 2.0)], labels=("le",))
    (_, _, nan), = values(A.histogram_quantile(no_inf, 0.5))
    assert math.isnan(nan)
    # equal bounds merged ("1" and "1.0"), counts made monotone: [4, 4, 8];
    # rank 4 is reached in the first bucket → 1.0, rank 6 interpolates in +Inf → 2
    odd = mf_of(spark, [("1", 0, 4.0), ("1.0", 0, 0.0), ("2", 0, 3.0), ("+Inf", 0, 8.0)], labels=("le",))
    (_, _, v), = values(A.histogram_quantile(odd, 0.5))
    assert v == pytest.approx(1.0)
    (_, _, v), = values(A.histogram_quantile(odd, 0.75))
    assert v == pytest.approx(2.0)


def test_division_by_zero_gives_ieee(spark):
    m = mf_of(spark, [("a", 0, 1.0), ("b", 0, 0.0), ("c", 0, -2.0)])
    got = {l[0]: v for l, _, v in values(A.scalar_op(m, "/", 0))}
    assert got["a"] == math.inf and got["c"] == -math.inf and math.isnan(got["b"])


def test_comparisons_with_nan_are_false(spark):
    m = mf_of(spark, [("a", 0, float("nan")), ("b", 0, 5.0)])
    assert [l for l, _, _ in values(A.where_value(m, ">", 1))] == [("b",)]


def test_or_vector0_label_trap(spark):
    g = Grid.range(0, 120_000, "1m")
    m = mf_of(spark, [("x", 0, 3.0)], labels=("cluster",))
    got = values(A.default_zero(m, g))
    # vector(0) has no labels: its element never matches the labelled one, so the
    # label-less 0 is added at every time, next to the labelled series too
    assert (("x",), 0, 3.0) in got and (("",), 0, 0.0) in got
    assert (("",), 60_000, 0.0) in got and (("",), 120_000, 0.0) in got and len(got) == 4


def test_absent_only_where_missing(spark):
    g = Grid.range(0, 120_000, "1m")
    m = mf_of(spark, [("x", 60_000, 3.0)])
    got = values(A.absent(m, g, {"job": "x"}))
    assert [t for _, t, _ in got] == [0, 120_000]


def test_topk_ties_broken_by_labels(spark):
    m = mf_of(spark, [("b", 0, 1.0), ("a", 0, 1.0), ("c", 0, 0.5)])
    assert values(A.topk(m, 1)) == [(("a",), 0, 1.0)]
    assert [l for l, _, _ in values(A.topk(m, 2))] == [("a",), ("b",)]


def test_absent_label_matches_empty(spark):
    m = mf_of(spark, [("a", 0, 1.0)])
    assert len(values(A.select(m, re={"cluster": "prod|"}))) == 1
    assert len(values(A.select(m, eq={"cluster": "prod"}))) == 0


def test_group_left_duplicate_one_side_raises(spark):
    many = mf_of(spark, [("a", "1", 0, 1.0)], labels=("ns", "pod"))
    one = mf_of(spark, [("a", "n1", 0, 1.0), ("a", "n2", 0, 1.0)], labels=("ns", "node"))
    with pytest.raises(Exception):
        A.binop(many, one, "*", on=["ns"], group_left=["node"]).df.collect()


def test_metamorphic_increase_is_rate_times_range(spark):
    from metrilake.sources import tables as T
    c = T.m_counter_reset(spark, SF_MED)
    g = Grid.range("2024-01-05", "2024-01-10", "12h")
    r = {(l, t): v for l, t, v in values(A.rate(c, "1d", g))}
    i = {(l, t): v for l, t, v in values(A.increase(c, "1d", g))}
    assert r.keys() == i.keys() and r
    for k in r:
        assert i[k] == pytest.approx(r[k] * 86400)


def test_metamorphic_and_unless_partition_left(spark):
    from metrilake.sources import tables as T
    g = Grid.range("2024-01-05", "2024-01-10", "12h")
    left = A.instant(T.m_gauge(spark, SF_MED), g, "1d")
    right = A.where_value(A.instant(T.m_state(spark, SF_MED), g, "1d"), "==", 0)
    a = values(A.set_and(left, right, on=["user_id"]))
    u = values(A.set_unless(left, right, on=["user_id"]))
    assert sorted(a + u) == values(left)


def test_metamorphic_downsample_sum_equals_raw(spark):
    from metrilake.operators.upkeep import downsample
    from metrilake.sources import tables as T
    g = T.m_gauge(spark, SF_MED)
    ds = downsample(g, "1h", counter=False)
    raw = g.df.agg(F.sum(VALUE)).first()[0]
    assert ds.agg(F.sum("sum")).first()[0] == pytest.approx(raw)
    assert ds.agg(F.sum("count")).first()[0] == g.df.count()


def test_hashmod_matches_md5(spark):
    from metrilake.operators.relabel import hash_mod
    s = "10.0.3.17:9003"
    want = int.from_bytes(hashlib.md5(s.encode()).digest()[8:], "big") % 7
    got = spark.range(1).select(hash_mod(F.lit(s), 7).alias("h")).first()["h"]
    assert got == want


def test_relabel_replace_labelmap(spark):
    from metrilake.operators import relabel as R
    df = spark.createDataFrame([({"__address__": "10.0.0.1:80", "port": "9000", "__meta_x_label_app": "web"},)],
                               "labels map<string,string>")
    out = R.relabel(df, [R.Replace(["__address__", "port"], "__address__", r"([^:]+)(?::\d+)?;(\d+)", "$1:$2"),
                         R.LabelMap("__meta_x_label_(.+)"), R.Replace(["missing"], "gone", "(.+)")]).first()["labels"]
    assert out["__address__"] == "10.0.0.1:9000" and out["app"] == "web" and "gone" not in out


def test_graphite_templates(spark):
    from metrilake.plans.configs import GRAPHITE_TEMPLATES
    from metrilake.sources.graphite import read_graphite
    lines = spark.createDataFrame([("u.app-1.1.jvm.heap.used 5 1704067200",),
                                   ("u.app-1.driver.spark.streaming.q1.lat 7 1704067200",),
                                   ("u.shuffleService.open 1 1704067200",),
                                   ("bad line",)], "value string")
    got = {r["measurement"]: r for r in read_graphite(lines, GRAPHITE_TEMPLATES).collect()}
    assert set(got) == {"heap.used", "lat", "open"}
    assert got["heap.used"]["namespace"] == "jvm" and got["heap.used"]["process"] == "1"
    assert got["lat"]["namespace"] == "spark.streaming" and got["lat"]["id"] == "q1"
    assert got["open"]["namespace"] == "shuffleService" and got["open"]["ts"] == 1704067200000


def test_exposition_parsing(spark):
    from metrilake.sources.exposition import read_exposition
    lines = spark.createDataFrame([("# HELP x y",), ('x_total{a="1",b="q\\"x"} 3.5 1000',), ("up 1",),
                                   ("bad{",)], "value string")
    got = read_exposition(lines, scrape_ts=5).collect()
    d = {r["labels"]["__name__"]: r for r in got}
    assert d["x_total"]["labels"]["b"] == 'q"x' and d["x_total"]["ts"] == 1000 and d["up"]["ts"] == 5


@pytest.mark.parametrize("x", [0.000123456, 0.1, 1.0, 12.5, 123.456, 99999.0, 1234567.0, -0.5, 3.14159e-7])
def test_go_g_matches_c_printf(spark, x):
    from metrilake.functions.humanize import go_g
    got = spark.range(1).select(go_g(F.lit(x), 4).alias("s")).first()["s"]
    assert got == "%.4g" % x


@pytest.mark.parametrize("x,want", [(0.5, "500ms"), (1.5, "1.5s"), (90, "1m 30s"), (3700, "1h 1m 40s"),
                                    (90061, "1d 1h 1m 1s"), (0, "0s")])
def test_humanize_duration(spark, x, want):
    from metrilake.functions.humanize import humanize_duration
    assert spark.range(1).select(humanize_duration(F.lit(float(x))).alias("s")).first()["s"] == want


@pytest.mark.parametrize("x,want", [(1234.0, "1.234k"), (0.001, "1m"), (5e9, "5G"), (0.5, "500m"), (12.0, "12")])
def test_humanize_si(spark, x, want):
    from metrilake.functions.humanize import humanize
    assert spark.range(1).select(humanize(F.lit(x)).alias("s")).first()["s"] == want


def test_hold_for_islands(spark):
    from metrilake.operators.alerts import alert, hold
    g = Grid.range(0, 600_000, "1m")
    # true at minutes 0-3 and 5-9: the gap at 4 restarts the hold
    m = mf_of(spark, [("a", t * 60_000, 1.0) for t in (0, 1, 2, 3, 5, 6, 7, 8, 9)])
    h = {r[TS] // 60_000: (r["state"], r["active_at"] // 60_000) for r in hold(alert(m, "A"), "2m", g).collect()}
    assert h[1] == ("pending", 0) and h[2] == ("firing", 0) and h[5] == ("pending", 5) and h[7] == ("firing", 5)


def test_inhibition(spark):
    from metrilake.operators.alerts import inhibit
    from metrilake.plans.configs import INHIBIT_RULES
    rows_ = [("A", "ns1", "critical", 0, "firing"), ("A", "ns1", "warning", 0, "firing"),
             ("A", "ns2", "warning", 0, "firing"), ("B", "ns1", "info", 0, "firing"),
             ("InfoInhibitor", "ns1", "none", 0, "firing"), ("C", "ns3", "info", 0, "firing")]
    df = spark.createDataFrame(rows_, "alertname string, namespace string, severity string, ts long, state string")
    left = {(r["alertname"], r["namespace"], r["severity"]) for r in inhibit(df, INHIBIT_RULES, [
        "alertname", "namespace", "severity"]).collect()}
    assert ("A", "ns1", "warning") not in left and ("B", "ns1", "info") not in left
    assert ("A", "ns2", "warning") in left and ("C", "ns3", "info") in left and ("A", "ns1", "critical") in left


# ---------------------------------------------------------------- interval join
def _brute_annotate(samples, intervals):
    return sorted((s[0], s[1], i[1], i[2]) for s in samples for i in intervals
                  if s[0] == i[0] and i[2] <= s[1] <= i[3])


@pytest.mark.parametrize("bucket_ms,fanout", [(1, 64), (7, 64), (1000, 64), (None, 64), (1, 4), (3, 2)])
def test_annotate_matches_brute_force(spark, bucket_ms, fanout):
    """Heavy-tailed durations (0 … 4000 ms) over several duration tiers."""
    import random
    rnd_ = random.Random((bucket_ms or 0) * 10 + fanout)
    samples = [(rnd_.choice("ab"), rnd_.randrange(0, 5000)) for _ in range(300)]
    samples += samples[:5]                     # exact duplicate samples stay separate rows
    intervals = []
    for k in range(40):
        s = rnd_.randrange(0, 5000)
        intervals.append((rnd_.choice("ab"), f"iv{k}", s, s + rnd_.choice([0, 1, 50, 999, 1000, 4000])))
    sdf = spark.createDataFrame(samples, "app string, ts long")
    idf = spark.createDataFrame(intervals, "app string, name string, start_ts long, end_ts long")
    got = A.annotate(sdf, idf, on=["app"], bucket_ms=bucket_ms, fanout=fanout)
    assert sorted((r["app"], r["ts"], r["name"], r["start_ts"]) for r in got.collect()) == \
        _brute_annotate(samples, intervals)
    # left: every sample once per containing interval, or once with NULLs when none contains it
    left = A.annotate(sdf, idf, on=["app"], bucket_ms=bucket_ms, fanout=fanout, how="left")
    want = _brute_annotate(samples, intervals)
    hit = {(a, t) for a, t, _, _ in want}
    want += [(a, t, None, None) for a, t in samples if (a, t) not in hit]
    assert sorted((r["app"], r["ts"], r["name"], r["start_ts"]) for r in left.collect()) == \
        sorted(want, key=lambda x: (x[0], x[1], x[2] or "", x[3] or -1))


def test_annotate_bounds_inclusive_and_left(spark):
    sdf = spark.createDataFrame([("a", 10), ("a", 20), ("a", 21), ("b", 15)], "app string, ts long")
    idf = spark.createDataFrame([("a", "j", 10, 20)], "app string, name string, start_ts long, end_ts long")
    got = {(r["app"], r["ts"]): r["name"] for r in A.annotate(sdf, idf, on=["app"], bucket_ms=5, how="left").collect()}
    assert got == {("a", 10): "j", ("a", 20): "j", ("a", 21): None, ("b", 15): None}


# ---------------------------------------------------------------- histogram mean
def test_histogram_avg_is_mean_of_observations(spark):
    # observations of 2.0 every 10s: _sum grows 2 per step, _count 1 per step → mean 2
    s = mf_of(spark, [("a", t * 10_000, 2.0 * t) for t in range(7)])
    c = mf_of(spark, [("a", t * 10_000, 1.0 * t) for t in range(7)])
    (_, t, v), = values(A.histogram_avg(s, c, "60s", Grid.instant(60_000), by=["job"]))
    assert t == 60_000 and v == pytest.approx(2.0)


# ---------------------------------------------------------------- streaming notification grouping
def test_group_stream_over_several_batches(spark, tmp_path):
    """Events split into four time-ordered files, one per micro-batch: the watermark advances
    batch by batch, slots close on later batches or timers; the result equals the one-batch
    run's oracle."""
    import duckdb
    from metrilake.operators import alerts as AL
    from metrilake.plans import catalog_stream as CS, configs as C
    from metrilake.streaming import stream as X
    from metrilake.sources import tables as T
    ev = T.table(spark, SF_MED, "events")
    bounds = ["2024-01-01", "2024-01-08", "2024-01-15", "2024-01-22", "2024-02-01"]
    for i in range(4):
        ev.filter((F.col("ts") >= bounds[i]) & (F.col("ts") < bounds[i + 1])).coalesce(1) \
          .write.parquet(str(tmp_path / f"part{i}"))
        # one file per trigger, in time order
        import glob
        import shutil
        f, = glob.glob(str(tmp_path / f"part{i}" / "*.parquet"))
        shutil.copy(f, str(tmp_path / f"events_{i}.parquet"))
    s = (spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1)
         .option("pathGlobFilter", "events_*.parquet").parquet(str(tmp_path)))
    s = X.with_event_time(s.select("event_type", F.col("user_id").cast("string").alias("user_id"),
                                   F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"),
                                                    F.col("ts").cast("timestamp_ntz")).alias("ts"), "value"))
    s = X.with_delay(s.filter(F.col("value") > 100), "30m")
    s = s.select(F.lit("HighValue").alias("alertname"), F.lit("info").alias("severity"),
                 F.concat(F.lit("ns-"), (F.col("user_id").cast("bigint") % 5).cast("string")).alias("namespace"),
                 "user_id", "event_type", "ts", X.EVENT_TIME)
    g = X.group_notifications_stream(AL.route(s, C.ROUTE), ["user_id", "event_type"], "6h", "1d", "30s")
    got = rows(X.run_to_table(spark, g, "x7-test"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF_MED}/events.parquet')")
    want = con.execute(CS.SQL["x7_group_stream"]).df()
    want = sorted(tuple(r[c] for c in sorted(want.columns)) for r in want.to_dict("records"))
    assert len(got) == len(want) > 0
    assert got == want


def _plain(fn, pts, t, r):
    """A range function over the samples [(ts, v)] of one series, straight from its definition; None where it has no value."""
    w = sorted(((ts, v) for ts, v in pts if t - r <= ts <= t), key=lambda p: (p[0], math.isnan(p[1]), p[1]))
    if not w:
        return None
    real = [v for _, v in w if not math.isnan(v)]
    pairs = list(zip(w, w[1:]))
    (ft, fv), (lt, lv) = w[0], w[-1]
    if fn in ("min_over_time", "max_over_time"):
        return (min if fn[1] == "i" else max)(real) if real else math.nan
    if fn == "avg_over_time":
        return sum(v for _, v in w) / len(w)
    if fn == "last_over_time":
        return lv
    if fn == "changes":
        return float(sum(a[1] != b[1] for a, b in pairs))
    if fn == "irate":
        if len(w) < 2 or w[-2][0] == lt:
            return None
        return (lv if lv < w[-2][1] else lv - w[-2][1]) / ((lt - w[-2][0]) / 1000)
    if fn in ("deriv", "predict_linear"):
        if len({ts for ts, _ in w}) < 2:
            return None
        n, mx, my = len(w), sum(ts for ts, _ in w) / len(w), sum(v for _, v in w) / len(w)
        slope = sum((ts - mx) * (v - my) for ts, v in w) / sum((ts - mx) ** 2 for ts, _ in w) * 1000
        return slope if fn == "deriv" else my + slope * ((t - mx) / 1000 + 100)
    if len(w) < 2 or lt == ft:
        return None
    delta = lv - fv + sum(a[1] for a, b in pairs if b[1] < a[1])
    sampled, start, end = (lt - ft) / 1000, (ft - t + r) / 1000, (t - lt) / 1000
    gap = sampled / (len(w) - 1)
    if delta > 0 and fv >= 0:
        start = min(start, sampled * fv / delta)
    ext = sampled + (start if start < gap * 1.1 else gap / 2) + (end if end < gap * 1.1 else gap / 2)
    return delta * ext / sampled / (r / 1000 if fn == "rate" else 1)


RANGE_FNS = ["rate", "increase", "irate", "changes", "avg_over_time", "min_over_time", "max_over_time", "last_over_time", "deriv", "predict_linear"]


@pytest.mark.parametrize("rng,step,end", [("60s", "20s", 600_000), ("70s", "30s", 600_000), ("7s", "1m", 600_000),
                                          ("90s", "10s", 3_000_000), ("5m", None, 450_000), ("1001ms", None, 300_000)])
def test_range_functions_on_ties_nan_resets_and_gaps(spark, rng, step, end):
    """Dense, sparse and NaN series, samples on the edges of slots and at equal times, long gaps, one series a hundred times another's size."""
    import random
    rnd = random.Random(11)
    data = [(job, rnd.randrange(0, 60) * 10_000, float(rnd.choice([rnd.randrange(50), rnd.randrange(50), float("nan")]) if job == "c" else rnd.randrange(50)))
            for job in "abc" for _ in range(120)]
    data += [("gap", t, float(t % 7)) for t in (0, 40_000, 90_000, 2_000_000, 2_000_500, 2_900_000)] + [("one", 300_000, 5.0)]
    data += [("tick", t, 1e6 + t / 1000) for t in range(0, 600_000, 777)]
    m = mf_of(spark, data)
    g = Grid.range(0, end, step) if step else Grid.instant(end)
    r = duration_ms(rng)
    for name in RANGE_FNS:
        nan_ok = name.endswith("_over_time")
        src = m if nan_ok else m.with_df(m.df.filter("job <> 'c'"))
        extra = (100.0,) if name == "predict_linear" else ()
        got = {(job, t): v for (job,), t, v in values(getattr(A, name)(src, rng, g, *extra))}
        want = {(job, t): _plain(name, [p[1:] for p in data if p[0] == job], t, r) for job in {d[0] for d in data} if nan_ok or job != "c" for t in g.times()}
        want = {k: v for k, v in want.items() if v is not None}
        if name in ("deriv", "predict_linear"):     # all samples of the window at one time: no line
            got = {k: v for k, v in got.items() if v is not None}
        assert got.keys() == want.keys(), name
        for k, v in want.items():
            assert (math.isnan(v) and math.isnan(got[k])) or got[k] == pytest.approx(v, rel=1e-7, abs=1e-9), (name, k)


def test_regression_keeps_its_digits_on_large_values(spark):
    """A slope of one in a thousand on values near 1e12, at epoch times."""
    base = 1_700_000_000_000
    m = mf_of(spark, [("a", base + i * 1000, 1e12 + i / 1024) for i in range(0, 7200, 60)])
    g = Grid.range(base + 3_600_000, base + 7_200_000, "10m")
    for _, _, v in values(A.deriv(m, "30m", g)):
        assert v == pytest.approx(1 / 1024, rel=1e-6)


def test_a_sample_is_shuffled_once_by_range_functions(spark):
    """No exchange reads what a generator made of the samples: only slots are doubled; windows are cut and filled in behind the last exchange."""
    import re
    m = mf_of(spark, [("a", i * 1000, float(i)) for i in range(100)])
    g = Grid.range(0, 99_000, "1s")
    for fn in (A.rate, A.irate, A.changes, A.deriv, A.avg_over_time):
        plan = fn(m, "60s", g).df._jdf.queryExecution().optimizedPlan().toString()
        assert len(re.findall(r"Generate explode\(sequence", plan)) == 1 and len(re.findall(r"Generate explode", plan)) <= 3
        above = plan.split("Generate explode(sequence")[0]
        assert "Aggregate" not in above and "Window" not in above and "Join" not in above


@pytest.mark.parametrize("lookback,step,end", [("60s", "20s", 600_000), ("5m", "1m", 3_000_000), ("10s", "1m", 600_000), ("5m", None, 450_000), ("61s", "20s", 600_000)])
def test_instant_selection_matches_its_definition(spark, lookback, step, end):
    import random
    rnd = random.Random(5)
    data = [(job, rnd.randrange(-30, 60) * 10_000 + rnd.choice([0, 0, 1, 9999]), float(rnd.randrange(50))) for job in "ab" for _ in range(60)] + [("c", 0, 1.0), ("c", 2_000_000, 2.0)]
    g = Grid.range(0, end, step) if step else Grid.instant(end)
    lb = duration_ms(lookback)
    want = {}
    for job in "abc":
        for t in g.times():
            w = [p[1:] for p in data if p[0] == job and t - lb < p[1] <= t]
            if w:
                want[job, t] = max(w)[1]
    assert {(j, t): v for (j,), t, v in values(A.instant(mf_of(spark, data), g, lookback))} == want


def test_long_grids_have_no_cap(spark):
    g = Grid.range("2024-01-01", "2024-01-31", "3m")
    assert g.n == 14_401 and g.df(spark).count() == 14_401


def test_one_to_one_rejects_duplicates_on_either_side(spark):
    one = mf_of(spark, [("a", 0, 1.0)])
    two = mf_of(spark, [("a", "x", 0, 1.0), ("a", "y", 0, 2.0)], labels=("job", "pod"))
    for l, r in ((one, two), (two, one)):
        with pytest.raises(Exception, match="duplicate series"):
            A.binop(l, r, "+", on=["job"]).df.collect()
    assert len(values(A.binop(two, one, "+", on=["job"], group_left=[]))) == 2


def test_notification_slot_counts_an_instance_once(spark):
    from metrilake.operators.alerts import group_notifications
    rows_ = [("r", "g", "A", 0, "firing"), ("r", "g", "A", 60_000, "firing"), ("r", "g", "B", 300_000, "firing"), ("r", "g", "B", 360_000, "firing")]
    d = spark.createDataFrame(rows_, "receiver string, group_key string, alertname string, ts long, state string")
    got = sorted((r.notify_ts, r.alerts, r.kind) for r in group_notifications(d, ["alertname"], "5m", "12h").collect())
    assert got == [(0, 1, "update"), (300_000, 1, "update")]


def test_downsample_and_compaction_prefer_numbers_to_nan(spark):
    from metrilake.operators import upkeep as U
    m = mf_of(spark, [("a", 0, float("nan")), ("a", 1000, 3.0), ("a", 2000, 5.0)])
    r = U.downsample(m, "5m", counter=False).first()
    assert (r["min"], r["max"]) == (3.0, 5.0)
    blocks = m.with_df(m.df.unionByName(mf_of(spark, [("a", 0, 1.0), ("a", 1000, 2.0)]).df))
    assert values(U.compact(blocks)) == [(("a",), 0, 1.0), (("a",), 1000, 3.0), (("a",), 2000, 5.0)]


def test_target_labels_over_an_exported_label(spark):
    from metrilake.operators.relabel import attach_target_labels
    d = spark.createDataFrame([({"x": "1", "exported_x": "0", "y": "2"},)], "labels map<string,string>")
    got = attach_target_labels(d, F.create_map(F.lit("x"), F.lit("t")), honor=False).first().labels
    assert got == {"x": "t", "exported_x": "1", "y": "2"}


def test_list_variables_match_their_values_only(spark):
    from metrilake.operators.select import bind
    m = mf_of(spark, [("10.0.0.1:9100", 0, 1.0), ("10a0b0c1:9100", 0, 2.0), ("b", 0, 3.0)])
    b = bind({"job": ["10.0.0.1:9100", "b"]})
    assert [k for k, _, _ in values(A.select(m, **b))] == [("10.0.0.1:9100",), ("b",)]


def test_a_replayed_batch_leaves_the_store_unchanged(spark, tmp_path):
    from metrilake.sources import store, topic
    m = mf_of(spark, [("a", 0, 1.0), ("a", 60_000, 2.0)])
    topic.to_records(store.to_samples(m, metric="x")).write.text(str(tmp_path / "topic"))
    for checkpoint in ("c1", "c2"):  # a lost checkpoint runs batch 0 again
        src = spark.readStream.schema("value string").text(str(tmp_path / "topic"))
        topic.write_samples_stream(topic.read_metric_topic(spark, source=src), str(tmp_path / "store"), str(tmp_path / checkpoint)).awaitTermination()
    assert store.read_samples(spark, str(tmp_path / "store"), "x").count() == 2


def test_numbered_rows_follow_the_order(spark):
    from metrilake.operators.sort import numbered, table_order
    d = spark.range(500).selectExpr("id", "id * 7919 % 500 as v").repartition(7)
    got = {r.v: r.row for r in numbered(d, table_order([("v", True)])).collect()}
    assert got == {v: 500 - v for v in range(500)}


def test_stream_windows_hold_their_right_edge(spark, tmp_path):
    from metrilake.streaming import stream as X
    data = [("a", 0, 5.0), ("a", 60_000, 9.0), ("a", 90_000, 2.0), ("a", 120_000, 3.0)]
    mf_of(spark, data).df.write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("job string, ts long, value double").parquet(str(tmp_path / "in"))
    s = X.with_delay(X.with_event_time(src), "30m")
    got = X.run_to_table(spark, X.stream_eval(s, ["job"], "1m"), "edge1", "update", ["job", "eval_ts"])
    assert sorted((r.eval_ts, r["last"], r.samples) for r in got.collect()) == [(0, 5.0, 1), (60_000, 9.0, 1), (120_000, 3.0, 2)]
    # samples out of order in later batches, and one that moves the watermark past the windows
    day = 86_400_000      # a stream's first watermark is the epoch
    rows_ = [(i, job, day + t, v) for i, (job, t, v) in enumerate(data + [("a", 30_000, 7.0), ("b", 130_000, 1.0), ("a", 7_200_000, 1.0)])]
    later = spark.createDataFrame(rows_, "arrival long, job string, ts long, value double")
    s = X.with_delay(X.with_event_time(X.replayed(spark, later, "arrival", 3, "edge2").drop("arrival")), "30m")
    got = X.run_to_table(spark, X.stream_range(s, ["job"], "1m", "1m"), "edge2")
    # [60s, 120s] holds 9, 2 and 3: 3 - 9 and the 9 that the reset took away; the window of the last sample is still open
    assert {(r.job, r.eval_ts - day): (r.samples, r.delta, r.increase) for r in got.collect()} == {
        ("a", 0): (1, 0.0, 0.0), ("a", 60_000): (3, 4.0, 4.0), ("a", 120_000): (3, -6.0, 3.0), ("a", 180_000): (1, 0.0, 0.0), ("b", 180_000): (1, 0.0, 0.0)}


def test_a_replayed_stream_ends_with_its_last_windows(spark):
    from metrilake.streaming import stream as X
    day = 86_400_000
    df = spark.createDataFrame([("a", day + t, v) for t, v in [(0, 5.0), (60_000, 9.0), (90_000, 2.0)]] + [("b", day + 90_000, 1.0)], "job string, ts long, value double")
    s = X.with_delay(X.with_event_time(X.replayed(spark, df, "ts", 2, "end", end=120_000 + 1_800_000)), "30m")
    got = X.run_to_table(spark, X.stream_range(s, ["job"], "1m", "1m"), "end")
    assert {(r.job, r.eval_ts - day): (r.samples, r.min, r.max, r.increase) for r in got.collect()} == {
        ("a", 0): (1, 5.0, 5.0, 0.0), ("a", 60_000): (2, 5.0, 9.0, 4.0), ("a", 120_000): (2, 2.0, 9.0, 2.0), ("b", 120_000): (1, 1.0, 1.0, 0.0)}


def test_streaming_hold_of_instances_that_share_a_group(spark, monkeypatch):
    import random
    from metrilake.streaming import stream as X
    monkeypatch.setattr(X, "HOLD_GROUPS", 2)
    monkeypatch.setattr(X, "ROWS_A_FILE", 50)          # batches of several files
    monkeypatch.setattr(X, "ROWS_A_TASK", 20)
    rnd, day = random.Random(6), 86_400_000
    data = [(rnd.choice(["u", "v", "w", None]), rnd.choice("xy"), day + t * 60_000, rnd.choice([True, True, False, None])) for t in rnd.sample(range(2000), 800)]
    df = spark.createDataFrame(data, "user_id string, job string, ts long, active boolean")
    s = X.with_delay(X.with_event_time(X.replayed(spark, df, "ts", 4, "hold-groups")), "1m")
    got = X.run_to_table(spark, X.hold_stream(s, ["user_id", "job"], "8m", "10m"), "hold-groups")
    want, runs = set(), {}
    for u, j, t, on in sorted(data, key=lambda x: x[2]):
        since, last = runs.get((u, j), (None, t))
        since = None if not on else t if since is None or t - last > 600_000 else since
        runs[u, j] = since, t
        if on:
            want.add((u, j, t, "firing" if t - since >= 480_000 else "pending", since))
    got = [(r.user_id, r.job, r.ts, r.state, r.active_at) for r in got.collect()]
    assert len(got) == len(want) and set(got) == want


def test_streaming_hold_and_late_split_over_batches(spark):
    import random
    from metrilake.streaming import stream as X
    day = 86_400_000
    rows_ = [(i, "u", day + t * 60_000, a) for i, (t, a) in enumerate([(0, True), (1, True), (2, True), (3, False), (4, True), (5, True), (9, True), (10, True), (11, True)])]
    df = spark.createDataFrame(rows_, "n long, user_id string, ts long, active boolean")
    s = X.with_delay(X.with_event_time(X.replayed(spark, df, "n", 4, "hold-test").drop("n")), "1m")
    got = X.run_to_table(spark, X.hold_stream(s, ["user_id"], "2m", "3m"), "hold-test")
    assert sorted(((r.ts - day) // 60_000, r.state, (r.active_at - day) // 60_000) for r in got.collect()) == [
        (0, "pending", 0), (1, "pending", 0), (2, "firing", 0), (4, "pending", 4), (5, "pending", 4), (9, "pending", 9), (10, "pending", 9), (11, "firing", 9)]
    rnd = random.Random(4)
    rows_ = [(i, rnd.choice("ab"), rnd.randrange(1000), float(i)) for i in range(300)]
    df = spark.createDataFrame(rows_, "n long, job string, ts long, value double")
    got = X.split_late_to_table(spark, X.replayed(spark, df, "n", 5, "late-test"), ["job"], "n", "late-test", block=7)
    newest, want = {}, {}
    for n, job, ts, _ in rows_:
        want[n] = ts < newest.get(job, -1)
        newest[job] = max(ts, newest.get(job, -1))
    assert {r.n: r.out_of_order for r in got.collect()} == want


def test_calendar_intervals(spark):
    import datetime as dt
    from metrilake.operators.alerts import in_interval
    days = [dt.datetime(y, 1, 1, h) + dt.timedelta(days=i) for y in (2023, 2024) for i in range(366) for h in (3, 21)]
    df = spark.createDataFrame([(int(d.replace(tzinfo=dt.timezone.utc).timestamp() * 1000),) for d in days], "ms long")

    def last(d):
        return (d.replace(day=28) + dt.timedelta(days=4)).replace(day=1) - dt.timedelta(days=1)
    cases = [({"days_of_month": [-1]}, lambda d: d.date() == last(d).date()),
             ({"days_of_month": [(29, 31)], "months": [2]}, lambda d: (d.month, d.day) == (2, 29)),
             ({"days_of_month": [(-40, 2), (-3, -2)]}, lambda d: d.day <= 2 or last(d).day - d.day in (1, 2)),
             ({"days_of_month": [(30, -1)]}, lambda d: d.day >= 30),
             ({"weekdays": [0, (5, 6)], "years": [2023], "times": [("20:30", "24:00")]}, lambda d: d.weekday() in (0, 5, 6) and d.year == 2023 and d.hour == 21),
             ({"months": [(11, 12), 3]}, lambda d: d.month in (3, 11, 12)), ({}, lambda d: True)]
    for interval, want in cases:
        got = {r.ms for r in df.filter(in_interval(F.timestamp_millis("ms"), interval)).collect()}
        assert got == {int(d.replace(tzinfo=dt.timezone.utc).timestamp() * 1000) for d in days if want(d)}, interval
    with pytest.raises(ValueError, match="from 1"):
        in_interval(F.timestamp_millis("ms"), {"days_of_month": [0]})


def test_labelmap_rewrites_each_name_once(spark):
    import contextlib
    import io
    from metrilake.operators import relabel as R
    df = spark.sql("""SELECT 1 AS id, map('a_x', '1', 'b', '2', 'b_x', '3', 'x', 'old', 'c', '4') AS labels UNION ALL SELECT 2, map('c', '5') UNION ALL SELECT 3, NULL""")
    d = R.relabel(df, [R.LabelMap("(?:a|b)_(.+)")])
    assert {r.id: r.labels for r in d.collect()} == {1: {"a_x": "1", "b": "2", "b_x": "3", "c": "4", "x": "3"}, 2: {"c": "5"}, 3: None}
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        d.explain("extended")
    assert plan.getvalue().split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0].lower().count("regexp_replace(") == 3     # once in each SELECT


def test_queries_cut_shuffles_finely(spark):
    import __spark_entry__ as E
    from conftest import SF_SMALL
    E.queries()["w6_changes"](spark, SF_SMALL)
    assert int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) >= 960
    assert spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count().rdd.getNumPartitions() < 960     # and join small ones again


def test_shared_slots_give_the_windows_of_each_range(spark):
    import random
    from metrilake.operators import slots
    from metrilake.plans.k8s_metrics import bucket_counter
    rnd, g = random.Random(8), Grid.range(0, 600_000, "1m")
    mf = mf_of(spark, [(rnd.choice("ab"), rnd.randrange(-20, 41) * 15_000 + rnd.choice([0, 0, 1, 7000]), float(rnd.randrange(9))) for _ in range(150)])
    shared = slots.slot_frame(mf, g, 15_000, {"first", "last", "drops"})
    for rng in ("2m", "5m", "1h"):
        assert rows(A.rate(shared, rng, g).df) == rows(A.rate(mf, rng, g).df)
    d = spark.createDataFrame([("a", 1, 10, 0.2), ("a", 2, 20, 3.0), ("a", 3, 90_000, 0.7), ("b", 4, 20, None)], "job string, event_id long, ts long, v double")
    got = {(r.job, r.le, r.ts): r.value for r in bucket_counter(d, ["job"], F.col("v"), ["0.5", "1", "+Inf"]).df.collect()}
    assert got == {("a", "0.5", 10): 1, ("a", "1", 10): 1, ("a", "+Inf", 10): 1, ("a", "0.5", 20): 1, ("a", "1", 20): 1, ("a", "+Inf", 20): 2,
                   ("a", "0.5", 90_000): 1, ("a", "1", 90_000): 2, ("a", "+Inf", 90_000): 3, ("b", "0.5", 20): 0, ("b", "1", 20): 0, ("b", "+Inf", 20): 0}
