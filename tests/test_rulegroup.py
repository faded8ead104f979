"""The rule engine: order, shared nodes, alert states as a series."""
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from metrilake import MetricFrame
from metrilake import api as A
from metrilake.frame import TS, VALUE
from metrilake.plans import rulegroup as G
from metrilake.plans.rulegroup import Alert, DictSource, Record, RuleGroup, run_group, run_groups

MIN = 60_000


def family(spark, data, labels=("namespace", "pod")):
    df = spark.createDataFrame(data, ", ".join([f"{l} string" for l in labels] + ["ts long", "value double"]))
    return lambda: MetricFrame(df, tuple(labels))


@pytest.fixture()
def source(spark):
    rows = [(ns, f"p{i}", t * MIN, float(i + t)) for ns in ("a", "b") for i in range(3) for t in range(10)]
    bad = [("a", "p0", t * MIN, 1.0) for t in range(2, 8)]
    return DictSource({"x": family(spark, rows), "down": family(spark, bad)})


def points(mf):
    return sorted((tuple(r[l] for l in mf.labels), r[TS], r[VALUE]) for r in mf.df.collect())


def total(c):
    return A.aggregate(c.sel("x"), "sum", by=["namespace"])


@pytest.mark.parametrize("write", [False, True])
def test_rules_run_in_the_order_of_what_they_read(spark, source, write):
    rules = [Record("double", lambda c: A.scalar_op(c.sel("total"), "*", 2)), Record("total", total),
             Alert("High", lambda c: A.where_value(c.sel("double"), ">", 20), "2m", {"severity": "info"})]
    res = run_group(spark, RuleGroup("g", "1m", rules), source, 0, 9 * MIN, write=write)
    got = {(r["__name__"], r["namespace"], r[TS]): r[VALUE] for r in res.records.df.collect()}
    assert len(got) == 40 and all(got["double", ns, t * MIN] == 2 * got["total", ns, t * MIN] == 2 * (3 + 3 * t) for ns in "ab" for t in range(10))
    assert {(r["namespace"], r[TS] // MIN, r["state"]) for r in res.alerts.collect()} == {
        (ns, t, "firing" if t >= 5 else "pending") for ns in "ab" for t in range(3, 10)}


def test_a_circle_of_rules_is_refused(spark, source):
    rules = [Record("p", lambda c: c.sel("q")), Record("q", lambda c: c.sel("p"))]
    with pytest.raises(ValueError, match="circle"):
        run_group(spark, RuleGroup("g", "1m", rules), source, 0, MIN)


def test_what_several_rules_share_is_written_once(spark, source, monkeypatch):
    names = []
    kept = G.written
    monkeypatch.setattr(G, "written", lambda spark, mf, name: names.append(name) or kept(spark, mf, name))
    pods = lambda c: c.shared("pods", lambda c: A.aggregate(c.sel("x"), "count", by=["namespace"]))
    rules = [Record("t1", total), Record("t2", total), Record("n1", pods), Record("n2", lambda c: A.scalar_op(pods(c), "+", 1)),
             Record("once", lambda c: A.rate(c.raw("down"), "2m", c.grid)), Record("reads", lambda c: c.sel("t1"))]
    res = run_group(spark, RuleGroup("g", "1m", rules), source, 0, 9 * MIN)
    assert sorted(names) == ["pods", "t1", "x"]       # the instant vector of x, the pods on it, the record that a rule reads
    n = {r["__name__"]: r["count"] for r in res.records.df.groupBy("__name__").count().collect()}
    assert n == {"t1": 20, "t2": 20, "n1": 20, "n2": 20, "once": 6, "reads": 20}


def test_alert_states_are_a_series_of_their_own(spark, source):
    """Rules that read ALERTS come after those that do not, whatever their place and group; their own states are not among them."""
    info = Alert("Quiet", lambda c: A.where_value(total(c), ">", 5), "0s", {"severity": "info"})
    loud = Alert("Loud", lambda c: A.where_value(c.sel("down"), "==", 1), "2m", {"severity": "critical"})
    inhibit = Alert("Inhibitor", lambda c: A.set_unless(c.sel("ALERTS", eq={"severity": "info"}), c.sel("ALERTS", eq={"alertstate": "firing", "severity": "critical"}), on=["namespace"]),
                    "0s", {"severity": "none"})
    count = Record("alerts", lambda c: A.aggregate(c.sel("ALERTS"), "count", by=["alertname"]))
    res = run_groups(spark, [RuleGroup("second", "1m", [count, inhibit]), RuleGroup("first", "1m", [info, loud])], source, 0, 9 * MIN)
    got = {(r["namespace"], r[TS] // MIN) for r in res["second"].alerts.collect()}
    # down in a from 2 to 7 and, by the lookback, to 9; firing from 4 on
    assert got == {("b", t) for t in range(1, 10)} | {("a", t) for t in range(1, 4)}
    n = {(r["alertname"], r[TS] // MIN): r[VALUE] for r in res["second"].records.df.collect()}
    assert n == {("Quiet", t): 2.0 for t in range(1, 10)} | {("Loud", t): 1.0 for t in range(2, 10)}


def test_unknown_metrics_and_groups_of_other_intervals(spark, source):
    every = RuleGroup("slow", "4m", [Record("slow", total)])
    reads = RuleGroup("fast", "1m", [Record("seen", lambda c: c.sel("slow")), Record("none", lambda c: A.aggregate(c.sel("no_such", eq={"k": "v"}), "sum", by=["k"]))])
    res = run_groups(spark, [reads, every], source, 0, 9 * MIN)
    got = {(r["namespace"], r[TS] // MIN): r[VALUE] for r in res["fast"].records.df.collect()}
    assert got == {(ns, t): 3.0 + 3 * (t // 4 * 4) for ns in "ab" for t in range(10)}       # a lookback of 5m sees the last record


def test_large_groups_stay_small_plans(spark):
    import __spark_entry__ as E
    for name in ("r_k8s", "r_kubernetes_apps"):
        plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") < 60, name


def test_the_info_inhibitor_fires(spark):
    import __spark_entry__ as E
    got = E.queries()["r_general_alerts"](spark, "/root/testdata/sf0.01").filter(F.col("alertname") == "InfoInhibitor")
    assert got.count() > 0 and got.filter("namespace = ''").count() == 0
