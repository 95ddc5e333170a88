import pytest

from kinetrace.plans.queries import ORACLES, QUERIES, first_of, with_any
from tests.compare import same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, data, duck, name):
    same(QUERIES[name](spark, data), duck.execute(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_filters_reach_the_scan(spark, data):
    plan = QUERIES["filter_labelled"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(value)" in plan or "GreaterThanOrEqual(value" in plan
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string,value:double>" in plan


def test_flagship_shuffles(spark, data):
    plan = QUERIES["rule_timeline"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3 and "Python" not in plan


def _shuffled(spark, df):
    """Rows that all shuffles of a query write, joins not being broadcast."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm

    def stages():
        sc.listenerBus().waitUntilEmpty()
        seen = sc.statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(seen.apply(k).stageId(), seen.apply(k).attemptId()): seen.apply(k).shuffleWriteRecords() for k in range(seen.size())}

    before = stages()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df.write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return sum(n for k, n in stages().items() if k not in before)


def test_event_windows_travel_whole(spark, data):
    """samples, events and blocks are shuffled once each, not a row for each sample of each window."""
    n = spark.read.parquet(f"{data}/events.parquet").count()
    assert n <= _shuffled(spark, QUERIES["event_windows"](spark, data)) < 2 * n


def test_windows_cover_recordings(spark, data):
    n = {r.user_id: r["count"] for r in QUERIES["relative_time"](spark, data).groupBy("user_id").count().collect()}
    want = {(u, k) for u, c in n.items() if c >= 32 for k in range((c - 32) // 16 + 1)}
    assert len(want) > len({u for u, _ in want})
    assert {(r.user_id, r.window_id) for r in QUERIES["sliding_dominant_freq"](spark, data).collect()} == want
    got = {(r.user_id, r.window_id) for r in QUERIES["rf_classify"](spark, data).collect()}
    assert got == {w for w in want if w[0] in {u for u, _ in got}} and any(k for _, k in got)


def test_flags_are_computed(spark):
    s = spark.createDataFrame([(1, 0, 1, 0.0, "a"), (2, 0, 2, 1.0, "a"), (3, 0, 3, None, "a"), (None, 0, 4, 2.0, "a")], "user_id long, us long, seq long, x double, label string")
    assert {r.user_id: r.any for r in with_any(s).collect()} == {1: False, 2: True, 3: None, None: True}
    e = spark.createDataFrame([(1, 1, None), (2, 2, "2020-01-01")], "user_id long, event_id long, ts string")
    assert {r.user_id: r.has for r in first_of(e).collect()} == {1: False, 2: True}
