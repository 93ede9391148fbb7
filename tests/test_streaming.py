from datetime import datetime, timedelta

from pyspark.sql import functions as F

from phasorlake.operators import replicate
from phasorlake.streaming import state

T0 = datetime(2024, 1, 1)


def stream(spark, tmp_path, batches, schema):
    """A file stream that reads the batches one by one."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def drain(df, tmp_path, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def test_op_log_is_idempotent(spark, tmp_path):
    schema = "peer int, counter int, container string, value double, at timestamp"
    ops = [(p, c, "k", float(c), at(c)) for p in (1, 2) for c in range(5)]
    s = stream(spark, tmp_path, [ops[:6], ops[3:], ops], schema)
    got = drain(state.op_log(s, "at", "1 day"), tmp_path, "oplog", "append")
    assert sorted((r.peer, r.counter) for r in got) == sorted((p, c) for p, c, *_ in ops)
    df = spark.createDataFrame(ops, schema)
    trim = spark.createDataFrame([(1, 2)], "peer int, counter int")
    assert sorted(r.counter for r in state.late(df, trim).collect()) == [0, 1]


def test_windows_and_sessions(spark, tmp_path):
    schema = "peer int, at timestamp"
    rows = [[(1, at(0)), (1, at(1)), (2, at(3))], [(1, at(30)), (1, at(31))], [(9, at(500))]]
    s = stream(spark, tmp_path, rows, schema)
    got = drain(state.strokes(s, "at", "1 minute", "10 minutes", "peer"), tmp_path, "strokes", "append")
    assert sorted((r.peer, r.n) for r in got if r.peer != 9) == [(1, 2), (1, 2), (2, 1)]
    tiles = drain(state.sliding(s, "at", "1 minute", "20 minutes", "10 minutes", ["peer"]), tmp_path, "tiles", "append")
    batch = spark.createDataFrame([r for b in rows for r in b], schema).groupBy(F.window("at", "20 minutes", "10 minutes").start.alias("start"), "peer").count()
    want = sorted((r.start, r.peer, r["count"]) for r in batch.collect() if r.peer != 9)
    assert sorted((r.start, r.peer, r.n) for r in tiles if r.peer != 9) == want


def test_observed_remove_equals_batch(spark, tmp_path):
    schema = "name string, op string, item string"
    ops = [("s", "add", "1.0/0"), ("s", "add", "1.0/1"), ("s", "remove", "1.0/0"), ("s", "remove", "1.0/9"), ("s", "add", "1.0/2"), ("s", "remove", "1.0/0"), ("s", "add", "1.0/9"), ("t", "add", "2.0/0")]
    want = {}
    adds, gone = {(n, i) for n, o, i in ops if o == "add"}, {(n, i) for n, o, i in ops if o == "remove"}
    for n, i in adds - gone:
        want[n] = want.get(n, 0) + 1
    for k, order in enumerate((ops, ops[::-1])):
        s = stream(spark, tmp_path / str(k), [order[:3], order[3:6], order[6:]], schema)
        got = {}
        for r in drain(state.observed_remove(s), tmp_path, f"orset{k}", "update"):
            got[r.name, r.item] = r.live
        assert {n: sum(live for (m, _), live in got.items() if m == n) for n in want} == want


def test_running_bundle_retracts(spark, tmp_path):
    s = stream(spark, tmp_path, [[("a", 2.0, 1)], [("a", 3.0, 1), ("a", 2.0, -1)]], "k string, v double, w int")
    assert drain(state.running_bundle(s, ["k"], "v", "w"), tmp_path, "bundle", "update")[-1].v == 3.0


def test_killed_runs(spark, tmp_path):
    a = stream(spark, tmp_path / "a", [[("x", at(0)), ("y", at(1))], [("z", at(900))], [("q", at(2000))]], "run string, at timestamp")
    b = stream(spark, tmp_path / "b", [[("x", at(5))], [("n", at(900))], [("m", at(2000))]], "run string, at timestamp")
    got = {r.run: r.ended for r in drain(state.killed_runs(a, b, "1 minute", "60 minutes"), tmp_path, "killed", "append")}
    assert got["x"] == at(5) and got["y"] is None


def test_batch_log_operators(spark):
    log = spark.createDataFrame([(1, 1, "k", 1.0), (1, 2, "k", 4.0), (2, 1, "k", 2.0), (2, 2, "j", None)], "peer int, counter int, c string, value double")
    assert {r.c: r.value for r in replicate.merged(log, ["c"], "value").collect()}["k"] == 6
    assert {r.c: r.value for r in replicate.merged(log, ["c"], "value", "owner").collect()}["k"] == 4
    v = replicate.version(log)
    assert replicate.updates_since(log, v).count() == 0
    assert replicate.refuse_stale(v, spark.createDataFrame([(1, 2)], "peer int, counter int")).count() == 2
    import pytest

    with pytest.raises(Exception, match="trim"):
        replicate.refuse_stale(v, spark.createDataFrame([(1, 9)], "peer int, counter int")).count()
    a, b = replicate.state_digest(log, ["peer", "counter"]).first(), replicate.state_digest(log.orderBy(F.desc("counter")), ["peer", "counter"]).first()
    assert a == b
