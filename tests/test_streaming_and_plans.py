import datetime as dt

from pyspark.sql import functions as F
from stratalog.operators import find
from stratalog.plans.audit import audit
from stratalog.sources.model import Model
from stratalog.streaming import use_events

SF = "/root/testdata/sf0.001"


def write(spark, folder, rows):
    at = dt.datetime(2024, 1, 1)
    data = [(i, at + dt.timedelta(minutes=m), s, t, "e", 1) for i, m, s, t in rows]
    spark.createDataFrame(data, use_events.EVENTS).coalesce(1).write.mode("append").parquet(str(folder))


def drain(stream, name, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return stream.sparkSession.table(name).collect()


def test_events_once_and_window_counts(spark, tmp_path):
    folder = tmp_path / "events"
    write(spark, folder, [(1, 0, "s", "entity_queried"), (1, 0, "s", "entity_queried"), (2, 10, "s", "entity_queried")])
    write(spark, folder, [(2, 10, "s", "entity_queried"), (3, 500, "s", "context_supplied")])
    events = use_events.read(spark, str(folder), 1)
    assert sorted(r.event_id for r in drain(use_events.once(events), "once_events", tmp_path)) == [1, 2, 3]
    got = drain(use_events.counts(use_events.once(events)), "counted_events", tmp_path)
    assert [(r.use_type, r.n) for r in got] == [("entity_queried", 2)]  # the last window is still open


def test_session_states(spark, tmp_path):
    folder = tmp_path / "events"
    write(spark, folder, [(1, 0, "a", "context_supplied"), (2, 1, "a", "entity_queried"), (3, 2, "b", "reasoning_use_reported"), (4, 3, "a", "artifact_changed"), (5, 4, "a", "reasoning_use_reported")])
    got = drain(use_events.session_states(use_events.read(spark, str(folder)).withWatermark("ts", "1 hour")), "session_rows", tmp_path, "update")
    assert {("a", "completed", 4), ("b", "created", 1)} <= {(r.session_id, r.state, r.n) for r in got}


def test_reconcile_hands_over_once(spark, tmp_path):
    folder, seen = tmp_path / "events", []
    write(spark, folder, [(1, 0, "a", "x"), (2, 0, "a", "x")])
    run = lambda: use_events.reconcile(use_events.read(spark, str(folder)), lambda df, n: seen.append((n, df.count())), str(tmp_path / "cp")).awaitTermination(120)
    assert run() and seen == [(0, 2)]
    write(spark, folder, [(3, 0, "a", "x")])
    assert run() and seen == [(0, 2), (1, 1)]
    assert run() and len(seen) == 2


def test_filters_and_columns_reach_the_scan(spark):
    got = audit(spark.read.parquet(f"{SF}/lineitem.parquet").where("l_linenumber = 1").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")))
    assert got.scanned == (("l_suppkey", "l_linenumber"),) and "EqualTo(l_linenumber,1)" in got.pushed and got.shuffles == 1 and got.python == 0


def test_lookups_have_no_cross_join_and_one_shuffle_a_group(spark):
    m = Model(spark, SF)
    assert audit(find.find_page(m.symbols().withColumn("kind", F.lit("k")), find.matches("a"), 10, "g", "q")).cartesian == 0
    assert audit(find.latest(m.table("events"), "user_id", ["ts", "event_id"], "event_type")).shuffles == 1


def test_api_gives_frames(spark):
    from stratalog import api

    m = api.open_model(spark, SF)
    page = api.find(m, "r", limit=5).collect()
    assert len(page) == 5 and page[0].truncated
    after = api.find(m, "r", limit=5, cursor=page[0].next_cursor).collect()
    assert min(r.path for r in after) > max(r.path for r in page)
    assert api.trace(m, "part:40", depth=1).count() > 0 and api.impact(m, "part:5").count() > 0 and api.inspect(m, page[0].path).count() > 0
    assert api.history(m, 3).count() == 3 and api.ancestry(m).count() > 0


def plain_sessions(events, idle_ms, end_ms):
    """States, counts and expiry of sessions whose events all came, by the same moves."""
    from stratalog.streaming import stateful_sessions as st

    out, seen = {}, set()
    for event_id, at, session, kind in sorted(events, key=lambda e: (e[1], e[0])):
        if (session, event_id) in seen:
            continue
        seen.add((session, event_id))
        name, n, refused, last = out.get(session, ("new", 0, 0, 0))
        to = st.MOVES.get(name, {}).get(kind)
        out[session] = (to or name, n + bool(to), refused + (not to), max(last, at))
    return {s: ("expired" if name not in st.FINAL and last + idle_ms <= end_ms else name, n, refused, last) for s, (name, n, refused, last) in out.items()}


def test_sessions_as_state_replay(spark, tmp_path):
    """A replay of events in several batches, some of them twice, gives states, counts and expiry of one pass over all."""
    import datetime

    import pyarrow.parquet as pq
    from pyspark.sql import functions as F
    from stratalog.streaming import stateful_sessions as st

    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    kinds = {"view": "context_supplied", "click": "entity_queried", "purchase": "exact_source_requested", "signup": "reasoning_use_reported"}
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in kinds.items() for x in p]), F.col("event_type")), F.lit("artifact_changed"))
    rows = source.select("event_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"), F.concat_ws("|", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("session_id"), kind.alias("use_type"))
    rows = rows.orderBy("ts", "event_id").toPandas()
    folder, cut = tmp_path / "in", len(rows) // 4
    folder.mkdir()
    import pyarrow as pa

    for i in range(4):  # each file also brings the last rows of the one before again
        part = rows.iloc[max(0, i * cut - 20) : (i + 1) * cut if i < 3 else len(rows)]
        pq.write_table(pa.Table.from_pandas(part, preserve_index=False).set_column(1, "ts", pa.array(part["ts"].dt.tz_localize("UTC"), pa.timestamp("us", "UTC"))), folder / f"{i}.parquet")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    st.use_state_store(spark)
    try:
        stream = spark.readStream.schema("event_id long, ts timestamp, session_id string, use_type string").option("maxFilesPerTrigger", 1).parquet(str(folder))
        out = str(tmp_path / "out")
        query = st.sessions(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda df, i: df.write.mode("append").parquet(out)).trigger(availableNow=True).start()
        query.awaitTermination(600)
        assert query.exception() is None
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {r.session_id: (r.state, r.events, r.refused, int(r.last.replace(tzinfo=datetime.UTC).timestamp() * 1000)) for r in st.last_rows(spark.read.parquet(out)).collect()}
    events = [(r.event_id, int(r.ts.timestamp() * 1000), r.session_id, r.use_type) for r in rows.itertuples()]
    end = max(e[1] for e in events) - 3_600_000
    want = plain_sessions(events, st.IDLE_MS, end)
    assert {s: w[1:] for s, w in want.items()} == {s: g[1:] for s, g in got.items()}
    assert want == got and {"expired", "completed"} <= {w[0] for w in want.values()}
