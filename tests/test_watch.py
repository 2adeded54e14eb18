"""The watched source and expiring entries, replayed batch by batch, against the batch rules."""

import json
import random
from datetime import datetime, timedelta, timezone

import pyarrow.parquet as pq
import pytest
from codexa.streaming import progress, watch

EVENT = "key string, ord long, at timestamp, stamp long, asks boolean, ttl long, response string"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, watch.ROCKS)
    yield spark
    spark.conf.unset(name)


def events(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at = START + timedelta(hours=i * 40 / n, seconds=rng.randint(0, 3) * 0)
        asks = rng.random() < 0.5
        key = rng.choice(["search|1", "search|2", "view|1", "other|1"])
        ttl = None if key.startswith("other") else (24 if key.startswith("search") else 12) * 3_600_000_000
        rows.append((key, i, at, int(at.timestamp() * 1_000_000), asks, ttl, None if asks else f"r{i}"))
    return rows


def pages(spark, folder, rows, per_page=20, first=1):
    return watch.write_pages(spark.createDataFrame(rows, EVENT), folder, ["stamp", "ord"], per_page, first)


def run(stream, sink, place):
    """Processes what there is, as a new start would."""
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{place}/checkpoint").start()
    try:
        q.processAllAvailable()
        return len(q.recentProgress)
    finally:
        q.stop()


def test_pages_are_read_once_in_bounded_batches(spark, tmp_path):
    folder, place = str(tmp_path / "server"), str(tmp_path / "at")
    rows = events(200)
    following = pages(spark, folder, rows[:120])
    assert following > 5
    stream = watch.watch(spark, folder, spark.createDataFrame([], EVENT).schema, "stamp", 2)
    seen: list = []

    def sink(batch, number):
        batch.write.mode("overwrite").parquet(f"{place}/batch={number}")
        seen.append((number, batch.count()))

    run(stream, sink, place)
    assert max(n for _, n in seen) <= 60 and sum(n for _, n in seen) == 120
    # A late page: its number comes before one that is there already, so the latter waits.
    pages(spark, folder, rows[160:], 40, following + 1)
    before = len(seen)
    run(stream, sink, place)
    assert sum(n for _, n in seen[before:]) == 0
    pages(spark, folder, rows[120:160], 40, following)
    run(watch.watch(spark, folder, spark.createDataFrame([], EVENT).schema, "stamp", 2), sink, place)
    got = spark.read.parquet(*[f"{place}/batch={n}" for n, _ in {s for s in seen}])
    assert sorted(r["ord"] for r in got.collect()) == list(range(200))
    ends = [json.loads(open(f"{place}/checkpoint/offsets/{n}").read().splitlines()[2]) for n, k in seen if k]
    assert ends == sorted(ends, key=lambda e: e["page"]) and ends[-1]["updated"] > ends[0]["updated"] > "17"


def test_repeated_batch_and_restart_equal_the_newest_rows(spark, tmp_path):
    folder, place = str(tmp_path / "server"), str(tmp_path / "at")
    rows = events(150, 2)
    pages(spark, folder, rows, 15)
    schema = spark.createDataFrame([], EVENT).schema
    failed = []

    def sink(batch, number):
        new = progress.latest(batch, "key", "stamp", "ord", ["ord", "response"])
        if older := [v for v in progress._versions(spark, place) if v < number]:
            new = progress.merge(spark.read.parquet(f"{place}/version={older[-1]}"), new, "key", "stamp", ["ord", "response"]).drop("pulled")
        new.write.mode("overwrite").parquet(f"{place}/version={number}")
        if number == 1 and not failed:
            failed.append(number)
            raise RuntimeError("the sink is lost after it has written")

    with pytest.raises(Exception, match="lost"):
        run(watch.watch(spark, folder, schema, "stamp", 3), sink, place)
    run(watch.watch(spark, folder, schema, "stamp", 3), sink, place)
    got = spark.read.parquet(f"{place}/version={progress._versions(spark, place)[-1]}")
    want = progress.latest(spark.createDataFrame(rows, EVENT), "key", "stamp", "ord", ["ord", "response"])
    assert failed and sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def expected(rows):
    held, out = {}, {}
    for key, ord_, _, stamp, asks, ttl, response in sorted(rows, key=lambda r: (r[3], r[4], r[1])):
        if asks:
            entry = held.get(key)
            live = entry is not None and (entry[1] is None or stamp <= entry[0] + entry[1])
            out[ord_] = (live, entry[2] if live else None)
        else:
            held[key] = (stamp, ttl, response)
    return out


def test_expiring_state_equals_the_batch_rule(rocks, tmp_path):
    spark, folder, place = rocks, str(tmp_path / "server"), str(tmp_path / "at")
    rows = events(60, 3)
    # Two keys fall silent: asked within their time, at its last instant, and after it.
    t0 = rows[-1][3] + 1_000_000
    for i, (key, hours) in enumerate((("search|9", 24), ("view|9", 12), ("other|9", None))):
        ttl = None if hours is None else hours * 3_600_000_000
        for j, (after, asks) in enumerate(((0, False), (12 * 3_600_000_000, True), (12 * 3_600_000_000 + 1, True), (24 * 3_600_000_000, True), (24 * 3_600_000_000 + 1, True))):
            rows.append((key, 1000 + 10 * i + j, datetime.fromtimestamp((t0 + after) / 1e6, timezone.utc), t0 + after, asks, ttl, None if asks else key))
    rows.sort(key=lambda r: r[3])
    pages(spark, folder, rows, 12)
    schema = spark.createDataFrame([], EVENT).schema

    def sink(batch, number):
        batch.write.mode("overwrite").parquet(f"{place}/batch={number}")

    half = watch.expiring(watch.watch(spark, folder, schema, "stamp", 1))
    q = half.writeStream.foreachBatch(sink).option("checkpointLocation", f"{place}/checkpoint").start()
    while not [p for p in q.recentProgress if p["batchId"] >= 2]:
        q.awaitTermination(1)
    q.stop()
    batches = run(watch.expiring(watch.watch(spark, folder, schema, "stamp", 1)), sink, place)
    got = spark.read.parquet(f"{place}/batch=*").collect()
    assert batches and {r["ord"]: (r["hit"], r["response"]) for r in got} == expected(rows) and len(got) == len(expected(rows))
    at_once = watch.answered(spark.createDataFrame(rows, EVENT)).collect()
    assert {r["ord"]: (r["hit"], r["response"]) for r in at_once} == expected(rows)


def test_pages_hold_ordered_rows(spark, tmp_path):
    folder = str(tmp_path / "server")
    n = pages(spark, folder, events(90), 30)
    stamps = [pq.read_table(f"{folder}/page-{i:09d}.parquet").column("stamp").to_pylist() for i in range(1, n)]
    flat = [x for p in stamps for x in p]
    assert flat == sorted(flat) and len(flat) == 90


def test_reader_far_behind_catches_up_in_few_batches(spark, tmp_path):
    """Every page once, in order; batches double as far as they may, where each would take one page."""
    folder, place = str(tmp_path / "server"), str(tmp_path / "at")
    rows = events(330, 5)
    n = pages(spark, folder, rows, 10) - 1
    schema, seen = spark.createDataFrame([], EVENT).schema, []
    run(watch.watch(spark, folder, schema, "stamp", 1, catch_up=8), lambda batch, number: seen.append([r["ord"] for r in batch.select("ord").collect()]), place)
    ends = [json.loads(open(f"{place}/checkpoint/offsets/{i}").read().splitlines()[2])["page"] for i in range(len(seen))]
    assert ends[:5] == [1, 2, 4, 8, 16] and ends[-1] == n and len(ends) <= 5 + -(-(n - 16) // 8)
    assert sorted(x for own in seen for x in own) == list(range(330))


def test_state_is_read_and_written_once_a_batch():
    """A key's rows cost no trip to the state store each."""
    calls = []

    class Entry:
        held = None

        def exists(self):
            calls.append("exists")
            return self.held is not None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, value):
            calls.append("update")
            self.held = value

        def clear(self):
            calls.append("clear")
            self.held = None

    class Handle:
        def getValueState(self, *_):
            return Entry()

        def registerTimer(self, at):
            calls.append("timer")

    state = watch.Expiring()
    state.init(Handle())
    rows = [dict(zip(("key", "ord", "at", "stamp", "asks", "ttl", "response"), r)) for r in events(400, 6) if r[0] == "search|1"]
    want = expected([tuple(r.values()) for r in rows])
    got = []
    for at in range(0, len(rows), 40):
        calls.clear()
        got += state.handleInputRows(("search|1",), iter(rows[at : at + 40]), None)
        assert len(calls) <= 4
    assert {r["ord"]: (r["hit"], r["response"]) for r in got} == want


def test_state_has_no_more_partitions_than_cores(rocks, tmp_path, monkeypatch):
    spark, name, seen = rocks, "spark.sql.shuffle.partitions", []
    before = spark.conf.get(name)
    monkeypatch.setattr(watch, "drain", lambda writer: seen.append(int(spark.conf.get(name))))
    spark.conf.set(name, "200")
    try:
        rows = watch.watch(spark, str(tmp_path), spark.createDataFrame([], EVENT).schema, "stamp")
        (tmp_path / "answers" / "batch=0").mkdir(parents=True)
        watch.run_expiring(rows, str(tmp_path))
        assert seen == [spark.sparkContext.defaultParallelism] and spark.conf.get(name) == "200"
    finally:
        spark.conf.set(name, before)
