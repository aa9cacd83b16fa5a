"""Timers over many batches of unordered files, with a stop between them."""

import datetime
import random

import pytest

from weftline.streaming import timers


@pytest.fixture(scope="module")
def events():
    """Over a hundred hours, an event every few minutes; half of all events are one organisation's."""
    rng = random.Random(11)
    start = datetime.datetime(2026, 5, 1)
    made = [(i, 1 if i % 2 else rng.randint(2, 6), start + datetime.timedelta(seconds=rng.randint(0, 360_000))) for i in range(1500)]
    return sorted(made, key=lambda r: r[2])


def expected(events, minutes):
    span, by, out = datetime.timedelta(minutes=minutes), {}, {}
    for i, org, at in sorted(events, key=lambda r: (r[2], r[0])):
        by.setdefault(org, []).append((i, at))
    for rows in by.values():
        for (i, at), following in zip(rows, [*rows[1:], None], strict=True):
            free = following is not None and following[1] <= at + span
            out[i] = ("released" if free else "expired", following[1] if free else at + span)
    return out


def test_unordered_batches_and_a_restart(spark, events, tmp_path):
    for k, v in timers.PROVIDER.items():
        spark.conf.set(k, v)
    rng = random.Random(2)
    # files overlap in time by less than the delay, and each file is shuffled
    pieces = [events[i : i + 250] for i in range(0, 1500, 250)]
    for a, b in zip(pieces, pieces[1:], strict=False):
        a[-3:], b[:3] = b[:3], a[-3:]
    delay = "12 hours"
    schema = "id long, org_id long, at timestamp"

    def put(n):
        rng.shuffle(pieces[n])
        spark.createDataFrame(pieces[n], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = timers.holds(source, 10, delay).writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out"))
        q = out.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        return [p["batchId"] for p in q.recentProgress if p["numInputRows"]]

    for n in range(3):
        put(n)
    first = run()
    told = spark.read.parquet(str(tmp_path / "out")).count()
    for n in range(3, 6):
        put(n)
    second = run()
    assert len(first) >= 2 and len(first) + len(second) >= 6 and told > 0
    got = [(r.id, (r.outcome, r.ends)) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    want = expected(events, 10)
    assert len(got) == len(dict(got)) > told and all(want[i] == x for i, x in got)
    passed = max(at for _, _, at in events) - datetime.timedelta(hours=12, minutes=1)
    missing = {i for i, (_, ends) in want.items() if ends < passed} - dict(got).keys()
    assert not missing


def test_a_table_of_several_files_loses_no_event(spark, sf_dir, tmp_path):
    """Files of one piece of time are in no order: taken one by one, the first one made the older events of the others late."""
    from weftline.plans.streams import stream_timers

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    some = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = {tuple(r) for r in stream_timers(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", some)
    held = expected([(r.event_id, r.user_id, r.ts) for r in events.collect()], 10)
    passed = max(r.ts for r in events.collect()) - datetime.timedelta(hours=1, milliseconds=1)
    assert got == {(i, outcome, f"{ends:%Y-%m-%d %H:%M:%S.%f}"[:-3]) for i, (outcome, ends) in held.items() if ends <= passed}
