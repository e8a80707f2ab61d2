from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from scoreline import TELCO
from scoreline.sources import records
from scoreline.sources.store import Store
from scoreline.streaming import flows
from tests.test_streaming import event, fixed


def write_file(folder, name, values):
    folder.mkdir(exist_ok=True)
    lines = [json.dumps({"key": str(i), "value": v}) for i, v in enumerate(values)]
    (folder / name).write_text("\n\n".join(lines) + "\n")  # blank lines are no records


def values_of(window):
    return sorted((r.partition.rsplit("/", 1)[-1], r.offset, r.value) for r in window.rows.collect())


def test_offsets_do_not_depend_on_how_files_are_split(spark, tmp_path):
    folder = tmp_path / "topic"
    write_file(folder, "a b%20.json", [f"v{i}" * 7 for i in range(400)])
    write_file(folder, "c[1].json", ["x"])
    files = [f"file:{folder}/a b%20.json", f"file:{folder}/c[1].json"]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    seen = []
    for size in ("128m", "700b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = records.numbered(spark, files)
            assert size != "700b" or rows.select("value").rdd.getNumPartitions() > 1
            seen.append(sorted((r.offset, json.loads(r.value)["key"]) for r in rows.collect()))
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert seen[0] == seen[1] == sorted([(i, str(i)) for i in range(400)] + [(0, "0")])


def test_windows_end_inside_files_and_go_on_there(spark, tmp_path):
    folder = tmp_path / "topic"
    write_file(folder, "1 +a%20[b].json", [f"a{i}" for i in range(5)])
    write_file(folder, "2.json", [])
    write_file(folder, "3.json", [f"b{i}" for i in range(4)])

    def topic():
        return records.Topic(spark, str(folder), str(tmp_path / "position"))

    first = topic().next(3)
    assert first.size == 3 and [v for *_, v in values_of(first)] == ["a0", "a1", "a2"]
    again = topic().next(99)  # not committed: the same window, whatever is asked for
    assert (again.id, values_of(again)) == (first.id, values_of(first))
    topic().commit(again)
    second = topic().next(4)
    assert [v for *_, v in values_of(second)] == ["a3", "a4", "b0", "b1"]
    topic().commit(second)
    write_file(folder, "4.json", ["c0"])
    third = topic().next()
    assert [v for *_, v in values_of(third)] == ["b2", "b3", "c0"] and third.rows.where("timestamp is null").count() == 0
    topic().commit(third)
    assert topic().next(5) is None and topic().next() is None
    with pytest.raises(ValueError, match="positive"):
        topic().next(0)


def test_scoring_in_windows_gives_every_record_once(spark, tmp_path):
    folder, out = tmp_path / "topic", str(tmp_path / "out")
    write_file(folder, "1.json", [json.dumps(event(i)) for i in range(5)] + ["garbage"])
    write_file(folder, "2.json", [json.dumps(event(i)) for i in range(5, 9)])
    topic = records.Topic(spark, str(folder), str(tmp_path / "position"))
    assert flows.score_records(topic, TELCO, fixed(0.7), out, max_records=4, dry_run=True) == 4
    sizes = []
    while n := flows.score_records(topic, TELCO, fixed(0.7), out, max_records=4):
        sizes.append(n)
    assert sizes == [4, 4, 2]
    scored = flows.read_output(spark, out, "predictions")
    assert sorted(r.customerID for r in scored.collect()) == [f"line-{i:04d}" for i in range(9)]
    dead = flows.read_output(spark, out, "dead_letters").first()
    assert (dead.original, dead.offset) == ("garbage", 5) and dead.partition.endswith("1.json") and dead.timestamp


def test_a_run_that_ends_before_its_commit_repeats_its_window(spark, tmp_path, monkeypatch):
    folder, out = tmp_path / "topic", str(tmp_path / "out")
    write_file(folder, "1.json", [json.dumps(event(i)) for i in range(6)])
    topic = records.Topic(spark, str(folder), str(tmp_path / "position"))
    with monkeypatch.context() as m:
        m.setattr(records.Topic, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            flows.score_records(topic, TELCO, fixed(0.7), out, max_records=4)
    while flows.score_records(topic, TELCO, fixed(0.7), out, max_records=4):
        pass
    totals = flows.read_output(spark, out, "counters").agg(F.sum("consumed")).first()[0]
    assert totals == 6 and flows.read_output(spark, out, "predictions").count() == 6


def test_ingest_takes_the_last_by_place(spark, tmp_path):
    message = {"customerID": "a", "prediction": "No", "processed_ts": "2024-01-01T00:00:00Z"}
    folder = tmp_path / "topic"
    write_file(folder, "1.json", [json.dumps({**message, "churn_probability": i / 100}) for i in range(50)] + ["junk"])
    for parts in ("128m", "900b"):  # however the file is split
        spark.conf.set("spark.sql.files.maxPartitionBytes", parts)
        try:
            store = Store(spark, str(tmp_path / f"store-{parts}"))
            topic = records.Topic(spark, str(folder), str(tmp_path / f"position-{parts}"))
            assert flows.ingest_records(topic, store, str(tmp_path / f"bad-{parts}")) == 51
            assert [r.churn_probability for r in store.read("predictions").collect()] == [0.49]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_the_consumed_topic_has_more_files_as_it_grows_and_the_same_counts(spark, tmp_path, monkeypatch):
    from scoreline.plans import catalog

    made = iter(range(100))
    monkeypatch.setattr(catalog, "fresh_dir", lambda spark, name: f"file:{tmp_path}/{name}-{next(made)}")
    whole = sorted(catalog.consume_records(spark, "/root/testdata/sf0.001").collect())
    monkeypatch.setattr(catalog, "TOPIC_RECORDS_PER_FILE", 100)
    small = sorted(catalog.consume_records(spark, "/root/testdata/sf0.001").collect())
    assert small == whole and sum(r.n for r in whole) == 1000
    sizes = [len([x for x in f.read_text().split("\n") if x.strip()]) for f in (tmp_path / "consume-1" / "topic").glob("part-*")]
    assert sum(sizes) == 1000 and len(sizes) > 5 and max(sizes) < 300  # not two files of about 500
