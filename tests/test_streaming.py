from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from scoreline import TELCO
from scoreline.operators import models
from scoreline.sources import sinks, tables
from scoreline.sources.store import Store
from scoreline.streaming import events, flows
from tests.test_clean import raw_row


def event(i: int = 1, **changes) -> dict:
    row = raw_row(i, TotalCharges=12.5, Contract="Month-to-month", SeniorCitizen=0, tenure=i, MonthlyCharges=29.85)
    row["event_ts"] = "2024-01-01T00:00:00Z"
    row.update(changes)
    return row


def without(row: dict, *names: str) -> dict:
    return {k: v for k, v in row.items() if k not in names}


def keyed(spark, values):
    rows = [(None, v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)) for v in values]
    return spark.createDataFrame(rows, flows.KEYED)


def fixed(p):
    return lambda df: df.withColumn("probability", F.lit(p).cast("double"))


STAMP = "2024-02-01T00:00:00Z"


def routed(spark, values, p=0.82, **options):
    stamp = F.lit(STAMP).cast("timestamp")
    return events.route(keyed(spark, values), TELCO, fixed(p), processed_ts=stamp, **options)


def test_a_valid_event(spark):
    one = events.predictions(routed(spark, [event()]), TELCO).first()
    assert (one.customerID, one.churn_probability, one.prediction) == ("line-0001", 0.82, "Yes")
    assert (one.event_ts, one.processed_ts, one.actual_churn) == ("2024-01-01T00:00:00Z", STAMP, "No")
    hidden = events.predictions(routed(spark, [event()]), TELCO, include_ground_truth=False).first()
    assert hidden.actual_churn is None
    unlabelled = events.predictions(routed(spark, [without(event(), "Churn")]), TELCO)
    message = json.loads(events.encode_predictions(unlabelled, TELCO).first().value)
    assert "actual_churn" not in message and message["customerID"] == "line-0001"


def test_threshold(spark):
    labels = [events.predictions(routed(spark, [event()], 0.6, threshold=t), TELCO).first().prediction for t in (0.5, 0.6, 0.7)]
    assert labels == ["Yes", "Yes", "No"]
    with pytest.raises(ValueError):
        routed(spark, [event()], threshold=1.5)


REJECTED = [
    ("this is { not json", events.JSON_ERROR),
    (json.dumps(event()) + " trailing", events.JSON_ERROR),
    (json.dumps(event()) + "]", events.JSON_ERROR),
    (json.dumps(event()) + "," + json.dumps(event()), events.JSON_ERROR),
    (json.dumps(event())[:-1] + ",}", events.JSON_ERROR),
    ("", events.JSON_ERROR),
    (None, events.JSON_ERROR),
    ("[1, 2]", events.NOT_OBJECT),
    ("5", events.NOT_OBJECT),
    ("null", events.NOT_OBJECT),
    (json.dumps(json.dumps(event())), events.NOT_OBJECT),
    (without(event(), "tenure"), events.MISSING + "['tenure']"),
    (without(event(), "tenure", "Contract", "customerID"), events.MISSING + "['Contract', 'customerID', 'tenure']"),
    (event(tenure="abc"), "ValueError: tenure: not a number"),
    (event(Churn="Maybe"), "ValueError: churn: expected Yes or No"),
    (event(Partner=True), "ValueError: Partner: expected Yes or No"),
    (event(Contract=None), "ValueError: Contract: missing value"),
]


def test_every_input_has_one_output(spark):
    good = [event(1), event(2, TotalCharges=None), event(3, TotalCharges=""), event(4, Contract="Quantum 999yr plan"),
            event(5, extra={"a": [1]}), event(6, Churn=None), " " + json.dumps(event(7)) + "\n", event(8, gender="Ünïcode ☃")]
    out = routed(spark, good + [v for v, _ in REJECTED])
    assert events.predictions(out, TELCO).count() == len(good)
    dead = events.dead_letters(out).collect()
    assert sorted(r.error for r in dead) == sorted(e for _, e in REJECTED)
    assert {r.error: r.key for r in dead}[events.MISSING + "['tenure']"] == "line-0001"
    assert {r.key for r in dead if r.error == events.JSON_ERROR} == {"unknown"}
    assert {r.original for r in dead} >= {v for v, _ in REJECTED if isinstance(v, str)}
    n = events.counters(out).first()
    assert (n.consumed, n.predicted, n.dead_lettered) == (len(good) + len(REJECTED), len(good), len(REJECTED))


def test_the_last_of_repeated_fields_wins(spark):
    text = json.dumps(event(tenure=1))[:-1] + ', "tenure": 7}'
    assert routed(spark, [text]).first().tenure == 7.0


def test_probability_out_of_range(spark):
    for p in (1.2, -0.1, float("nan"), None):
        assert routed(spark, [event()], p).first().error == events.OUT_OF_RANGE
    assert routed(spark, [event()], 1.0).first().error is None


def test_encode_round_trip(spark):
    df = spark.createDataFrame([("a", float("nan"), 1, "é"), ("b", float("inf"), 2, None), ("c", 0.5, 3, "x")], "id string, v double, n int, s string")
    rows = {r.key: json.loads(r.value) for r in events.encode(df, "id", F.lit(STAMP)).collect()}
    assert rows["a"] == {"id": "a", "v": None, "n": 1, "s": "é", "event_ts": STAMP}
    assert rows["b"]["v"] is None and rows["b"]["s"] is None and rows["c"]["v"] == 0.5


def write_topic(spark, path, values, mode="append"):
    keyed(spark, values).coalesce(1).write.mode(mode).json(path)


def source(spark, path):
    return flows.read_events(spark, flows.Endpoint("json", path), per_trigger=1)


def test_stream_restarts_without_loss_or_repeat(spark, tmp_path):
    topic, out, check = (str(tmp_path / n) for n in ("topic", "out", "check"))
    sink, letters = flows.Endpoint("json", str(tmp_path / "sent")), flows.Endpoint("json", str(tmp_path / "dlq"))

    def run():
        flows.score_stream(source(spark, topic), TELCO, fixed(0.7), out, check,
                           prediction_sink=sink, dead_letter_sink=letters).awaitTermination()

    write_topic(spark, topic, [event(1), "garbage", event(2)])
    run()
    write_topic(spark, topic, [event(3), event(4, tenure="x")])
    run()
    run()
    scored = flows.read_output(spark, out, "predictions")
    assert sorted(r.customerID for r in scored.collect()) == ["line-0001", "line-0002", "line-0003"]
    assert flows.read_output(spark, out, "dead_letters").count() == 2
    totals = flows.read_output(spark, out, "counters").agg(F.sum("consumed"), F.sum("predicted"), F.sum("dead_lettered")).first()
    assert tuple(totals) == (5, 3, 2)
    sent = spark.read.schema(flows.KEYED).json(sink.path)
    assert sorted(r.key for r in sent.collect()) == ["line-0001", "line-0002", "line-0003"]
    dead = [json.loads(r.value) for r in spark.read.schema(flows.KEYED).json(letters.path).collect()]
    assert sorted(d["original"] for d in dead)[1] == "garbage" or "garbage" in {d["original"] for d in dead}


def test_a_repeated_batch_overwrites_itself(spark, tmp_path):
    topic, out = str(tmp_path / "topic"), str(tmp_path / "out")
    write_topic(spark, topic, [event(1), event(2)])
    for attempt in ("a", "b"):  # a lost checkpoint repeats batch 0
        flows.score_stream(source(spark, topic), TELCO, fixed(0.7), out, str(tmp_path / attempt)).awaitTermination()
    assert flows.read_output(spark, out, "predictions").count() == 2


def test_progress_is_kept(spark, tmp_path):
    import time

    topic, table = str(tmp_path / "topic"), str(tmp_path / "progress")
    listener = flows.Progress(spark, table, every=2)
    for i in range(3):
        write_topic(spark, topic, [event(i), event(i + 10)])
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema(flows.KEYED).option("maxFilesPerTrigger", 1).json(topic)
        flows.score_stream(stream, TELCO, fixed(0.7), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
        for _ in range(100):
            time.sleep(0.2)
            if os.path.exists(table) and listener.read().agg(F.sum("rows")).first()[0] == 6:
                break
    finally:
        spark.streams.removeListener(listener)
    kept = listener.read().where("rows > 0").orderBy("batch_id").collect()
    assert [(r.batch_id, r.rows) for r in kept][0] == (0, 2) and sum(r.rows for r in kept) == 6
    counted = flows.read_output(spark, str(tmp_path / "out"), "counters").agg(F.sum("consumed"), F.sum("predicted")).first()
    assert tuple(counted) == (6, 6)


def test_counters_need_no_job_of_their_own(spark, tmp_path):
    scans = spark.sparkContext.accumulator(0)

    def scorer(df):
        def one(rows):
            for frame in rows:
                scans.add(len(frame))
                yield frame.assign(probability=0.7)

        return df.mapInPandas(one, f"{df.schema.simpleString()[7:-1]}, probability double".replace(",", ", "))

    rows = keyed(spark, [event(1), event(2), "junk"])
    flows.score_batch(rows, 0, TELCO, scorer, str(tmp_path / "out"))
    assert tuple(flows.read_output(spark, str(tmp_path / "out"), "counters").first())[:3] == (3, 2, 1)
    assert scans.value == 3
    flows.score_batch(rows.limit(0), 1, TELCO, scorer, str(tmp_path / "none"))
    assert tuple(flows.read_output(spark, str(tmp_path / "none"), "counters").first())[:3] == (0, 0, 0)


REPEATS = [("a", 0), ("a", 30), ("b", 10), ("a", 55), ("a", 300), ("b", 400), ("c", 900), ("a", 330), (None, 20), (None, 21)]


@pytest.mark.parametrize("files", [1, 4])
@pytest.mark.parametrize("ordered", [False, True])
def test_repeats_within_a_horizon(spark, tmp_path, files, ordered):
    rows = spark.createDataFrame([(k, i, m) for i, (k, m) in enumerate(REPEATS)] + [("x", 99, None)], "k string, place long, minute long")
    rows = rows.withColumn("at", (F.lit("2024-01-01").cast("timestamp").cast("long") + F.col("minute") * 60).cast("timestamp"))
    for part in range(files):
        rows.where(F.col("place") % files == files - 1 - part).repartition(1 + part).write.mode("append").parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "t"))
        flows.distinct_stream(stream, ["k"], "at", "1 hour", str(tmp_path / "out"), str(tmp_path / "c"), place=["place"] if ordered else ()).awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = spark.read.parquet(str(tmp_path / "out")).select("k", "place").collect()
    if ordered:  # a group that the watermark has not passed stays open
        assert sorted((r.k or "", r.place) for r in got) == [("", 8), ("a", 0), ("a", 4), ("b", 2), ("b", 5)]
    else:
        keys = [r.k for r in got]
        assert set(keys) == {"a", "b", "c", None} and keys.count(None) == 1 and keys.count("c") == 1


def test_order_by_key_splits_a_frequent_key(spark, tmp_path):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 700)).alias("key"), F.col("id").alias("place"))
    orders = []
    for attempt, parts in (("a", 3), ("b", 7)):
        path = str(tmp_path / attempt)
        sinks.write_ordered(rows.repartition(parts, "place"), "key", ["place"], F.col("place").cast("string"), path, 8)
        files = sorted(f for f in os.listdir(path) if f.startswith("part"))
        lines = [[json.loads(line) for line in open(f"{path}/{f}")] for f in files]
        assert len(files) == 8 and max(map(len, lines)) < 2 * 6000 / 8
        orders.append([(r["key"], int(r["value"])) for f in lines for r in f])
    assert orders[0] == orders[1]
    seen = {}
    for key, place in orders[0]:
        assert seen.get(key, -1) < place
        seen[key] = place


def test_a_model_of_another_library(spark, tmp_path):
    def load():
        import numpy as np

        return lambda cells: np.where(np.isnan(cells[:, 0]), 0.25, cells[:, 0] / 100)

    scorer = models.external_scorer(load, ("tenure", "MonthlyCharges"), "numpy", "7")
    out = str(tmp_path / "out")
    flows.score_batch(keyed(spark, [event(10), event(80), "junk"]), 0, TELCO, scorer, out)
    got = flows.read_output(spark, out, "predictions").orderBy("customerID").collect()
    assert [(r.churn_probability, r.prediction, r.model_source, r.model_version) for r in got] == [(0.1, "No", "numpy", "7"), (0.8, "Yes", "numpy", "7")]
    message = events.encode_predictions(flows.read_output(spark, out, "predictions").drop("batch_id"), TELCO).first()
    assert json.loads(message.value)["model_version"] == "7"
    missing = scorer(spark.createDataFrame([(None, 1.0)], "tenure double, MonthlyCharges double")).first()
    assert missing.probability == 0.25
    assert scorer(spark.createDataFrame([], "tenure double, MonthlyCharges double")).count() == 0


def test_dry_run_writes_nothing(spark, tmp_path):
    topic, out = str(tmp_path / "topic"), tmp_path / "out"
    write_topic(spark, topic, [event(i) for i in range(4)])
    flows.score_stream(source(spark, topic), TELCO, fixed(0.7), str(out), str(tmp_path / "c"), dry_run=True).awaitTermination()
    assert not out.exists()


def test_ingest_is_insert_only(spark, tmp_path):
    topic, store = str(tmp_path / "topic"), Store(spark, str(tmp_path / "store"))
    message = {"customerID": "a", "churn_probability": 0.3, "prediction": "No", "processed_ts": "2024-01-01T00:00:00Z"}
    write_topic(spark, topic, [message, {**message, "churn_probability": 0.9, "prediction": "Yes"}, {"customerID": "b"}, "junk",
                               {**message, "customer_id": "c", "customerID": None, "contract": "M", "actual_churn": "Yes"}])
    for attempt in ("first", "second"):
        flows.ingest_stream(source(spark, topic), store, str(tmp_path / attempt), str(tmp_path / f"bad-{attempt}")).awaitTermination()
    rows = {r.customer_id: r for r in store.read("predictions").collect()}
    assert set(rows) == {"a", "c"} and rows["a"].churn_probability == 0.9
    assert rows["c"].contract == "M" and rows["c"].actual_churn == 1
    bad = spark.read.parquet(str(tmp_path / "bad-first"))
    assert sorted(r.row_error for r in bad.collect()) == ["unusable churn_probability", "unusable customer_id"]


def test_publish_resumes_and_resets(spark, tmp_path):
    folder, sent = str(tmp_path / "table"), str(tmp_path / "sent")
    schema = "customerID string, n bigint"

    def add(first):
        spark.range(first, first + 5).select(F.concat(F.lit("c"), "id").alias("customerID"), F.col("id").alias("n")).coalesce(1).write.mode("append").parquet(folder)

    def publish(checkpoint, path, **options):
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        flows.publish_stream(rows, "customerID", flows.Endpoint("json", path), str(tmp_path / checkpoint), **options).awaitTermination()

    add(0)
    publish("dry", sent, dry_run=True)
    publish("c1", sent)
    add(5)
    publish("c1", sent)
    got = [r.key for r in spark.read.schema(flows.KEYED).json(sent).collect()]
    assert sorted(got) == sorted(f"c{i}" for i in range(10))
    publish("c2", str(tmp_path / "again"))
    assert spark.read.schema(flows.KEYED).json(str(tmp_path / "again")).count() == 10


def test_closed_windows_appear_and_late_rows_do_not(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run(*hours):
        rows = [(f"2024-01-01 {h:02d}:30:00",) for h in hours]
        spark.createDataFrame(rows, "t string").select(F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("ts timestamp").parquet(folder)
        flows.volume_stream(stream, "ts", out, str(tmp_path / "check")).awaitTermination()

    run(1, 1, 2, 5)
    run(1, 8)
    got = {str(r.start)[11:13]: r["count"] for r in spark.read.parquet(out).collect()}
    assert got == {"01": 2, "02": 1, "05": 1}


def test_every_row_is_counted_or_late(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run(rows, again=False):
        if not again:
            data = [(i, None if h is None else f"2024-01-01 {h:02d}:30:00") for i, h in rows]
            spark.createDataFrame(data, "id int, t string").select("id", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("id int, ts timestamp").parquet(folder)
        flows.split_late(stream, "ts", f"{out}/split", str(tmp_path / ("c2" if again else "c1"))).awaitTermination()
        on_time = spark.readStream.schema("id int, ts timestamp").parquet(f"{out}/split/on_time")
        flows.volume_stream(on_time, "ts", f"{out}/volume", str(tmp_path / "v")).awaitTermination()

    run([(1, 1), (2, 1), (3, 2), (4, 5), (5, None)])
    run([(6, 1), (7, 4), (8, 9)])  # hours up to 3 were closed by 5:30 less an hour
    run([(10, 7), (11, 3), (12, 14)])
    late = spark.read.parquet(f"{out}/split/late")
    assert sorted(r.id for r in late.collect()) == [5, 6, 10, 11]
    counted = {str(r.start)[11:13]: r["count"] for r in spark.read.parquet(f"{out}/volume").collect()}
    assert counted == {"01": 2, "02": 1, "04": 1, "05": 1, "09": 1}
    state = spark.read.format("statestore").load(str(tmp_path / "v"))
    assert state.count() == 1  # only the open hour is kept


def test_file_sources_and_sinks(spark, tmp_path):
    csv = str(tmp_path / "raw.csv")
    header = ",".join(TELCO.raw_columns)
    rows = [raw_row(i, **({"TotalCharges": " "} if i == 4 else {})) for i in range(5)]
    lines = [",".join(str(r[c]) for c in TELCO.raw_columns) for r in rows]
    with open(csv, "w") as f:
        f.write("\n".join([header, *lines]))
    raw = tables.read_raw_csv(spark, csv, TELCO)
    assert raw.count() == 5 and dict(raw.dtypes)["tenure"] == "string"
    nulls = tables.read_raw_csv(spark, csv, TELCO, blank="null")
    assert nulls.where("TotalCharges is null").count() == 1 and dict(nulls.dtypes)["TotalCharges"] == "double"

    splits = str(tmp_path / "splits")
    sinks.write_splits(raw.withColumn("split", F.when(F.col("tenure") > 2, "test").otherwise("train")), splits)
    assert tables.read_split(spark, splits, "train").count() == 3
    plan = tables.read_split(spark, splits, "train")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    with pytest.raises(ValueError, match="unknown split"):
        tables.read_split(spark, splits, "holdout")

    lines_path = str(tmp_path / "rows.jsonl")
    with open(lines_path, "w") as f:
        f.write('{"customerID": "a", "tenure": 3.0}\n')
    got = tables.read_records(spark, lines_path, TELCO.clean_schema()).first()
    assert (got.customerID, got.tenure, got.Contract) == ("a", 3.0, None)
    with pytest.raises(ValueError, match="unknown input format"):
        tables.read_records(spark, "x.xml", TELCO.clean_schema())

    scored = spark.createDataFrame([("a", 1, "Yes", 0.9)], "customerID string, prediction int, label string, churn_probability double")
    sinks.write_predictions_csv(scored, str(tmp_path / "p"), TELCO)
    assert spark.read.option("header", True).csv(str(tmp_path / "p")).first().label == "Yes"


def test_report(spark, tmp_path):
    summary = spark.createDataFrame([(3, 2, 1, 50.0, 0.55)], "consumed int, predicted int, dead_lettered int, overall_churn_pct double, mean_churn_probability double")
    segments = spark.createDataFrame([("M", 2, 50.0)], "contract string, total int, churn_rate_pct double")
    top = spark.createDataFrame([("a", 0.9, "Yes")], "customerID string, churn_probability double, prediction string")
    document = sinks.summary_document(summary, segments, top)
    sinks.write_report(spark, document, str(tmp_path / "r"))
    assert json.loads(spark.read.text(str(tmp_path / "r/json")).first().value) == document
    assert "| consumed | 3 |" in sinks.summary_markdown(document)
