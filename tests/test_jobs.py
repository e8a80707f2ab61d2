"""The command line jobs, one after the other on one folder."""

from __future__ import annotations

import csv
import json
import random

from scoreline import TELCO
from scoreline.plans import jobs
from scoreline.sources.store import Store
from scoreline.streaming import flows
from tests.test_clean import raw_row


def customers(n):
    rng = random.Random(1)
    for i in range(n):
        gone = rng.random() < 0.3
        yield raw_row(
            i, tenure=str(rng.randint(0, 20 if gone else 72)), MonthlyCharges=f"{rng.uniform(20, 110):.2f}",
            Contract="Month-to-month" if gone or rng.random() < 0.4 else "Two year", Churn="Yes" if gone else "No",
        )


def test_jobs_end_to_end(spark, tmp_path, capsys):
    def path(name):
        return str(tmp_path / name)

    rows = list(customers(600))
    (tmp_path / "raw").mkdir()
    with open(path("raw/customers.csv"), "w", newline="") as f:
        writer = csv.DictWriter(f, TELCO.raw_columns)
        writer.writeheader()
        writer.writerows(rows)
    jobs.main(["build-dataset", "--input", path("raw/customers.csv"), "--output", path("splits"), "--exact"])
    assert spark.read.parquet(path("splits")).count() == 600
    jobs.main(["train", "--input", path("splits"), "--output", path("model"), "--store", path("store"), "--version", "1"])
    jobs.main(["publish", "--input", path("raw"), "--output", path("topic"), "--checkpoint", path("c-publish")])
    topic = ["--input", path("topic/*")]
    consume = ["consume", *topic, "--output", path("scored"), "--model", path("model"), "--checkpoint", path("c-score")]
    jobs.main([*consume, "--dry-run"])
    assert not (tmp_path / "scored").exists()
    jobs.main(consume)
    report = json.loads(spark.read.text(path("scored/report/json")).first().value)
    assert report["counts"] == {"consumed": 600, "predicted": 600, "dead_lettered": 0}
    assert set(report["churn_pct_by_contract"]) == {"Month-to-month", "Two year"}
    assert len(report["top_k_customers"]) == 10

    messages = flows.read_output(spark, path("scored"), "predictions").drop("batch_id")
    from scoreline.streaming import events

    events.encode_predictions(messages, TELCO).write.json(path("messages"))
    jobs.main(["ingest", "--input", path("messages"), "--store", path("store"), "--checkpoint", path("c-ingest")])
    store = Store(spark, path("store"))
    assert store.read("predictions").count() == 600
    jobs.main(["monitor", "--store", path("store"), "--reference", path("splits"), "--model", path("model"),
               "--raw-events", path("topic/*")])
    run = store.read("monitoring_runs").first()
    assert (run.status, run.records_processed, run.drift_detected) == ("ok", 600, False)
    assert store.committed("drift_metrics").where("drift_type = 'data'").count() == 7
    jobs.main(["promote", "--store", path("store")])
    assert "promoted" in capsys.readouterr().out

    with open(path("one.json"), "w") as f:
        f.write(json.dumps({"customerID": "x", "tenure": 1.0, "MonthlyCharges": 90.0}) + "\n")
    jobs.main(["predict", "--input", path("one.json"), "--output", path("csv"), "--model", path("model")])
    assert spark.read.option("header", True).csv(path("csv")).count() == 1
