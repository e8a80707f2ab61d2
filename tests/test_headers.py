from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreline import TELCO
from scoreline.operators import clean
from scoreline.sources import headers, tables
from scoreline.streaming import flows
from tests.test_clean import raw_row


def write(path, names, rows, opener=open):
    with opener(path, "wt") as f:
        f.write("\n".join([",".join(names), *(",".join(f'"{r.get(n, "?")}"' for n in names) for r in rows)]) + "\n")


def layouts():
    """Headers in order, reversed, with more, and with fewer columns."""
    names = list(TELCO.raw_columns)
    few = [n for n in names if n not in ("gender", "Contract")]
    return [names, names[::-1], ["note", *names[5:], "more, of it", *names[:5]], few]


def folder_of(tmp_path):
    rows = [raw_row(i) for i in range(40)]
    (tmp_path / "mixed").mkdir()
    (tmp_path / "tidy").mkdir()
    tidy = []
    for k, names in enumerate(layouts()):
        part = rows[10 * k : 10 * k + 10]
        quoted = ['"more, of it"' if "," in n else n for n in names]
        write(tmp_path / "mixed" / f"part [{k}] %20.csv", quoted, part)
        tidy += [{n: r[n] if n in names else "" for n in TELCO.raw_columns} for r in part]
    write(tmp_path / "tidy" / "all.csv", TELCO.raw_columns, tidy)
    return str(tmp_path / "mixed"), str(tmp_path / "tidy")


def cells(df):
    return sorted(tuple(json.dumps(v) for v in r) for r in df.collect())


def test_files_of_different_headers_give_the_rows_of_one_tidy_file(spark, tmp_path):
    mixed, tidy = folder_of(tmp_path)
    got, want = (tables.read_raw_csv(spark, p, TELCO) for p in (mixed, tidy))
    assert got.columns == list(TELCO.raw_columns) and cells(got) == cells(want)
    typed = [clean.clean(df.fillna("No", ["gender", "Contract"]), TELCO) for df in (got, want)]
    assert cells(typed[0]) == cells(typed[1])


def test_a_stream_of_such_files_gives_the_same_events(spark, tmp_path):
    mixed, tidy = folder_of(tmp_path)
    sent = {}
    for name, folder, files in (("mixed", mixed, 3), ("tidy", tidy, 1)):
        sink = flows.Endpoint("json", str(tmp_path / f"topic-{name}"))
        flows.publish_csv(spark, folder, TELCO, sink, str(tmp_path / f"c-{name}"), files_per_batch=files).awaitTermination()
        values = spark.read.schema(flows.KEYED).json(sink.path).collect()
        sent[name] = sorted(json.dumps({**json.loads(r.value), "event_ts": 0}) for r in values)
    assert len(sent["tidy"]) == 40 and sent["mixed"] == sent["tidy"]
    # A restart takes only the files that are new.
    write(tmp_path / "mixed" / "later.csv", TELCO.raw_columns[::-1], [raw_row(99)])
    sink = flows.Endpoint("json", str(tmp_path / "topic-mixed"))
    flows.publish_csv(spark, mixed, TELCO, sink, str(tmp_path / "c-mixed")).awaitTermination()
    again = [r.key for r in spark.read.schema(flows.KEYED).json(sink.path).collect()]
    assert len(again) == 41 and again.count("line-0099") == 1


def test_records_take_defaults_where_their_file_lacks_a_column(spark, tmp_path):
    schema, defaults = TELCO.clean_schema(), clean.column_defaults(TELCO)
    write(tmp_path / "a.csv", ["MonthlyCharges", "customerID", "tenure"], [{"customerID": "a", "tenure": 7, "MonthlyCharges": 20.5}])
    write(tmp_path / "b.csv", ["customerID", "tenure", "MonthlyCharges", "Contract"],
          [{"customerID": "b", "tenure": 20.5, "MonthlyCharges": 7, "Contract": "Two year"}, {"customerID": "c", "tenure": "x", "MonthlyCharges": 1}])
    rows = {r.customerID: r for r in tables.read_records(spark, str(tmp_path / "*.csv"), schema, "csv", defaults).collect()}
    assert (rows["a"].tenure, rows["a"].MonthlyCharges, rows["a"].Contract) == (7.0, 20.5, "No")
    assert (rows["b"].tenure, rows["b"].MonthlyCharges, rows["b"].Contract) == (20.5, 7.0, "Two year")
    assert rows["c"].tenure is None and rows["c"].Partner == 0
    bare = tables.read_records(spark, str(tmp_path / "a.csv"), schema).first()
    assert bare.tenure == 7.0 and bare.Contract is None


def test_json_fields_of_each_record(spark, tmp_path):
    lines = ['{"tenure": 3, "customerID": "a", "Contract": null}', "", '{"customerID": "b", "more": {"x": [1]}, "Contract": "M"}',
             '[{"customerID": "c"}, {"customerID": "d", "tenure": 4.5}]', "no json"]
    (tmp_path / "r.jsonl").write_text("\n".join(lines))
    schema, defaults = TELCO.clean_schema(), clean.column_defaults(TELCO)
    got = tables.read_records(spark, str(tmp_path / "r.jsonl"), schema, defaults=defaults)
    rows = {r.customerID: r for r in got.collect()}
    assert set(rows) == {"a", "b", "c", "d", None}
    assert (rows["a"].tenure, rows["a"].Contract, rows["a"].gender) == (3.0, None, "No")
    assert (rows["b"].tenure, rows["b"].Contract, rows["d"].tenure, rows["c"].tenure) == (0.0, "M", 4.5, 0.0)
    assert rows[None].gender is None
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1


def test_headers_of_odd_files(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("n", T.LongType())])
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "bom.csv").write_text("\n﻿n, a \n1,x\n")
    (tmp_path / "cased.csv").write_text("A,a,n\nupper,lower,2\n")
    write(tmp_path / "packed.csv.gz", ["n", "z", "a"], [{"n": 3, "z": 0, "a": "zip"}], gzip.open)
    got = headers.read_csv(spark, str(tmp_path), schema)
    assert sorted(map(tuple, got.collect())) == [("lower", 2), ("x", 1), ("zip", 3)]
    assert got.count() == 3 and got.select("n").agg(F.sum("n")).first()[0] == 6
    (tmp_path / "none").mkdir()
    assert headers.read_csv(spark, str(tmp_path / "none"), schema).count() == 0
    (tmp_path / "twice.csv").write_text("a,n,a\n1,2,3\n")
    with pytest.raises(ValueError, match="a more than once"):
        headers.read_csv(spark, str(tmp_path / "twice.csv"), schema)
    (tmp_path / "other.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError, match="no customerID"):
        tables.read_raw_csv(spark, str(tmp_path / "other.csv"), TELCO)
    (tmp_path / "other.csv").write_text("customerID,tenure\n1,2\n")
    with pytest.raises(ValueError, match="no file has the columns MonthlyCharges"):
        tables.read_raw_csv(spark, str(tmp_path / "other.csv"), TELCO)
