"""Primary keys over repeated loads, drifting properties, bounded samples."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerlight.plans.quality import duplicate_samples, sample_documents
from ledgerlight.sources.canonical import canonical_events, parse_properties, repr_to_json, unknown_properties
from ledgerlight.sources.generate import generate, write_csv_dir
from ledgerlight.sources.keyed import KeyedTable
from ledgerlight.sources.loader import load_csv_dir


def test_loading_twice_equals_loading_once(spark, scratch):
    tables = generate(spark, customers=30, seed=3)
    small = {k: tables[k] for k in ("customers", "plans", "subscriptions")}
    csv_dir, out = os.path.join(scratch, "csv"), os.path.join(scratch, "tables")
    write_csv_dir(small, csv_dir)
    first = load_csv_dir(spark, csv_dir, out, tables=tuple(small))
    once = {k: sorted(map(str, spark.read.parquet(os.path.join(out, k)).collect())) for k in small}
    second = load_csv_dir(spark, csv_dir, out, tables=tuple(small))
    for k in small:
        assert sorted(map(str, spark.read.parquet(os.path.join(out, k)).collect())) == once[k]
        assert first[k]["rows"] == len(once[k]) and first[k]["skipped"] == 0
        assert second[k]["rows"] == 0 and second[k]["skipped"] == len(once[k])


def test_keys_hold(spark, scratch):
    path = os.path.join(scratch, "t")
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "id long, name string")
    table = KeyedTable(spark, path, "id", rows.schema, buckets=3)
    table.insert(rows)
    assert sorted(map(tuple, table.read().collect())) == [(1, "a"), (2, "c")]
    table.insert(spark.createDataFrame([(2, "z"), (3, "e")], rows.schema))
    table.close()
    # another session's view: opened by path, with the buckets it was made with
    again = KeyedTable(spark, path, "id")
    again.insert(rows.unionByName(spark.createDataFrame([(4, "f")], rows.schema)))
    assert again.buckets == 3 and sorted(map(tuple, again.read().collect())) == [(1, "a"), (2, "c"), (3, "e"), (4, "f")]
    again.insert(rows.where("1 = 0"))
    assert again.read().count() == 4
    with pytest.raises(ValueError):
        KeyedTable(spark, path, "name")
    with pytest.raises(LookupError):
        KeyedTable(spark, os.path.join(scratch, "none"), "id")
    dies = spark.range(10, 50, 1, 4).select("id", F.when(F.col("id") < 45, "x").otherwise(F.raise_error(F.lit("lost"))).alias("name"))
    with pytest.raises(Exception, match="lost"):
        again.insert(dies)
    assert again.read().count() == 4


def test_only_the_delivery_is_shuffled(spark, scratch):
    rows = spark.range(1000).select("id", F.col("id").cast("string").alias("name"), F.lit(1).alias("more"))
    table = KeyedTable(spark, os.path.join(scratch, "t"), "id", rows.schema, buckets=8)
    table.insert(rows)
    plan = table.new_rows(rows)._jdf.queryExecution().executedPlan().toString()
    side = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert len(side) == 1 and "ReadSchema: struct<id:bigint>" in side[0] and "Bucketed: true" in side[0]
    # one exchange: of the delivery by its key
    assert plan.count("Exchange hashpartitioning") == 1 and "LeftAnti" in plan


# ---------------------------------------------------------------- drifting properties

def test_quotes_decide_what_is_a_literal(spark):
    rows = [{"note": "None shall pass", "ok": True, "gone": None}, {"who": "it's False", "say": 'a "True" word'},
            {"l": [1, None, "None"], "d": {"x": True}, "path": "c:\\xe9\\n", "duration_seconds": 2.5},
            {"at": "caf\xa0\x07", "tail": "back\\"}]
    text = [repr(r) for r in rows] + ["{'open': ", "", None, '{"a": "None \\" True"}', "{'x': '" + "\\\\" * 5000 + "'}"]
    df = spark.createDataFrame([(t,) for t in text], "t string")
    got = df.select(unknown_properties("t"), parse_properties("t")["duration_seconds"]).collect()
    assert got[0][0] == {"note": "None shall pass", "ok": "true", "gone": None}
    assert got[1][0] == {"who": "it's False", "say": 'a "True" word'}
    assert got[2][0] == {"l": '[1,null,"None"]', "d": '{"x":true}', "path": "c:\\xe9\\n"} and got[2][1] == 2.5
    assert got[3][0] == {"at": "caf\xa0\x07", "tail": "back\\"}
    assert [g[0] for g in got[4:7]] == [None, None, None]
    assert got[7][0] == {"a": 'None " True'} and len(got[8][0]["x"]) == 5000
    assert df.select(repr_to_json("t")).first()[0] == '{"note": "None shall pass", "ok": true, "gone": null}'


def test_known_numbers_and_unknown_keys(spark):
    df = spark.createDataFrame([("1", "u", "view", "2024-01-01", "{'session_duration': 7, 'plan': 'None'}"),
                                ("2", "u", "view", "2024-01-01", '{"duration_seconds": "8.5", "page_views": 3}')],
                               "event_id string, user_id string, event_type string, timestamp string, properties string")
    rows = canonical_events(df, keep_unknown=True).orderBy("event_id").collect()
    assert rows[0].properties.duration_seconds == 7.0 and rows[0].extra == {"plan": "None"}
    assert rows[1].properties.duration_seconds == 8.5 and rows[1].properties.page_views == 3.0 and rows[1].extra == {}
    assert "extra" not in canonical_events(df).columns


# ---------------------------------------------------------------- samples

def test_samples_are_bounded_in_every_task(spark):
    rows = [(i, None if i % 2 else "u", "view", "2024-01-01 00:00:00") for i in range(4000)] + [(9000, "v", "view", None), (9001, "v", "view", None),
                                                                                                 (9002, "w", None, None)]
    events = spark.createDataFrame(rows, "event_id long, user_id string, event_type string, t string") \
        .select("event_id", "user_id", "event_type", F.col("t").cast("timestamp_ntz").alias("timestamp")).repartition(6)
    got = duplicate_samples(events, 5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2     # before and after the shuffle
    found = {(r.user_id, r.event_type, r.second): (r["count"], r.sample_ids) for r in got.collect()}
    assert found == {("u", "view", "2024-01-01 00:00:00"): (2000, [0, 2, 4, 6, 8]),
                     (None, "view", "2024-01-01 00:00:00"): (2000, [1, 3, 5, 7, 9]), ("v", "view", None): (2, [9000, 9001])}
    assert [r.event_id for r in sample_documents(events, 3).collect()] == [0, 1, 2]
