"""Queries against their SQL where the supplied tables have no such rows: values that differ in the last bit, nothing that moves."""

import datetime as dt
import random

import pytest

from spanwise.operators import overlap
from spanwise.plans import registry
from test_queries import rows_of

duckdb = pytest.importorskip("duckdb")


def same_as_sql(spark, folder, name, **tables):
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got, want = registry.QUERIES[name](spark, str(folder)), con.execute(registry.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    found = rows_of(got.columns, got.collect())
    assert found == rows_of(names, want.fetchall())
    return found


LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string, l_shipdate timestamp_ntz"


def line(supplier, day, number, quantity, discount=0.05):
    return (100 * supplier + day, day, supplier, number, float(quantity), discount, "N", dt.datetime(1995, 1, 1) + dt.timedelta(days=day))


def test_stop_start_features_where_nothing_moves_in_the_middle(spark, tmp_path):
    hidden = [line(1, i, 7 if 12 <= i <= 28 else 1, i * i % 50, i / 100) for i in range(41)]  # no box near the middle
    still = [line(2, i, 1, 20 if i > 6 else i) for i in range(41)]  # a median speed of zero
    few = [line(3, i, 1 if i < 5 else 7, i) for i in range(41)]  # five boxes
    early = [line(4, i, 1 if i < 8 else 7, i * i) for i in range(41)]  # boxes before the middle only
    beside = [line(5, i, 1 if i % 2 else 7, i) for i in range(41)]  # boxes, none beside another
    found = same_as_sql(spark, tmp_path, "v23_stop_start_features", lineitem=(hidden + still + few + early + beside, LINES))
    assert len(found) == 4 and any(row[0] is None for row in found)


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def test_change_peaks_at_a_quantile_between_values_that_differ_in_the_last_bit(spark, tmp_path):
    # of each of the first six users the two largest changes are equal but for rounding
    users = [[104.74, 194.07, 115.12, 204.45], [0.85, 29.02, 4.01, 32.18], [61.63, 100.67, 110.88, 149.92], [8.88, 72.75, 38.86, 102.73], [57.27, 106.75, 71.77, 121.25], [84.71, 162.05, 147.15, 224.49]]
    users += [[5.0, 5.0], [3.0], [1.0, 2.0, 1.0, 2.0, 1.0], [0.0, 1.1, 2.2, 3.3, 4.4, 5.5, 6.6, 7.7, 8.8, 9.9, 11.0, 12.1]]
    rows = [(100 * u + k, dt.datetime(2024, 1, 1) + dt.timedelta(days=k), u, "view", v, "{}") for u, values in enumerate(users) for k, v in enumerate(values)]
    assert len(same_as_sql(spark, tmp_path, "v06_change_peaks", events=(rows, EVENTS))) > 8


def test_same_object_groups_link_every_kind_of_label_once(spark, tmp_path, monkeypatch):
    linked, real = [], overlap.overlap_links
    monkeypatch.setattr(overlap, "overlap_links", lambda items, *a, **k: linked.append(items.count()) or real(items, *a, **k))
    names = ["hot bolt", "large ring", "hot ring", "cold bolt", "a b", "odd thing here today"]
    kinds = [(names[k % 6], f"Brand#{k % 2}", ["LARGE", "SMALL", "ECONOMY", "PROMO"][k // 6 % 4], k % 7) for k in range(84)]
    rows = [(k, *kinds[k % 84]) for k in range(84 * 8)] + [(9000, "lonely words", "Brand#1", "LARGE", 3), (9001, "lonely words", "Brand#1", "LARGE", 3), (9002, "hot bolt", None, "LARGE", 3), (9003, "hot bolt", "Brand#1", None, 3)]
    found = same_as_sql(spark, tmp_path, "u08_same_object_groups", part=(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int"))
    assert len(found) > 84 and linked[0] <= 85


def test_matched_controls_do_not_meet_all_others(spark, tmp_path):
    rng = random.Random(6)
    docs = [(k, "", rng.choice(["en", "de", None]), rng.choice(["a", "b", "only bad", "unmeasured", None]), rng.choice([None, rng.randrange(3000), rng.randrange(60) + 400])) for k in range(900)]
    docs = [(k, text, lang, source, None if source == "unmeasured" and k % 2 else n) for k, text, lang, source, n in docs]
    labels = [(k, 0 if source == "only bad" or source != "unmeasured" and rng.random() < 0.4 else int(k % 2 == 1 or source != "unmeasured"), 0) for k, _, _, source, _ in docs]
    found = same_as_sql(spark, tmp_path, "j20_matched_controls", documents=(docs, "doc_id long, text string, lang string, source string, n_chars long"), labels=(labels, "doc_id long, quality int, toxic int"))
    assert len(found) > 100
    plan = registry.QUERIES["j20_matched_controls"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    # every join is on a value beside the keys too
    assert joins and not [line for line in joins if line.count("=") < 3]
