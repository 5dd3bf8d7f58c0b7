"""Cuts at a limit, and streams over restarts and batches."""

from pyspark.sql import functions as F

from pricetide.operators.filters import missing_from_run
from pricetide.operators.matching import review_pairs
from pricetide.streaming import jobs


def test_review_limit_orders_by_ids(spark):
    scored = spark.createDataFrame([(10, 1, 0.8, False, "m"), (5, 20, 0.8, False, "m"), (7, 8, 0.7, False, "m")], "left_profile long, right_profile long, confidence double, accepted boolean, method string")
    best = spark.createDataFrame([], "profile_id long, best long, runner_id long, confidence double, runner_confidence double, ambiguous boolean")
    members = spark.createDataFrame([(p, p) for p in (1, 5, 7, 8, 10, 20)] + [(10, 11), (1, 2)], "profile_id long, listing_id long")
    for limit in (1, 2, 3, 5, 100):
        got = [(r["left_id"], r["right_id"]) for r in review_pairs(scored, best, members, limit).collect()]
        assert got == [(1, 10), (1, 11), (2, 10), (2, 11), (5, 20), (7, 8)][:limit]


def test_review_limit_with_many_copies(spark):
    scored = spark.createDataFrame([(1, 1001, 0.8, False, "m"), (2001, 3001, 0.8, False, "m")], "left_profile long, right_profile long, confidence double, accepted boolean, method string")
    best = spark.createDataFrame([], "profile_id long, best long, runner_id long, confidence double, runner_confidence double, ambiguous boolean")
    groups = {1: 40, 1001: 30, 2001: 1, 3001: 50}
    members = spark.createDataFrame([(p, p + k) for p, n in groups.items() for k in range(n)], "profile_id long, listing_id long")
    every = sorted((a + i, b + j) for a, b in ((1, 1001), (2001, 3001)) for i in range(groups[a]) for j in range(groups[b]))
    for limit in (1, 7, 60, 1230, 5000):
        assert [(r["left_id"], r["right_id"]) for r in review_pairs(scored, best, members, limit).collect()] == every[:limit]


def test_missing_from_run_against_sets(spark):
    ids = [-70, -1, 0, 1, 63, 64, 127, 128, 2**40, -(2**40)]
    listings = spark.createDataFrame([(i, 1 + k % 2, f"n{i}") for k, i in enumerate(ids)], "listing_id long, store_id long, name string")
    runs = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("c", 2, "x"), ("d", 2, "x"), ("e", 3, "x")], "run_id string, store_id long, other string")
    observed = [("a", i) for i in ids[::3]] + [("c", i) for i in ids] + [("b", 999), (None, 0), ("z", 64)]
    got = [tuple(r) for r in missing_from_run(listings, spark.createDataFrame(observed, "run_id string, listing_id long"), runs).collect()]
    want = [(r, i, 1 + k % 2, f"n{i}") for r, s in (("a", 1), ("b", 1), ("c", 2), ("d", 2)) for k, i in enumerate(ids) if 1 + k % 2 == s and (r, i) not in observed]
    assert sorted(got) == sorted(want)
    assert missing_from_run(listings.limit(0), spark.createDataFrame(observed, "run_id string, listing_id long"), runs).count() == 0


def test_silence_ends_by_a_timer(spark, tmp_path):
    hours = [[(1, 0), (2, 0), (2, 1)], [(2, 5), (3, 6)], [(2, 9), (3, 40), (3, 80)], [(1, 81), (3, 82)]]
    for k, rows in enumerate(hours):
        spark.createDataFrame(rows, "listing_id long, h long").select("listing_id", F.timestamp_seconds((F.col("h") + 400_000) * 3600).alias("observed_at")).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
    found = []
    for files in (1, 100):
        stream = spark.readStream.schema("listing_id long, observed_at timestamp").option("maxFilesPerTrigger", files).parquet(str(tmp_path / "in*"))
        out = jobs.run_available(jobs.stream_silence(stream, "10 hours", "1 hour"), str(tmp_path / f"out{files}"), str(tmp_path / f"marks{files}"))
        found.append(sorted((r["listing_id"], r["h"], r["is_available"]) for r in out.select("listing_id", (F.unix_seconds("changed_at") / 3600 - 400_000).cast("int").alias("h"), "is_available").collect()))
    assert found[0] == found[1] == [(1, 0, True), (1, 10, False), (1, 81, True), (2, 0, True), (2, 19, False), (3, 6, True), (3, 16, False), (3, 40, True), (3, 50, False), (3, 80, True)]


def test_upsert_goes_on_after_a_restart(spark, tmp_path):
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))

    def arrive(rows):
        spark.createDataFrame(rows, "k long, at long, v string").coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema("k long, at long, v string").parquet(source)
        return sorted(tuple(r) for r in jobs.foreach_upsert(stream, out, marks, ["k"], ["at"]).collect())

    arrive([(1, 1, "a"), (2, 1, "b")])
    assert run() == [(1, 1, "a"), (2, 1, "b")]
    assert run() == [(1, 1, "a"), (2, 1, "b")]  # nothing new
    arrive([(1, 2, "c"), (2, 0, "old"), (3, 1, "d")])
    assert run() == run() == [(1, 2, "c"), (2, 1, "b"), (3, 1, "d")]


def test_state_is_carried_between_batches(spark, tmp_path):
    rows = [(i, i % 2, [5, 9, 5, 3, 3, 8, 1, 7][i]) for i in range(8)]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "obs_id long, listing_id long, price long").withColumn("observed_at", F.timestamp_seconds(F.col("obs_id"))).withColumn("master_id", F.col("listing_id")).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    found = {}
    for name, files in (("once", 100), ("each", 1)):
        stream = spark.readStream.schema("obs_id long, listing_id long, price long, observed_at timestamp, master_id long").option("maxFilesPerTrigger", files).parquet(str(tmp_path / "in*"))
        for job in (jobs.stream_price_changes, jobs.stream_running_min):
            got = jobs.run_available(job(stream), str(tmp_path / f"{name}-{job.__name__}"), str(tmp_path / f"{name}-{job.__name__}-marks"))
            found[name, job.__name__] = sorted(tuple(r) for r in got.collect())
    assert found["once", "stream_price_changes"] == found["each", "stream_price_changes"] == [(3, 1, 9, 3), (4, 0, 5, 3), (5, 1, 3, 8), (6, 0, 3, 1), (7, 1, 8, 7)]
    assert found["once", "stream_running_min"] == found["each", "stream_running_min"] == [(3, 1, 9, 3), (4, 0, 5, 3), (6, 0, 3, 1)]


def test_members_of_many_documents_are_not_held_at_once(spark):
    import json
    import tracemalloc

    import pyarrow as pa

    from pricetide.sources import json_products as J

    body = json.dumps([{"name": f"Item {k}", "url": f"/producto/{k}", "price": k, "amount": k} for k in range(60)])
    read = J.node_lists(J.PRODUCT_MEMBERS, 3, lambda node: "name" in node, None).func
    peaks = []
    for n in (40, 400):
        texts = pa.array([[body]] * n)
        tracemalloc.start()
        found = read(texts)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert len(found) == n and all(len(x) == 60 for x in found)
    assert peaks[1] < 2 * peaks[0]


def test_pages_leave_no_trees_behind():
    import gc

    import pandas as pd

    from pricetide.sources import html as H

    page = "".join(f"<li><a href='/producto/item-{k}'><h3>Item {k}</h3></a><b>$9.990</b></li>" for k in range(20))
    gc.collect()
    gc.disable()
    try:
        assert sum(len(list(H._cards(page, H.PROFILES["shop_card"]))) for _ in range(20)) == 400
        alive = sum(isinstance(x, H.Node) for x in gc.get_objects())
    finally:
        gc.enable()
    assert alive < 200
    assert [len(b) for b in H._pages(iter([pd.DataFrame({"body": [page] * 70})]))] == [32, 32, 6]
