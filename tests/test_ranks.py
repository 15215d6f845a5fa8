"""Dealing and gathering, workers by greedy shares, view alignment, and watching streams."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import multiview, ranks
from tessella.streaming import watch


@pytest.mark.parametrize("n,world", [(0, 3), (1, 4), (12, 4), (13, 4), (15, 4), (7, 1)])
def test_gathering_undoes_dealing(spark, n, world):
    rows = spark.createDataFrame([(f"r{(k * 7919) % 1000:03d}", k) for k in range(n)], "name string, id int")
    dealt = ranks.dealt(rows, world, "name")
    each = {r["rank"]: (r.n, r.d) for r in dealt.groupBy("rank").agg(F.count("*").alias("n"), F.count_if("dummy").alias("d")).collect()}
    assert len({a for a, _ in each.values()}) <= 1 and all(d <= 1 for _, d in each.values()) and (not n or len(each) == world)
    back = ranks.gathered(dealt.repartition(3), world).collect()
    assert [(r.position, r.name) for r in sorted(back, key=lambda r: r.position)] == list(enumerate(sorted(r.name for r in rows.collect())))
    unpadded = ranks.gathered(dealt.where("NOT dummy").drop("dummy"), world, None)
    assert sorted(r.position for r in unpadded.collect()) == list(range(n))


@pytest.mark.parametrize("gone", ["rank = 0 AND place = 1", "rank = 1 AND place = 0", "rank = 1"])
def test_ranks_that_do_not_fit(spark, gone):
    dealt = ranks.dealt(spark.range(10), 3, "id").where(f"NOT ({gone})")
    with pytest.raises(Exception, match="ranks hold"):
        ranks.gathered(dealt, 3).collect()
    twice = ranks.dealt(spark.range(4), 2, "id")
    with pytest.raises(Exception, match="ranks hold"):
        ranks.gathered(twice.unionByName(twice), 2).collect()


def greedy(sizes, workers):
    share = np.array(sizes) / sum(sizes)
    out = np.ones(len(sizes), int)
    while out.sum() < workers:
        out[np.argmin(out / out.sum() - share)] += 1
    return out.tolist()


def test_workers_one_at_a_time(spark):
    rng = np.random.default_rng(3)
    tables = {t: rng.integers(1, [10, 1000, 3][t % 3], int(rng.integers(1, 7))).tolist() for t in range(9)}
    rows = [(t, f"k{i}", n) for t, sizes in tables.items() for i, n in enumerate(sizes)]
    for workers in (7, 20):
        got = ranks.allocated_workers(spark.createDataFrame(rows, "t int, key string, n long"), workers, ["t"]).orderBy("t", "key").collect()
        assert [[r.workers for r in got if r.t == t] for t in tables] == [greedy(s, workers) for s in tables.values()]
    one = ranks.allocated_workers(spark.createDataFrame([("a", 700), ("b", 200), ("c", 100)], "key string, n long"), 16)
    assert sum(r.workers for r in one.collect()) == 16
    with pytest.raises(Exception, match="fewer workers"):
        ranks.allocated_workers(spark.createDataFrame([("a", 1), ("b", 1)], "key string, n long"), 1).collect()


def test_views_on_one_grid(spark):
    rows = [(s, v, start, n, fps, c) for s, views in {
        1: [("l", 3, 20, 30, "x"), ("r", 3, 9, 30, None)],
        2: [("l", 3, 20, 30, "x")],
        3: [("l", 3, 20, 30, "x"), ("r", 3, 20, 15, "y")],
        4: [("l", 3, 20, 30, "x"), ("r", 4, 20, 30, "y")],
        5: [("l", 3, 8, 30, "x"), ("r", 3, 20, 30, "y")],
        6: [("l", 3, 20, 30, "x"), ("l", 3, 20, 30, "x"), ("r", 3, 20, 30, "y")],
    }.items() for v, start, n, fps, c in views] + [(1, "other", 0, 1, 1, "z")]
    df = spark.createDataFrame(rows, "sample int, view string, start int, frames int, fps int, caption string")
    got = {r.sample: r for r in multiview.multiview_frames(df, ["r", "l"], 5, 2, {"l": "Left:"}).collect()}
    assert {k: r.problem for k, r in got.items()} == {1: None, 2: "a view is missing", 3: "frame rates differ", 4: "frames differ", 5: "too few frames", 6: "a view is there twice"}
    assert (got[1].frame_ids, got[1].captions, got[1].view_indices, got[1].fps) == ([3, 5, 7, 9, 11], ["", "Left: x"], [0, 1], 30) and got[4].frame_ids is None
    merged = {r.sample: r for r in multiview.multiview_frames(df, ["r", "l"], 5, 2, merge=True).collect()}
    assert merged[4].frame_ids == [4, 6, 8, 10, 12] and merged[5].problem == "too few frames"


def test_stalls_are_told_once():
    now, told, back = [0.0], [], []
    w = watch.StallWatch(10, lambda *a: told.append(a), lambda *a: back.append(a), every=1000, clock=lambda: now[0])
    w._moved("q", "name")
    now[0] = 9
    w.check()
    assert not told
    for now[0] in (11, 12, 30):
        w.check()
    assert told == [("q", "name", 11)]
    w._moved("q")
    assert back == [("q", "name", 30)]
    now[0] = 45
    w.check()
    assert len(told) == 2
    w.stop()


def test_a_stalled_stream_raises_an_alert(spark, tmp_path):
    (tmp_path / "in").mkdir()
    told, back = [], []
    w = watch.StallWatch(2.0, lambda *a: told.append(a), lambda *a: back.append(a), every=0.2)
    spark.streams.addListener(w)

    def slow(df, batch):
        if batch == 1:
            time.sleep(6)

    try:
        put = lambda k: spark.range(k).write.mode("append").parquet(f"{tmp_path}/in")
        put(3)
        q = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").writeStream.queryName("slow").foreachBatch(slow).option("checkpointLocation", f"{tmp_path}/c").start()
        q.processAllAvailable()
        time.sleep(1)
        put(1)
        q.processAllAvailable()
        for _ in range(40):
            if back:
                break
            time.sleep(0.25)
        q.stop()
    finally:
        spark.streams.removeListener(w)
        w.stop()
    assert told and told[0][1] == "slow" and told[0][2] > 2 and back and back[0][0] == told[0][0]


def test_silent_keys(spark, tmp_path):
    (tmp_path / "in").mkdir()
    seen = []
    put = lambda *k: spark.createDataFrame([(x,) for x in k], "k string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    put("a", "a", "b")
    q = watch.heartbeats(spark.readStream.schema("k string").parquet(f"{tmp_path}/in"), "k", 3 / 60).writeStream.outputMode("append").foreachBatch(lambda df, n: seen.extend(tuple(r) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/c").start()
    def until(test):  # timers keep the query running, so it never has all done
        end = time.time() + 60
        while not test() and time.time() < end:
            time.sleep(0.2)
        assert test(), seen

    try:
        until(lambda: len(seen) == 2)
        assert sorted(seen) == [("a", "alive", 2), ("b", "alive", 1)]
        until(lambda: {("a", "silent", 2), ("b", "silent", 1)} <= set(seen))
        put("b")
        until(lambda: ("b", "alive", 2) in seen)
        put("b")
        time.sleep(4)
        put("b")
        until(lambda: any(k == "b" and n == 4 for k, _, n in seen))
        assert not any(k == "a" for k, _, _ in seen[4:])  # silence is told once
    finally:
        q.stop()
