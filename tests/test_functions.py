"""Golden values and algebraic properties."""

import io
import math
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import pose as P
from tessella.functions import strings as T
from tessella.functions import vectors as V
from tessella.operators import evaluation as E
from tessella.operators import mixture as M
from tessella.operators import prep, ranks, shards
from tessella.operators import stats as ST
from tessella.operators import steps as S
from tessella.sources import readers
from tessella.streaming import stream


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


@pytest.mark.parametrize("n,train", [(0, 0), (1, 0), (19, 18), (20, 19), (21, 19), (100, 95)])
def test_tail_holdout(spark, n, train):
    rows = S.tail_holdout(spark.createDataFrame([(7, n)], "episode long, length long")).collect()
    assert len(rows) == n and sum(not r["is_test"] for r in rows) == train
    assert [r["row_no"] for r in sorted(rows, key=lambda r: r["base"])] == list(range(n))


def test_prefix_sum_over_blocks(spark):
    rows = spark.range(3000).select(F.col("id").alias("episode"), (F.col("id") % 7).alias("length"))
    got = {r["episode"]: r["before"] for r in S.prefix_sum(rows, "episode", "length", "before", width=100).collect()}
    want = np.concatenate([[0], np.cumsum(np.arange(3000) % 7)])
    assert all(got[k] == want[k] for k in range(3000))


def test_split_ranges(spark):
    r = one(spark, a=S.parse_ranges(F.lit("0:4, 7-9")), b=S.parse_ranges(F.lit("42")), c=S.parse_ranges(F.lit("5 3 3:4")))
    assert r["a"] == [0, 1, 2, 3, 4, 7, 8, 9] and r["b"] == [42] and r["c"] == [3, 4, 5]
    with pytest.raises(Exception, match="ends before"):
        one(spark, a=S.parse_ranges(F.lit("9:3")))


def test_nearest_ties_go_to_the_earlier(spark):
    q = spark.createDataFrame([(1, 0, 1.5), (1, 1, 9.0), (2, 2, 0.0)], "episode long, q long, t double")
    f = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (1, 2, 5.0)], "episode long, frame long, ft double")
    got = {r["q"]: r["frame"] for r in S.nearest(q, f, 100.0).collect()}
    assert got == {0: 0, 1: 2, 2: None}


def test_normalizers_on_constant_dimensions(spark):
    rows = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "v array<double>")
    st = ST.as_struct(ST.dimension_statistics(rows, "v"))
    both = rows.crossJoin(st)
    get = lambda mode: [r["y"] for r in both.select(V.normalize(F.col("v"), F.col("stats"), mode).alias("y")).collect()]
    assert get("min_max") == [[-1.0, 0.0], [1.0, 0.0]]
    assert get("scale") == [[pytest.approx(1 / 3), 1.0], [1.0, 1.0]]
    assert get("mean_std") == [[-1.0, 5.0], [1.0, 5.0]]
    assert [y[1] for y in get("q99")] == [1.0, 1.0]
    assert get("binary") == [[1.0, 1.0], [1.0, 1.0]]
    with pytest.raises(ValueError):
        V.denormalize(F.col("v"), F.col("stats"), "scale")


def test_pad_never_truncates(spark):
    r = one(spark, a=V.pad(F.array(F.lit(1.0)), 3), b=V.pad(F.array(F.lit(1.0), F.lit(2.0)), 1), c=V.resize(F.array(F.lit(1.0), F.lit(2.0)), 1)[0], m=V.resize(F.array(F.lit(1.0)), 3)[1])
    assert r["a"] == [1, 0, 0] and r["b"] == [1, 2] and r["c"] == [1] and r["m"] == [1, 0, 0]


def test_rotations(spark):
    """Each representation and back; intermediate matrices are columns, so that expressions stay small."""
    d = [F.lit(x) for x in (0.3, -0.2, 0.9, 0.1, 0.8, 0.4)]
    rows = spark.range(1).select(F.array(*P.rot6d_columns(d)).alias("m"))
    m = P.parts(F.col("m"), 9)
    rows = rows.select("m", F.array(*P.to_euler(m)).alias("a"), F.array(*P.to_quaternion(m)).alias("b"), F.array(*P.scaled_angle(m, 0.5)).alias("c"))
    half = P.parts(F.col("c"), 9)
    r = rows.select("m", F.array(*P.euler(P.parts(F.col("a"), 3))).alias("e"), F.array(*P.quaternion(P.parts(F.col("b"), 4))).alias("q"), F.array(*P.matmul(half, half)).alias("h"), F.array(*P.quaternion([F.lit(0.0)] * 4)).alias("z")).first()
    a = np.array(r["m"]).reshape(3, 3)
    assert np.allclose(a @ a.T, np.eye(3)) and np.linalg.det(a) == pytest.approx(1)
    for k in "eqh":
        assert np.allclose(np.array(r[k]).reshape(3, 3), a)
    assert np.allclose(np.array(r["z"]).reshape(3, 3), np.eye(3))


def test_half_turns_keep_their_axis(spark):
    for axis in ((1.0, 0.0, 0.0), (0.0, 0.6, 0.8), (-0.48, 0.6, 0.64)):
        u = np.array(axis) / np.linalg.norm(axis)
        turn = 2 * np.outer(u, u) - np.eye(3)
        half = np.array(one(spark, h=F.array(*P.scaled_angle([F.lit(float(v)) for v in turn.reshape(-1)], 0.5)))["h"]).reshape(3, 3)
        assert np.allclose(half @ half, turn, atol=1e-7)


def test_products_rays_and_inverses_against_numpy(spark):
    r = np.random.default_rng(3)
    turns = [np.linalg.qr(r.normal(size=(3, 3)))[0] for _ in range(4)]
    flat = lambda m: F.array(*[F.lit(float(v)) for v in np.asarray(m).reshape(-1)])
    vec = lambda v: [F.lit(float(x)) for x in v]
    t, o, d = r.normal(size=(3, 3))
    back, shift = P.look_at_inverse(vec(turns[0].reshape(-1)), vec(t))
    got = one(spark, p=P.product_in_order(F.array(*map(flat, turns))), b=F.array(*back), s=F.array(*shift), ray=F.array(*P.plucker(vec(o), vec(d))))
    assert np.allclose(np.array(got["p"]).reshape(3, 3), turns[0] @ turns[1] @ turns[2] @ turns[3])
    assert np.allclose(np.array(got["b"]).reshape(3, 3), turns[0].T) and np.allclose(got["s"], -turns[0].T @ t)
    u = d / np.linalg.norm(d)
    assert np.allclose(got["ray"], [*np.cross(o, u), *u])


def test_frames_differ_between_conventions(spark):
    turn = P.euler([F.lit(0.0), F.lit(0.0), F.lit(math.pi / 2)])
    ref, at = [F.lit(0.0)] * 3, [F.lit(1.0), F.lit(0.0), F.lit(0.0)]
    r = one(spark, world=F.array(*P.hybrid_relative(at, turn, ref, turn)), own=F.array(*P.local_relative(at, turn, ref, turn)))
    assert np.allclose(r["world"][:3], [1, 0, 0]) and np.allclose(r["own"][:3], [0, -1, 0])


@pytest.mark.parametrize("seconds,count,last", [(27.0, 5, (20, 27)), (28.0, 6, (25, 28)), (32.0, 6, (25, 32)), (12.5, 2, (5, 12.5)), (7.5, 1, (0, 7.5))])
def test_caption_windows(spark, seconds, count, last):
    w = one(spark, w=shards.tail_windows(F.lit(seconds)))["w"]
    assert len(w) == count and (w[-1]["start"], w[-1]["end"]) == last


def test_caption_chunks(spark):
    got = lambda n, t: one(spark, w=shards.caption_chunks(F.lit(n).cast("long"), 256, t))["w"]
    assert [c["size"] for c in got(383, 4)] == [383]
    assert {c["size"] for c in got(641, 4)} == {256, 129}
    assert got(4, 121) is None


def test_strides(spark):
    got = one(spark, s=prep.valid_strides(F.lit(30.0), F.lit(100), 5, 4.0, 30.0), none=prep.valid_strides(F.lit(30.0), F.lit(10), 9, 25.0, 29.0))
    assert got["s"] == [1, 2, 3, 4, 5, 6, 7] and got["none"] == []


def test_repeat_factors_round_half_to_even(spark):
    rows = spark.createDataFrame([("a", 100, 1.0), ("b", 100, 2.5), ("c", 0, 0.02)], "dataset string, n long, ratio double")
    got = {r["dataset"]: r["factor"] for r in M.repeat_factors(rows).collect()}
    assert got == {"a": 1, "b": 2, "c": 2}


def test_rank_ranges():
    assert M.rank_ranges(10, 4) == [(0, 3), (3, 6), (6, 8), (8, 10)]
    assert M.rank_ranges(2, 3) == [(0, 1), (1, 2), (0, 1)]


def test_worker_allocation_covers_all(spark):
    groups = spark.createDataFrame([("16,9", 700), ("1,1", 200), ("9,16", 100)], "key string, n long")
    got = {r.key: r.workers for r in ranks.allocated_workers(groups, 16).collect()}
    assert sum(got.values()) == 16 and min(got.values()) >= 1 and got["16,9"] > got["1,1"] >= got["9,16"]


def test_answers(spark):
    check = lambda out, answer, words: one(spark, ok=T.answer_valid(F.lit(out), F.lit(answer), F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")))["ok"]
    assert check("Yes, a bus", "yes", []) and check("Yes, a bus", "yes", ["bus", "car"])
    assert not check("Yes, a bus", "yes", ["car"]) and not check("a bus", "", ["bus"]) and check("anything", "", [])


def test_blocklist(spark):
    got = lambda text: one(spark, w=T.blocked_word(F.lit(text), ["bad word", "evil"]))["w"]
    assert got("so EVIL!") == "evil" and got("a Bad   word here") == "bad word" and got("medieval") is None
    rows = spark.createDataFrame([("this is badw0rd",), ("clean text",), (None,)], "t string")
    assert [r[0] for r in rows.select(T.fuzzy_blocked(["badword"])("t")).collect()] == ["badword", None, None]


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(3)
    for n, m in ((3, 3), (4, 6), (6, 4), (1, 5)):
        c = rng.random((n, m))
        got = sum(c[p] for p in E.assignment(c))
        short, wide = (c, False) if n <= m else (c.T, True)
        want = min(sum(short[i, p[i]] for i in range(len(short))) for p in permutations(range(short.shape[1]), len(short)))
        assert got == pytest.approx(want) and len(E.assignment(c)) == min(n, m)


def test_ssim_and_components():
    a = np.random.default_rng(0).random((16, 16))
    assert E.ssim(a, a) == pytest.approx(1) and E.ssim(a, 1 - a) < 0.5
    m = np.array([[1, 1, 0, 1], [0, 1, 0, 1], [0, 0, 0, 0], [1, 0, 0, 1]], bool)
    assert E.components(m).max() == 4 and (E.components(m) > 0).sum() == m.sum()


def test_single_value_interval_and_slope(spark):
    rows = spark.createDataFrame([(1, 0, 9.0), (1, 1, 2.0)], "episode long, t long, l1 double")
    r = E.frame_decay(rows, ["episode"], 1, 2).first()
    assert r["n"] == 1 and r["mean_l1"] == 2.0 and math.isnan(r["slope"]) and math.isnan(r["late"])


def test_tar_shards_and_samples(spark, tmp_path):
    for k, keys in enumerate((["a", "b"], ["b", "c"])):
        with tarfile.open(tmp_path / f"{k}.tar", "w") as tar:
            for key in keys:
                for suffix in ("json", "txt") if key != "c" else ("json",):
                    data = f"{key}{suffix}{k}".encode()
                    info = tarfile.TarInfo(f"{key}.{suffix}")
                    info.size = len(data)
                    tar.addfile(info, io.BytesIO(data))
    rows = readers.tar_shards(spark, str(tmp_path))
    assert rows.count() == 7
    got = {r["key"]: bytes(r["txt"]) for r in readers.samples(rows, ["json", "txt"]).collect()}
    assert got == {"a": b"atxt0", "b": b"btxt0"}


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a long, b string")
    for kind in ("parquet", "json", "csv"):
        readers.write_any(df, str(tmp_path / f"t.{kind}"))
        assert readers.read_any(spark, str(tmp_path / f"t.{kind}"), "jsonl" if kind == "json" else None).count() == 1
    for bad in ("m.pkl", "m.pt", "m.xyz"):
        with pytest.raises(TypeError):
            readers.read_any(spark, bad)
    assert readers.uri_parts("team:s3://b/k") == ("team", "s3", "b/k") and readers.uri_parts("/a") == (None, "file", "/a")


def test_trajectory_dataset(spark, tmp_path):
    root = tmp_path / "set"
    (root / "meta").mkdir(parents=True)
    (root / "meta/episodes.jsonl").write_text('{"episode_index": 0, "length": 2, "x": 1}\n{"episode_index": 1, "length": 1}\n')
    (root / "meta/tasks.jsonl").write_text('{"task_index": 0, "task": "pick"}\n')
    (root / "meta/info.json").write_text('{"fps": 30,\n "chunks_size": 1000}')
    import pyarrow as pa
    import pyarrow.parquet as pq

    (root / "data/chunk-000").mkdir(parents=True)
    for e, n in ((0, 2), (1, 1)):
        pq.write_table(pa.table({"timestamp": [0.1 * k for k in range(n)]}), root / f"data/chunk-000/episode_{e:06d}.parquet")
    t = readers.trajectory_dataset(spark, str(root))
    assert t["episodes"].count() == 2 and t["info"].first()["fps"] == 30
    assert sorted(r["episode_index"] for r in t["steps"].collect()) == [0, 0, 1]
    assert readers.trajectory_roots(spark, f"{tmp_path}") and readers.trajectory_roots(spark, str(root)) == [str(root)]


def test_stream_resumes(spark, tmp_path):
    src = tmp_path / "in"
    base = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    base.where("event_id < 500").write.parquet(str(src))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    stream.run_available(stream.chunk_counts(stream.events(spark, str(src))), out, state)
    base.where("event_id >= 500").write.mode("append").parquet(str(src))
    stream.run_available(stream.chunk_counts(stream.events(spark, str(src))), out, state)
    got = {r["user_id"]: r["n"] for r in spark.read.parquet(f"{out}/batch=*").groupBy("user_id").agg(F.sum("chunks").alias("n")).collect()}
    want = {r["user_id"]: r["n"] // 12 for r in base.groupBy("user_id").agg(F.count("*").alias("n")).collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "episode long, length long")
    assert S.tail_holdout(empty).count() == 0 and S.enumerate_steps(empty).count() == 0
    parts = spark.createDataFrame([], "dataset string, n long, ratio double")
    assert M.repeat_factors(parts).count() == 0
