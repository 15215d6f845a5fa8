"""Readers that had no test: listings, registries, arrays, checks, captions, cameras, validators, virtual rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import mixture as M
from tessella.operators import prep as P
from tessella.sources import readers


def test_listing_by_suffix_below_a_folder(spark, tmp_path):
    for f in ("a.mp4", "x/b.mp4", "x/y/c.txt"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_bytes(b"12345")
    got = readers.list_files(spark, str(tmp_path), "*.mp4")
    assert sorted((r.path.rsplit("/", 1)[1], r.length) for r in got.collect()) == [("a.mp4", 5), ("b.mp4", 5)] and "content" not in got.columns


def test_datasets_by_name(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t")
    readers.register("three", lambda s, path: s.read.parquet(path))
    assert readers.dataset(spark, "three", f"{tmp_path}/t").count() == 3
    with pytest.raises(KeyError, match="three"):
        readers.dataset(spark, "four", "")


def test_arrays(spark, tmp_path):
    a, b = np.arange(6, dtype=np.int16).reshape(2, 3), np.array([0.5, np.nan])
    np.save(f"{tmp_path}/a.npy", a)
    np.savez(f"{tmp_path}/b.npz", left=a, right=b)
    got = {(r.path.rsplit("/", 1)[1], r.name): r for r in readers.read_arrays(spark, str(tmp_path)).collect()}
    assert set(got) == {("a.npy", ""), ("b.npz", "left"), ("b.npz", "right")}
    assert got["a.npy", ""].shape == [2, 3] and got["b.npz", "left"]["values"] == [0, 1, 2, 3, 4, 5] and np.isnan(got["b.npz", "right"]["values"][1])
    np.save(f"{tmp_path}/c.npy", np.array([{}], object))
    with pytest.raises(Exception, match="allow_pickle"):
        readers.read_arrays(spark, f"{tmp_path}/c.npy").collect()


def test_checks_of_yaml_files(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("vqa_checks:\n- question: Is it day?\n  answer: yes it is\n- question: What?\n  contains: [bus, car]\nmust_pass_checks:\n- {question: 'Is it real?', contains: one}\n")
    (tmp_path / "b.yaml").write_text("")
    got = [(r["at"], r.question, r.answer, r.contains, r.must_pass) for r in readers.read_checks(spark, f"{tmp_path}/*.yaml").orderBy("at").collect()]
    assert got == [(0, "Is it real?", "", ["one"], True), (1, "Is it day?", "yes it is", [], False), (2, "What?", "", ["bus", "car"], False)]


def test_caption_formats(spark, tmp_path):
    for f, text in {"videos/a.mp4": "v", "videos/b.mp4": "v", "metas/a.txt": " a bus \n"}.items():
        (tmp_path / f).parent.mkdir(exist_ok=True)
        (tmp_path / f).write_text(text)
    read = lambda *a: {r.video.rsplit("/", 1)[1]: r.caption for r in readers.caption_dataset(spark, str(tmp_path), *a).collect()}
    assert read() == {"a.mp4": "a bus", "b.mp4": None}
    with pytest.raises(ValueError, match="captions"):
        read("json")
    (tmp_path / "captions").mkdir()
    assert read() == {"a.mp4": "a bus", "b.mp4": None}  # an empty folder doesn't count
    (tmp_path / "captions/b.json").write_text('{"m": {"short": "a car", "long": "a red car"}}')
    assert read("auto", "long") == {"a.mp4": None, "b.mp4": "a red car"} and read("json", "none") == {"a.mp4": None, "b.mp4": "a car"}
    assert read("text") == {"a.mp4": "a bus", "b.mp4": None}
    with pytest.raises(ValueError, match="unknown"):
        read("xml")
    with pytest.raises(ValueError, match="neither"):
        readers.caption_dataset(spark, f"{tmp_path}/videos")


def test_camera_lines(spark):
    df = spark.createDataFrame([(" " + "  ".join(map(str, range(12))),)], "value string")
    assert readers.camera_rows(df).first().matrix == [*map(float, range(12)), 0, 0, 0, 1]
    got = spark.range(1).select(*readers.rescaled_intrinsics(*map(F.lit, (768.0, 432.0, 384.0, 216.0)))).first()
    assert tuple(got) == (1280, 704, 640, 352)


def test_validators(spark):
    put = lambda v, t: spark.createDataFrame([(v,)], f"v {t}")
    assert put("3", "string").select(P.checked_range(F.col("v"), 0, 3, "steps")).first()[0] == 3 and put(None, "int").select(P.checked_range(F.col("v"), 0, 3, "steps")).first()[0] is None
    assert put("a", "string").select(P.checked_choice(F.col("v"), ["a"], "mode")).first()[0] == "a" and put(12, "long").select(P.checked_multiple(F.col("v"), 4, "frames")).first()[0] == 12
    for bad, text in ((put(4, "int").select(P.checked_range(F.col("v"), 0, 3, "steps")), "steps is out"), (put("b", "string").select(P.checked_choice(F.col("v"), ["a"], "mode")), "mode is none"), (put(13, "long").select(P.checked_multiple(F.col("v"), 4, "frames")), "frames is no")):
        with pytest.raises(Exception, match=text):
            bad.collect()


@pytest.mark.parametrize("most", [0, 20_000])
def test_virtual_rows(spark, monkeypatch, most):
    monkeypatch.setattr(M, "MOST_PARTS", most)
    rng = np.random.default_rng(1)
    parts = [(f"d{k:03d}", int(n), int(n * f)) for k, (n, f) in enumerate(zip(rng.integers(0, 9, 70), rng.choice([1, 2, 40], 70), strict=True))]
    table = [(d, r % n) for d, n, v in parts for r in range(v)]
    index = [int(i) for i in rng.integers(-5, 4 * len(table), 500)] + [0, len(table) - 1, len(table)]
    df = spark.createDataFrame([(i, k) for k, i in enumerate(index)], "i long, id long").repartition(3)
    got = {r.id: (r.dataset, r["row"]) for r in M.locate(df, spark.createDataFrame(parts, "dataset string, n long, virtual long")).collect()}
    assert got == {k: table[i % len(table)] for k, i in enumerate(index)}
    none = M.locate(df, spark.createDataFrame([("a", 0, 0)], "dataset string, n long, virtual long"))
    assert none.count() == 0 and none.columns == ["i", "id", "dataset", "row"]
