"""Tar shards in ranges, retried reads, and files that are written whole or not at all."""

import io
import json
import os
import tarfile
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import faults
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import sinks as K
from tessella.sources import readers, shards, stores


def make_tar(path, members, fmt=tarfile.GNU_FORMAT):
    with tarfile.open(path, "w", format=fmt) as t:
        folder = tarfile.TarInfo("folder")
        folder.type = tarfile.DIRTYPE
        t.addfile(folder)
        for name, data in members:
            m = tarfile.TarInfo(name)
            m.size = len(data)
            t.addfile(m, io.BytesIO(data))


def sample(n, seed=0):
    rng = np.random.default_rng(seed)
    return [(f"s{k:04d}.{x}", rng.bytes(int(rng.integers(0, 4000)))) for k in range(n) for x in ("jpg", "meta.json")]


@pytest.mark.parametrize("split", [512, 5000, 1 << 27])
@pytest.mark.parametrize("fmt", [tarfile.GNU_FORMAT, tarfile.PAX_FORMAT])
def test_members_by_ranges(spark, tmp_path, split, fmt):
    long = [("d" * 90 + "/" + "e" * 90 + ".jpg", b"long name"), ("plain", b"")]
    want = {}
    for k in range(2):
        make_tar(f"{tmp_path}/{k}.tar", sample(20, k) + long, fmt)
        want |= {(f"{k}.tar", n): d for n, d in sample(20, k) + long}
    (tmp_path / "notes.txt").write_text("no shard")
    rows = shards.read_shards(spark, str(tmp_path), splitBytes=split).collect()
    got = {(r.shard.rsplit("/", 1)[1], f"{r.key}.{r.suffix}" if r.suffix else r.key): bytes(r.data) for r in rows}
    assert len(rows) == len(want) and got == want
    assert sorted(r.position for r in rows if r.shard.endswith("0.tar"))[-1] == len(sample(20)) + 1
    only = shards.read_shards(spark, f"{tmp_path}/0.tar, {tmp_path}/1.tar", splitBytes=split, suffixes="meta.json").collect()
    assert len(only) == 40 and {r.suffix for r in only} == {"meta.json"}


def test_reads_go_on_after_faults(spark, tmp_path):
    make_tar(f"{tmp_path}/a.tar", sample(5))
    faults._seen.clear()
    size = os.path.getsize(f"{tmp_path}/a.tar")
    file = stores.Steady(f"{tmp_path}/a.tar", size, tries=4, wait=0.0001, how=faults.flaky)
    assert io.BufferedReader(file).read() == (tmp_path / "a.tar").read_bytes() and sum(faults._seen.values()) > 4
    faults._seen.clear()
    with pytest.raises(ConnectionResetError):
        stores.Steady(f"{tmp_path}/a.tar", size, tries=2, wait=0.0001, how=faults.flaky).readinto(bytearray(10))
    spark.sparkContext.addPyFile(os.path.join(os.path.dirname(__file__), "faults.py"))
    rows = shards.read_shards(spark, str(tmp_path), opener="faults.flaky", firstWait=0.0001, tries=4).collect()
    assert {f"{r.key}.{r.suffix}": bytes(r.data) for r in rows} == dict(sample(5))


def test_waits_double_up_to_a_longest(monkeypatch, tmp_path):
    waits = []
    monkeypatch.setattr(stores.time, "sleep", waits.append)
    monkeypatch.setattr(stores.random, "random", lambda: 0.5)
    def fails(path, offset):
        raise OSError("away")
    with pytest.raises(OSError):
        stores.Steady("x", 10, tries=9, wait=1.0, how=fails).readinto(bytearray(1))
    assert waits == [1, 2, 4, 8, 16, 30, 30, 30]


def test_over_http_by_range(spark, tmp_path):
    make_tar(f"{tmp_path}/a.tar", sample(6))
    raw, asked = (tmp_path / "a.tar").read_bytes(), []

    class Handler(BaseHTTPRequestHandler):
        def _head(self):
            at = int((self.headers.get("Range") or "bytes=0-")[6:-1])
            asked.append(at)
            self.send_response(206 if at else 200)
            self.send_header("Content-Length", str(len(raw) - at))
            self.end_headers()
            return at

        def do_HEAD(self):
            self._head()

        def do_GET(self):
            at = self._head()
            self.wfile.write(raw[at : at + 3000])  # the connection ends early
            self.close_connection = True

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/a.tar"
    rows = shards.read_shards(spark, url, firstWait=0.0001).collect()
    server.shutdown()
    assert {f"{r.key}.{r.suffix}": bytes(r.data) for r in rows} == dict(sample(6)) and max(asked) > 0


def test_a_shard_beyond_two_gigabytes(spark, tmp_path):
    """A sparse file: two large holes between small members."""
    path, hole = f"{tmp_path}/big.tar", 1300 << 20
    with open(path, "wb") as f:
        for k, size in enumerate([5, hole, 7, hole, 9]):
            m = tarfile.TarInfo(f"m{k}.{'bin' if size == hole else 'txt'}")
            m.size = size
            f.write(m.tobuf(tarfile.GNU_FORMAT))
            end = f.tell() + -(-size // 512) * 512
            if size != hole:
                f.write(bytes([65 + k]) * size)
            f.seek(end)
        f.write(bytes(1024))
    rows = shards.read_shards(spark, path, suffixes="txt")
    assert rows.rdd.getNumPartitions() >= 20
    assert {r.key: bytes(r.data) for r in rows.collect()} == {"m0": b"AAAAA", "m2": b"CCCCCCC", "m4": b"EEEEEEEEE"}


def test_written_shards_and_manifest(spark, tmp_path):
    rows = [(n.partition(".")[0], n.partition(".")[2], d) for n, d in sample(30)]
    df = spark.createDataFrame(rows, "key string, suffix string, data binary").repartition(3)
    shards.write_shards(df, f"{tmp_path}/out", shardBytes=20000)
    files = shards.manifest(f"{tmp_path}/out")
    assert files == sorted(f for f in os.listdir(f"{tmp_path}/out") if f.endswith(".tar")) and len(files) > 3
    back = shards.read_shards(spark, f"file:{tmp_path}/out").collect()
    assert sorted((r.key, r.suffix, bytes(r.data)) for r in back) == sorted(rows)
    whole = readers.samples(shards.read_shards(spark, f"{tmp_path}/out"), ["jpg", "meta.json"])
    assert whole.count() == 30
    shards.write_shards(df.limit(0), f"{tmp_path}/none")
    assert shards.manifest(f"{tmp_path}/none") == [] and shards.read_shards(spark, f"{tmp_path}/none").count() == 0


def test_failed_writes_leave_no_half_file(spark, tmp_path):
    bad = F.udf(lambda k: b"x" * 2000 if k != 700 else 1 / 0, "binary")
    rows = spark.range(0, 900, 1, 3).select(F.format_string("k%d", "id").alias("key"), F.lit("bin").alias("suffix"), bad("id").alias("data"))
    with pytest.raises(Exception):
        shards.write_shards(rows, f"{tmp_path}/a", shardBytes=50000)
    assert shards.manifest(f"{tmp_path}/a") is None
    for f in (tmp_path / "a").glob("*"):
        assert not f.name.startswith("_") and len(tarfile.open(f).getmembers()) > 0
    with pytest.raises(Exception):
        shards.write_files(spark.range(0, 60, 1, 3).select(F.format_string("%d.txt", "id").alias("path"), F.udf(lambda k: "y" * 50 if k != 50 else 1 / 0)("id").alias("content")), f"{tmp_path}/b")
    assert shards.manifest(f"{tmp_path}/b") is None and all(f.stat().st_size == 50 for f in (tmp_path / "b").glob("*"))
    with pytest.raises(Exception, match="below"):
        shards.write_files(spark.createDataFrame([("../x", "y")], "path string, content string"), f"{tmp_path}/c")


def test_results_keep_what_is_public(spark, tmp_path):
    kind = "name string, _raw string, frame_decay struct<mean: double, l1_per_frame: array<double>, _x: int>, eps array<struct<id: int, _f: int>>, none struct<a: int>"
    df = spark.createDataFrame([("a/1.json", "r", (0.5, [1.0], 1), [(1, 2), None], None), (None, "r", None, None, None)], kind)
    K.write_results(df, f"{tmp_path}/r", F.col("name"), ["name", "_raw", "frame_decay", "eps", "none"])
    got = json.loads((tmp_path / "r" / "a" / "1.json").read_text())
    assert got == {"name": "a/1.json", "frame_decay": {"mean": 0.5}, "eps": [{"id": 1}, None]}
    assert shards.manifest(f"{tmp_path}/r") == ["a/1.json"]


def test_telemetry_is_appended_by_iteration(spark, tmp_path):
    put = lambda rows: K.append_telemetry(spark.createDataFrame(rows, "iteration long, rank long, util double"), f"{tmp_path}/t")
    put([(1, 0, 0.5), (1, 1, 0.7)])
    put([(2, 0, 0.1)])
    put([(1, 0, 0.6), (1, 1, 0.8)])  # tried again
    got = K.read_telemetry(spark, f"{tmp_path}/t", "rank long, util double, iteration long")
    assert sorted(tuple(r) for r in got.select("iteration", "rank", "util").collect()) == [(1, 0, 0.6), (1, 1, 0.8), (2, 0, 0.1)]
    assert {(r.iteration, r.metric): (r.avg, r.max, r.min) for r in K.telemetry_summary(got, ["util"]).collect()}[1, "util"] == (pytest.approx(0.7), 0.8, 0.6)
