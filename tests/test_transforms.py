"""Transforms and their inverses, registries, pixel operations."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import pixels as X
from tessella.operators import stats as ST
from tessella.operators import transforms as T


def test_chain_and_inverse(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0], [5.0]), (2, [3.0, 9.0], [7.0])], "id long, a array<double>, b array<double>")
    st = ST.as_struct(ST.dimension_statistics(rows.select(F.concat("a", "b").alias("v")), "v"))
    chain = T.Composed([T.Concat({"a": 2, "b": 1}, "v"), T.Normalize("v", "stats", "min_max")]).set_mode("eval")
    out = chain.apply(rows.crossJoin(st))
    assert [r["v"] for r in out.orderBy("id").collect()] == [[-1, -1, -1], [1, 1, 1]]
    back = chain.unapply(out.drop("a", "b")).orderBy("id").collect()
    assert [(r["a"], r["b"]) for r in back] == [([1, 2], [5]), ([3, 9], [7])]
    noisy = T.Perturb("a", "id", 0.5)
    assert noisy.set_mode("eval").apply(rows).first()["a"] == [1, 2]
    assert all(1 <= x <= 2 for x in noisy.set_mode("train").apply(rows).first()["a"])
    with pytest.raises(TypeError):
        noisy.unapply(rows)
    with pytest.raises(Exception, match="expected 3"):
        T.Concat({"a": 3}, "v").apply(rows).collect()


def test_registries(spark):
    T.augmentors.add("double")(lambda d: d.union(d))
    with pytest.raises(KeyError):
        T.augmentors.add("double")(None)
    assert T.augmented(spark.range(2), ["double", "double"]).count() == 8
    assert T.load_callable("math.sqrt")(9) == 3 and T.is_kind({"state": ["x"], "action": ["y"]}, {"x", "y"})
    with pytest.raises(KeyError):
        T.check_keys({"state": ["x"]}, ["state.x", "action.y"])
    assert T.replayed(spark.range(3), 4).count() == 12
    spec = {"vqa_checks": [{"question": "q"}], "must_pass_checks": [{"question": "m", "answer": True, "contains": "w"}]}
    assert T.check_list(spec) == [{"question": "m", "answer": "True", "contains": ["w"], "must_pass": True}, {"question": "q", "answer": "", "contains": [], "must_pass": False}]


def test_pixels(spark):
    x = np.arange(12.0).reshape(3, 4)
    assert (X.flip(x)[:, 0] == x[:, -1]).all() and X.crop(np.zeros((20, 40)), 0.95).shape == (19, 38)
    assert X.reflect_pad(x, 5, 6).shape == (5, 6) and X.reflect_pad(x, 20, 6)[0, 1] == x[0, 0]
    assert X.posterize(np.array([255.0, 130.0]), 1).tolist() == [128, 128] and np.allclose(X.grey(np.full((1, 1, 3), 9.0)), 9)
    assert X.best_correlation(x, np.roll(x, 1, 1), np.ones((3, 4), bool)) == pytest.approx(1) and np.isnan(X.best_correlation(x, x, np.zeros((3, 4), bool)))
    raw = io.BytesIO()
    np.savez(raw, d=np.array([1.0, np.nan, 4.0]))
    assert X.filled_depth(X.load_npz(raw.getvalue(), "d")).tolist() == [1, 4, 4]
    got = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), (None,)], "v array<double>").select(X.per_image(X.flip, (2, 2))("v")).collect()
    assert [r[0] for r in got] == [[2, 1, 4, 3], None]


def test_decoders_by_name(spark):
    import io

    import numpy as np

    from tessella.operators import transforms as X

    raw = io.BytesIO()
    np.save(raw, np.array([[1, 2], [3, 4]], np.int8))
    df = spark.createDataFrame([(bytearray("é", "utf-8"), bytearray(b'{"a": {"b": 7}}'), bytearray(raw.getvalue())), (None, bytearray(b"{"), None)], "t binary, `m.json` binary, a binary")
    got = X.decoded(df, {"t": "txt", "m.json": "json", "a": "npy"}).selectExpr("t", "try_variant_get(`m.json`, '$.a.b', 'int') AS b", "a").collect()
    assert [tuple(r) for r in got] == [("é", 7, [1, 2, 3, 4]), (None, None, None)]
    with pytest.raises(KeyError, match="known"):
        X.decoded(df, {"t": "gif"})
