import numpy as np
from pyspark.sql import functions as F

from silolake.operators import updates as U


def _long(spark, vecs, sizes=None, round_=0):
    rows = [(round_, f"s{i}", (sizes or [10] * len(vecs))[i], p, float(v)) for i, vec in enumerate(vecs) for p, v in enumerate(vec)]
    return spark.createDataFrame(rows, "round int, silo_id string, n long, pos int, v double")


def _vec(df):
    return [r["v"] for r in df.orderBy("pos").collect()]


def test_fedavg_pair(spark):
    assert _vec(U.fedavg(_long(spark, [[1, 2], [3, 4]]))) == [2.0, 3.0]


def test_trimmed(spark):
    assert _vec(U.trimmed_mean(_long(spark, [[1], [2], [100]]))) == [2.0]
    assert _vec(U.trimmed_mean(_long(spark, [[1], [2], [3], [4], [100]]))) == [3.0]
    assert _vec(U.trimmed_mean(_long(spark, [[1], [5]]))) == [3.0]  # n <= 2·trim → median, not NaN


def test_cosine_and_qwra_against_numpy(spark):
    rng = np.random.default_rng(0)
    vecs = rng.normal(size=16) + 0.5 * rng.normal(size=(7, 16))  # honest updates share a direction
    vecs[3] *= -5  # a poisoned update points away from the median
    sizes = [100 * (i + 1) for i in range(7)]
    long = _long(spark, vecs.tolist(), sizes)
    med = np.median(vecs, axis=0)
    cos = vecs @ med / (np.linalg.norm(vecs, axis=1) * np.linalg.norm(med) + 1e-10)
    got = {r["silo_id"]: r["cos"] for r in U.update_cosine(long).collect()}
    assert np.allclose([got[f"s{i}"] for i in range(7)], cos)
    agg, flags = U.qwra(long)
    rej = {r["silo_id"]: r["rejected"] for r in flags.collect()}
    assert rej["s3"] and sum(rej.values()) == int((cos < 0).sum())
    keep = cos >= 0
    u = np.sqrt(np.array(sizes, dtype=float))[keep]
    d = (u / (u.sum() + 1e-10)) @ vecs[keep]
    assert np.allclose(_vec(agg), d)


def test_clip_and_noise(spark):
    df = spark.createDataFrame([(0, "s", [10.0, 0.0, 0.0, 0.0])], "round int, silo_id string, delta array<double>")
    c = U.l2_clip(df, 1.0).select(U.l2_norm(F.col("delta")).alias("n")).first()["n"]
    assert abs(c - 1.0) < 1e-12
    z = spark.createDataFrame([(0, "s", [0.0] * 4)], "round int, silo_id string, delta array<double>")
    noisy = U.gaussian_noise(z, 0.5, 1.0).first()["delta"]
    assert any(x != 0 for x in noisy)
    again = U.gaussian_noise(z.repartition(3), 0.5, 1.0).first()["delta"]
    assert noisy == again


def test_qwra_falls_back_to_trimmed_mean(spark):
    # a huge update aligned with the others survives the cosine filter but dominates the weighted mean
    rng = np.random.default_rng(1)
    u = np.ones(8)
    vecs = np.vstack([0.01 * u + 0.001 * rng.normal(size=(4, 8)), 100 * u])
    long = _long(spark, vecs.tolist(), [100, 100, 100, 100, 10000])
    agg, flags = U.qwra(long)
    rows = agg.orderBy("pos").collect()
    assert all(r["fallback"] for r in rows)
    s = np.sort(vecs, axis=0)
    assert np.allclose([r["v"] for r in rows], s[1:4].mean(axis=0))
    assert not any(r["rejected"] for r in flags.collect())
