import math
import random

from pyspark.sql import functions as F

from inkspect.operators import calibration


def plain(rows):
    """Newton steps to the end in plain Python."""
    n1 = sum(y for y, _ in rows)
    n0 = len(rows) - n1
    a, b = 0.0, math.log((n0 + 1) / (n1 + 1))
    for _ in range(200):
        ga = gb = aa = ab = bb = 0.0
        for y, m in rows:
            t = (n1 + 1) / (n1 + 2) if y else 1 / (n0 + 2)
            p = 1 / (1 + math.exp(a * m + b))
            d, w = t - p, p * (1 - p)
            ga, gb, aa, ab, bb = ga + m * d, gb + d, aa + m * m * w, ab + m * w, bb + w
        det = aa * bb - ab * ab
        a, b = a - 0.5 * (bb * ga - ab * gb) / det, b - 0.5 * (aa * gb - ab * ga) / det
    return a, b


def test_sigmoid_equals_plain_newton(spark):
    rng = random.Random(2)
    rows = [(int(rng.random() < 0.3), rng.gauss(0, 2)) for _ in range(400)]
    rows = [(y, m + 1.5 * y) for y, m in rows]
    df = spark.createDataFrame(rows, "label int, margin double")
    got = calibration.fit_sigmoid(df)
    assert all(abs(x - y) < 1e-6 for x, y in zip(got, plain(rows)))


def test_separable_and_one_sided_margins(spark):
    rows = [(int(i >= 20), float(i - 20) * 1000) for i in range(40)]
    a, b = calibration.fit_sigmoid(spark.createDataFrame(rows, "label int, margin double"))
    assert math.isfinite(a) and math.isfinite(b) and a < 0
    one = spark.createDataFrame([(1, 0.5)] * 8, "label int, margin double")
    assert calibration.fit_sigmoid(one) == (0.0, math.log(1 / 9))
    assert calibration.fit_sigmoid(one.limit(0)) == (0.0, 0.0)


def test_margins_come_from_models_without_the_row(spark):
    df = spark.createDataFrame([(i, i % 2, float(i)) for i in range(40)], "doc_id long, label int, x double")
    seen = []

    def fit(rows):
        ids = {r.doc_id for r in rows.select("doc_id").collect()}
        seen.append(ids)
        return lambda part: part.withColumn("margin", F.col("doc_id").isin(*ids).cast("double"))

    rows = calibration.cross_margins(df, fit).collect()
    assert len(rows) == 40 and {r.margin for r in rows} == {0.0}
    assert len(seen) == 5 and all(len(s) == 32 for s in seen)


def test_brier(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 0, 0.5), ("b", 1, 1.0)], "model string, label int, p1 double")
    assert {r.model: r.brier for r in calibration.brier(df, "model").collect()} == {"a": 0.25, "b": 0.0}
