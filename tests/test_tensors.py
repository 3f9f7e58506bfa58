import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fathomline.functions import tensors as T


def test_tensors(spark):
    df = spark.createDataFrame([("[[1,2,3],[4,5,6]]", "1.5"), ("x", "no"), (None, '"2"')], "j string, s string")
    m = T.from_json("j", 2)
    rows = df.select(T.tensor(m, 2).alias("t"), T.reshaped(T.tensor(m, 2), 3, -1).alias("r"), T.nested(T.tensor(m, 2), 3).alias("n"), T.try_float("s").alias("f"), T.integers(T.tensor(m, 2)).alias("i")).collect()
    assert rows[0].t.shape == [2, 3] and rows[0].t["values"] == [1, 2, 3, 4, 5, 6]
    assert rows[0].r.shape == [3, 2] and rows[0].n == [[1, 2, 3], [4, 5, 6]] and rows[0].i == [1, 2, 3, 4, 5, 6]
    assert [r.f for r in rows] == [1.5, None, 2.0] and rows[1].t is None and rows[2].t is None
    one = spark.range(1)
    for bad in (T.from_json(F.lit("[[1],[2,3]]"), 2), T.tensor(F.array(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))), 2), T.reshaped(T.tensor(F.array(F.lit(1.0)), 1), 2)):
        with pytest.raises(PySparkException):
            one.select(bad).collect()
    with pytest.raises(ValueError):
        T.reshaped("t", -1, -1)
    with pytest.raises(ValueError):
        T.from_json("j", 6)
