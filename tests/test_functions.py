import math
import time

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fathomline.functions import chunking as C
from fathomline.functions import templates as T
from fathomline.functions import text as X
from fathomline.functions import vectors as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_vector_edges(spark):
    lit = V.literal
    e = F.array().cast("array<double>")
    null = F.lit(None).cast("array<double>")
    want = [
        (V.cosine_similarity(lit([1, 0]), lit([0, 0])), 0.0), (V.cosine_distance(lit([1, 0]), lit([-1, 0])), 2.0), (V.euclidean_distance(lit([1, 2]), lit([4, 6])), 5.0),
        (V.angular_similarity(lit([1, 0]), lit([0, 1])), 0.5), (V.greatest_of(e), -math.inf), (V.least_of(e), math.inf), (V.variance(lit([3])), 0.0), (V.variance(lit([1, 2, 3, 4])), 5 / 3),
        (V.median(lit([4, 1, 3, 2])), 2.5), (V.percentile(lit([1, 2, 3, 4, 5]), 25), 2.0), (V.arg_max(lit([1, 3, 3])), 1), (V.arg_sort_descending(lit([1, 3, 3, 2])), [1, 2, 3, 0]),
        (V.cumulative_sum(lit([1, 2, 3])), [1.0, 3.0, 6.0]), (V.scaled_to_sum(lit([1, 3])), [0.25, 0.75]), (V.count_uniques(lit([0.0, -0.0, 1.0])), 3), (V.is_zero(lit([0, 0])), True),
        (V.as_longs(lit([1.9, -1.9, math.nan, 1e30, -1e30])), [1, -1, 0, 2**63 - 1, -(2**63)]), (V.quantile_slice(lit([1, 2, 3, 4, 5]), 0.25, 0.75), [2.0, 3.0, 4.0]), (V.norm(null), None), (V.dot(null, lit([1])), None),
        (V.tumbling(lit([1, 2, 3, 4]), 2), [[1.0, 2.0], [3.0, 4.0]]), (V.sliding(lit([1, 2, 3]), 2, 2), [[1.0, 2.0], [3.0, 0.0]]), (V.to_text(F.array(F.lit(1.0), F.lit(0.5)).cast("array<float>")), "[1,0.5]"),
        (V.from_text(F.lit(" [ 1, 2.5 ]")), [1.0, 2.5]), (V.from_text(F.lit("[]")), []), (V.shortened(lit([0.6, 0.8, 0.0]), 1), [1.0]), (V.shortened(lit([6, 8, 0]), 1), [6.0]), (V.reshaped(lit([1, 2, 3, 4]), 2, 2), [[1.0, 2.0], [3.0, 4.0]]),
        (V.shape(F.array(lit([1, 2, 3]), lit([4, 5, 6])), 2), [2, 3]), (V.search_distance("ip", lit([1, 2]), lit([3, 4])), -11.0), (V.normalized(lit([0, 0])), [0.0, 0.0]), (V.to_base64(lit([1.0])), "AACAPw=="), (V.from_bytes(F.lit(bytearray(b"abc"))), None),
        (V.filled(2, 1.5), [1.5, 1.5]), (V.multinomial(lit([0, 0]), 5), [0, 0]), (V.half_precision(lit([0.1])), [0.0999755859375]),
    ]
    got = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(want)]).first()
    for i, (_, w) in enumerate(want):
        assert got[i] == (pytest.approx(w) if isinstance(w, float) and math.isfinite(w) else w), i
    assert math.isnan(one(spark, V.search_distance("cosine", lit([0.0, 0.0]), lit([1, 0]))))
    assert sum(one(spark, V.multinomial(lit([1, 2, 3]), 30))) == 30
    assert len(one(spark, V.random_sample(lit([1, 2, 3]), 2))) == 2 and len(one(spark, V.random_sample(lit([1, 2]), 5, True))) == 5
    assert one(spark, V.sampled(lit([9, 0, 0]), 0.5)) == 0 and [s.i for s in one(spark, V.nucleus(lit([0, 5, 1]), 0.9))] == [1]
    for bad in (V.dot(lit([1]), lit([1, 2])), V.mean(e), V.normalized_strict(lit([0])), V.z_scores(lit([1, 1])), V.tumbling(lit([1, 2, 3]), 2), V.shortened(lit([1]), 2), V.scaled_to_max(lit([0])), V.random_sample(lit([1]), 2), V.reshaped(lit([1, 2, 3]), 2, 2)):
        with pytest.raises(PySparkException):
            one(spark, bad)
    with pytest.raises(ValueError):
        V.search_distance("manhattan", lit([1]), lit([1]))


def test_queries_parse():
    terms = lambda q: X.positive_terms(X.parse_query(q))
    assert terms("red OR blue -green") == ["blue", "red"] and terms('red -"blue green"') == ["red"]
    assert terms("-red") == [] and terms('"red blue" OR green') == ["blue", "green", "red"]
    assert X.parse_query("") is None and X.parse_query(" OR - !!") is None


def test_matching(spark):
    rows = ["red blue green", "blue red", "green", "", None, "Red, BLUE!", "red x blue"]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, text string")
    for q, want in (("red blue", [0, 1, 5, 6]), ('"red blue"', [0, 5]), ("red -green", [1, 5, 6]), ("green OR x", [0, 2, 6]), ('-"red blue" red', [1, 6]), ("", [])):
        got = df.where(X.matches(X.tokens("text"), X.parse_query(q))).orderBy("id").collect()
        assert [r.id for r in got] == want, q


def test_english(spark):
    for a, b in (("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("happy", "happi"), ("generalization", "gener"), ("oscillators", "oscil"), ("adoption", "adopt"), ("controlling", "control")):
        assert X.stem(a) == b
    df = spark.createDataFrame([(1, "The running dogs were happily adopted"), (2, None)], "id long, text string")
    assert df.select(X.tokens("text", "english").alias("t")).collect()[0].t == [None, "run", "dog", None, "happili", "adopt"]
    assert df.withColumn("t", X.tokens("text", "english")).where(X.matches(F.col("t"), X.parse_query('"the dog" OR "dogs were happily"', "english"))).count() == 1
    v = df.select(X.text_vector(X.tokens("text")).alias("v")).collect()[0].v
    assert [(s.lexeme, s.positions) for s in v][:2] == [("adopted", [6]), ("dogs", [3])]


def test_cover_density(spark):
    tok = F.array(*map(F.lit, "a x b a b".split()))
    assert one(spark, X.cover_density(tok, ["a", "b"])) == pytest.approx(0.1 / 2 + 0.1 + 0.1)
    assert one(spark, X.cover_density(tok, ["a", "z"])) == 0


BY_HAND = [
    ("eel cod ray", 8, 0, [(0, 8, "eel cod "), (8, 11, "ray")]),
    ("eel cod ray", 9, 2, [(0, 8, "eel cod "), (6, 11, "d ray")]),
    ("No. Yes! Me", 9, 0, [(0, 4, "No. "), (4, 11, "Yes! Me")]),
    ("up\r\n\r\ndown", 6, 0, [(0, 6, "up\r\n\r\n"), (6, 10, "down")]),
    ("", 70, 0, []),
    ("\t \n\n", 70, 5, []),
    ("\u2003\u3000", 70, 5, []),
    ("k" * 70, 70, 5, [(0, 70, "k" * 70)]),
]


@pytest.mark.parametrize("text,size,overlap,want", BY_HAND)
def test_split_by_hand(text, size, overlap, want):
    assert [c[1:] for c in C.split(text, size, overlap)] == want


def test_split_bounds():
    whales = C.split("🐳" * 9, 4, 0)
    assert [c[1:3] for c in whales] == [(0, 4), (4, 8), (8, 9)]
    w = C.split("w" * 95, 25, 5)
    assert all(a[2] - b[1] == 5 for a, b in zip(w, w[1:])) and w[-1][2] == 95
    v = C.split("v" * 300, 80, 60)
    assert {b[1] - a[1] for a, b in zip(v, v[1:])} == {20}
    # 10 000 chunks, 32 MiB and four times the text are the bounds.
    sections = lambda n: ("s" * 50 + "\n\n") * n
    assert len(C.split(sections(10_000), 70, 0)) == 10_000
    for text, size, overlap in (("v" * 300, 80, 78), ("v" * 2000, 200, 180), (sections(10_001), 70, 0), ("v", 0, 0), ("v", 6, 6), ("ü" * (17 << 20), 90, 0)):
        with pytest.raises(C.SplitError):
            C.split(text, size, overlap)
    assert C.split("v" * 2000, 200, 150)
    with pytest.raises(C.SplitError):
        C.check_geometry(63, 0)
    assert C.check_geometry(64, 60) and not C.check_geometry(2000, 200)


def test_split_invariants():
    import random

    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice("ab. ,;\n\r!?é🦀 ") for _ in range(rng.randint(0, 300)))
        size = rng.randint(1, 40)
        overlap = rng.randint(0, size // 2)
        chunks = C.split(text, size, overlap)
        covered = set()
        for k, (seq, a, b, t) in enumerate(chunks):
            assert seq == k and t == text[a:b] and 0 < b - a <= size and t.strip()
            covered.update(range(a, b))
        assert all(x[1] < y[1] and x[2] < y[2] for x, y in zip(chunks, chunks[1:]))
        assert all(i in covered for i, ch in enumerate(text) if not ch.isspace())


def test_split_column(spark):
    df = spark.createDataFrame([(1, "aaa bbb ccc ddd"), (2, None), (3, "z" * 900)], "id long, text string")
    chunks, refused = C.chunked(df, "id", "text", 10, 9)
    assert [(r.chunk_seq, r.char_start, r.chunk_text) for r in chunks.where("source_pk = 1").orderBy("chunk_seq").collect()][0] == (0, 0, "aaa bbb ")
    assert [r.source_pk for r in refused.collect()] == [3] and not chunks.where("source_pk != 1").count()


def test_templates(spark):
    assert T.parse("a$$b ${x}}y} $c_1.") == [("text", "a$b "), ("column", "x}y"), ("text", " "), ("column", "c_1"), ("text", ".")]
    for bad in ("$", "a $ b", "${", "${}", "x" * 17000, "".join(f"$c{i} " for i in range(65))):
        with pytest.raises(T.TemplateError):
            T.parse(bad)
    df = spark.createDataFrame([("é", None, 1), (None, "b", 2)], "a string, `b c` string, n int")
    rows = df.select(T.rendered("$$$a|${b c}|$n", "a").alias("t"), T.rendered_bytes("$$$a|${b c}|$n", "a").alias("n"), T.rendered(None, "a").alias("p")).collect()
    assert [tuple(r) for r in rows] == [("$é||1", 6, "é"), (None, None, None)]
    T.validate("$a $n", "a", df.columns, "v")
    T.validate("$n: $chunk", "a", df.columns, "v", chunked=True)
    for template, chunked in (("$n", False), ("$a $v", False), ("$a $zz", False), ("$n", True), ("$a $chunk", True)):
        with pytest.raises(T.TemplateError):
            T.validate(template, "a", [*df.columns, "v"], "v", chunked)


def test_z_scores_take_time_in_proportion_to_the_vector(spark):
    """Mean and deviation once a row: worked out for each value, the time was its cube, and these rows took minutes."""
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(40, 512))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "i int, v array<double>")
    began = time.perf_counter()
    got = {r.i: r.z for r in df.select("i", V.z_scores("v").alias("z")).collect()}
    assert time.perf_counter() - began < 30
    for i, r in enumerate(rows):
        assert got[i] == pytest.approx((r - r.mean()) / r.std(ddof=1))
    odd = spark.createDataFrame([([],), (None,)], "v array<double>")
    assert [r.z for r in odd.select(V.z_scores("v").alias("z")).collect()] == [[], None]
