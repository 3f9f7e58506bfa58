import datetime as dt
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.operators import filters, knn, lexical
from fathomline.operators.search import HybridIndex, SearchError, Spec, key_text
from fathomline.sources.embedders import HashedEmbedder


@pytest.fixture(scope="module")
def docs(spark):
    t = lambda s: dt.datetime.fromisoformat(s)
    rows = [
        (1, "brass kettle with a copper lid", "kitchen", Decimal("80.00"), t("2024-09-12"), "north", None, "Lot 7 kettle", True, "p", [1.0, 0.0, 0.0]),
        (2, "canvas tent for two and a lantern", "camp", Decimal("9.25"), t("2023-02-03"), "south", t("2024-05-05"), "tent", False, "q", [0.0, 0.0, 1.0]),
        (3, "cast iron pan, seasoned twice", "kitchen", Decimal("42.75"), t("2024-11-30"), "west", None, "Lot 7 pan", False, "r", [0.9, 0.1, 0.0]),
    ]
    return spark.createDataFrame(rows, 'id long, body string, room string, cost decimal(8,2), made_at timestamp, side string, sold_at timestamp, label string, flag boolean, `odd"one` string, v array<float>')


@pytest.mark.parametrize("spec,want", [
    ({"room": "kitchen"}, [1, 3]), ({"sold_at": None}, [1, 3]), ({"sold_at": {"is_not": None}}, [2]), ({"cost": {"neq": 80, "lte": 43}}, [2, 3]), ({"made_at": {"gt": "2024-01-01"}}, [1, 3]), ({"side": ["north", "west"]}, [1, 3]),
    ({"side": {"in": ["north", "west"]}}, [1, 3]), ({"label": {"like": "Lot 7%"}}, [1, 3]), ({"label": {"ilike": "lOT%"}}, [1, 3]), ({"flag": True}, [1]), ({"flag": False}, [2, 3]), ({"cost": {"gte": 42.75, "lt": 80}}, [3]), ({"cost": 9.25}, [2]), ({'odd"one': "q"}, [2]), (None, [1, 2, 3]), ("{}", [1, 2, 3]),
])
def test_filter_matrix(docs, spec, want):
    assert [r.id for r in filters.filtered(docs, spec).orderBy("id").collect()] == want


@pytest.mark.parametrize("spec", ["[1]", "nope", {"nope": 1}, {"Room": "x"}, {"cost": {"above": 1}}, {"cost": {"in": 3}}, {"cost": []}, {"cost": [None]}, {"cost": list(range(257))}, {"cost": "abc"}, {"flag": "maybe"}, {"cost": {"like": "1%"}}, {"label": {"like": 3}}, {"sold_at": {"is_not": 1}}, {"cost": {"gt": None}}, {"cost": {"gt": {"x": 1}}}, {"cost": {}}, {"v": 1}, {f"c{i}": 1 for i in range(33)}, {"room": "x" * 70000}])
def test_filter_refusals(docs, spec):
    with pytest.raises(filters.FilterError):
        filters.compile_filter(docs, spec)


def test_bm25_by_hand(spark):
    df = spark.createDataFrame([(1, "oak oak oak oak"), (2, "elm"), (3, "elm stands beside an old river where no oak ever grew tall")], "id long, body string")
    s = lexical.statistics(df, "body")
    assert s.n == 3 and s.avgdl == pytest.approx((4 + 1 + 12) / 3) and s.of(["oak", "birch"]) == [2, 1]
    assert [r.id for r in lexical.scored(df, "body", "elm", s).orderBy(F.col("score").desc()).collect()] == [2, 3]
    sparse = lexical.statistics(spark.createDataFrame([(1, "two words"), (2, ""), (3, None), (4, "")], "id long, body string"), "body")
    assert sparse.n == 3 and sparse.avgdl == pytest.approx(2 / 3)
    tok = F.array(F.lit("ash"), F.lit("ash"), F.lit("ash"), F.lit("yew"))
    got = spark.range(1).select(lexical.bm25(tok, ["ash"], [3], 12, 5.0), lexical.bm25(tok, ["ash"], [50], 12, 5.0), lexical.bm25(tok, ["x"], [1], 12, 5.0), lexical.bm25(F.lit(None).cast("array<string>"), ["x"], [1], 12, 5.0)).first()
    tail = 3 * 2.2 / (3 + 1.2 * (0.25 + 0.75 * 4 / 5))
    assert got[0] == pytest.approx(np.log(1 + 9.5 / 3.5) * tail) and got[1] == pytest.approx(np.log(1 + 0.5 / 12.5) * tail) and got[2] == 0 and got[3] is None
    assert lexical.statistics(df.limit(0), "body").n == 0


@pytest.mark.parametrize("query", ["oak", "oak elm", "oak or elm", '"old river" or birch', '"river old"', "elm -oak", "birch", "", "-oak", 'tall -"no oak"'])
def test_index_scores_like_the_scan(spark, tmp_path, query):
    df = spark.createDataFrame([(1, "oak oak oak oak"), (2, "elm"), (3, "elm stands beside an old river where no oak ever grew tall"), (4, "old oak river tall"), (5, None), (6, "")], "id long, body string")
    ix = lexical.Index.build(df, "id", "body", str(tmp_path / "ix"))
    want = {r.id: pytest.approx(r.score) for r in lexical.scored(df, "body", query, lexical.statistics(df, "body")).collect()}
    got = ix.scored(query)
    assert (got is None) == (query == "-oak") and ix.n == 5
    assert got is None or {r.key: r.score for r in got.collect()} == want


def test_index_reads_only_the_terms_folders(spark, tmp_path):
    df = spark.createDataFrame([(i, f"word{i} common") for i in range(200)], "id long, body string")
    ix = lexical.Index.build(df, "id", "body", str(tmp_path / "ix"))
    plan = ix.scored("word7")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket#") or "PartitionFilters" in plan and "In(term" in plan or "EqualTo(term" in plan
    assert [r.key for r in ix.scored("word7").collect()] == [7] and ix.scored("common").count() == 200


def test_statistics_keeper(spark):
    df = spark.createDataFrame([(1, "a b")], "id long, t string")
    k = lexical.Keeper({"x": (df, "t", "simple"), "bad": (df, "missing", "simple")})
    assert k.stale({"x": 1, "bad": 1}, now=1e9) == "bad"
    assert k.refresh("bad", 1) and k.refresh("x", 1) is None and k.kept["x"].n == 1
    at = k.seen["x"][1]
    assert k.stale({"x": 1, "bad": 1}, at + 100) is None and k.stale({"x": 2, "bad": 1}, at + 10) is None
    assert k.stale({"x": 2, "bad": 1}, at + 100) == "x" and k.stale({"x": 1, "bad": 1}, at + 700) == "bad"
    k.truncated("x")
    assert k.stale({"x": 2, "bad": 1}, at + 40) == "x"


def index(docs, **more):
    return HybridIndex(docs, "id", "body", "v", 3, **more).refreshed()


@pytest.mark.parametrize("kept", [False, True])
def test_hybrid(docs, kept, tmp_path):
    ix = index(docs)
    if kept:
        ix.indexed(str(tmp_path / "ix"))
    rows = ix.search_with_vector([1, 0, 0], "copper lid").collect()
    assert rows[0].pk_value == "1" and rows[0].semantic_rank == rows[0].fts_rank == 1
    assert rows[0].rrf_score == pytest.approx(1 / 61) and len(rows) == 3
    assert [r.pk_value for r in ix.search_with_vector([1, 0, 0], "copper", filter={"room": "camp"}).collect()] == ["2"]
    only = ix.search_with_vector([1, 0, 0], "lantern", semantic_weight=0.0).collect()
    assert only[0].pk_value == "2" and [r.rrf_score for r in only[1:]] == [0, 0]
    assert all(r.fts_rank is None for r in ix.search_with_vector([1, 0, 0]).collect())
    third = ix.search_with_vector([1, 0, 0], "x", semantic_weight=0.3).first().rrf_score
    assert third == float(np.float32(0.3)) / 61
    for bad in ([1, 0], [1, 0, float("nan")], None):
        with pytest.raises(SearchError):
            ix.search_with_vector(bad, "x")


def test_degrading(docs):
    ix = index(docs)
    with pytest.warns(UserWarning):
        rows = ix.search("canvas lantern").collect()
    assert [(r.pk_value, r.rrf_score, r.semantic_rank) for r in rows] == [("2", 1 / 61, None)]
    with pytest.raises(SearchError):
        index(docs, degrade=False).search("x")
    with pytest.raises(filters.FilterError):
        index(docs, embed=lambda q: pytest.fail("embedded before the filter was checked")).search("x", filter={"nope": 1})
    assert index(docs, embed=lambda q: HashedEmbedder(3).embed([q])[0]).search("lantern").count() == 3


def test_arguments():
    assert (Spec().depth, Spec(100).depth, Spec(chunked=True).depth, Spec(50, chunked=True).depth, Spec(candidates=7).depth) == (50, 400, 200, 800, 7)
    for bad in (dict(limit=0), dict(limit=1001), dict(candidates=0), dict(candidates=100001), dict(rrf_k=0), dict(semantic_weight=1.1), dict(semantic_weight=float("nan"))):
        with pytest.raises(SearchError):
            Spec(**bad)


@pytest.mark.parametrize("kept", [False, True])
def test_chunked(spark, kept, tmp_path):
    docs = spark.createDataFrame([(1, "deep", "x"), (2, "flat", "y"), (3, "deep", "z")], "id long, shelf string, body string")
    chunks = spark.createDataFrame([(20, 1, 0, 0, 7, "a heron", [1.0, 0.0, 0.0]), (21, 1, 1, 7, 14, "a stork", [0.95, 0.05, 0.0]), (22, 2, 0, 0, 8, "a plover", [0.9, 0.1, 0.0]), (23, 3, 0, 0, 13, "a grey wagtail", [0.0, 0.0, 1.0])], "chunk_id long, source_pk long, chunk_seq int, char_start long, char_end long, chunk_text string, v array<float>")
    ix = HybridIndex(docs, "id", "body", "v", 3, chunks=chunks).refreshed()
    if kept:
        ix.indexed(str(tmp_path / "ix"))
    rows = ix.search_with_vector([1, 0, 0], "wagtail").collect()
    assert [r.pk_value for r in rows] == ["3", "1", "2"] and rows[1].chunk_text == "a heron" and rows[1].chunk_seq == 0
    assert rows[1].rrf_score == pytest.approx(0.5 / 61)  # the best chunk, not the sum
    assert {r.pk_value for r in ix.search_with_vector([1, 0, 0], "", filter={"shelf": "deep"}).collect()} == {"1", "3"}
    ix.degrade = True
    with pytest.warns(UserWarning):
        assert [r.pk_value for r in ix.search("heron").collect()] == ["1"]


def test_chunked_with_a_key_of_two_columns(spark):
    docs = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "z")], "a long, b long, body string")
    chunks = spark.createDataFrame([(1, "(1,1)", 0, 0, 1, "rook", [1.0, 0.0]), (2, "(1,2)", 0, 0, 1, "crow", [0.9, 0.1]), (3, "(2,1)", 0, 0, 1, "wren", [0.0, 1.0])], "chunk_id long, source_pk string, chunk_seq int, char_start long, char_end long, chunk_text string, v array<float>")
    rows = HybridIndex(docs, ["a", "b"], "body", "v", 2, chunks=chunks).refreshed().search_with_vector([1, 0], "").collect()
    assert [(r.pk_value, r.chunk_text) for r in rows] == [("(1,1)", "rook"), ("(1,2)", "crow"), ("(2,1)", "wren")]


def test_knn(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 8)).astype(np.float32)
    x[7] = x[9]
    df = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(x)), (999, None)], "id long, v array<float>").repartition(4)
    q = x[9].astype(float)
    for kind, d in (("l2", np.linalg.norm(x - q, axis=1)), ("ip", -(x @ q)), ("cosine", 1 - x @ q / np.linalg.norm(x, axis=1) / np.linalg.norm(q))):
        want = sorted(range(200), key=lambda i: (round(float(d[i]), 5), str(i)))[:12]
        got = knn.nearest(df, "id", "v", q.tolist(), 12, kind).orderBy("rank").collect()
        assert sorted(r.id for r in got) == sorted(want) and [r["rank"] for r in got] == list(range(1, 13))
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in (9, 50, 120)], "q long, w array<float>")
    many = knn.nearest_many(df, "id", "v", queries, "q", "w", 6, "l2").collect()
    for i in (9, 50, 120):
        one = [(r.id, r["rank"]) for r in knn.nearest(df, "id", "v", x[i].tolist(), 6, "l2").collect()]
        assert sorted((r.id, r["rank"]) for r in many if r.q == i) == sorted(one)
    odd = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (10, [0.0, 0.0]), (14, [1.0, 1.0]), (14, [1.0, 1.0]), (None, [1.0, 0.5]), (20, None)], "id long, v array<float>").repartition(3)
    asked = spark.createDataFrame([(i, v) for i, v in enumerate([[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]])], "q long, w array<float>")
    for kind in ("cosine", "l2", "ip"):
        for k in (1, 2, 4, 6, 9):
            many = knn.nearest_many(odd, "id", "v", asked, "q", "w", k, kind).collect()
            for r in asked.collect():
                one = knn.nearest(odd, "id", "v", list(r.w), k, kind).collect()
                assert sorted((str(x.id), x["rank"], str(x.distance)) for x in many if x.q == r.q) == sorted((str(x.id), x["rank"], str(x.distance)) for x in one), (kind, k, r)
    ivf = knn.InvertedLists.build(df, "id", "v", 8)
    assert ivf.ready_for("v", 8, "l2") and not ivf.ready_for("v", 8, "ip")
    whole = {r.id for r in ivf.search(q.tolist(), 10, probes=8).collect()}
    assert whole == {r.id for r in knn.nearest(df, "id", "v", q.tolist(), 10, "l2").collect()}
    assert ivf.search(q.tolist(), 150, probes=1).count() == 150


def test_keys(spark):
    df = spark.createDataFrame([(1, "a"), (2, 'x "y"'), (3, None), (4, ""), (5, "a,b")], "id long, s string")
    assert [r.k for r in df.orderBy("id").select(key_text("id", "s").alias("k")).collect()] == ["(1,a)", '(2,"x ""y""")', "(3,)", '(4,"")', '(5,"a,b")']


def test_functions_of_sql(spark):
    from fathomline.plans import sql

    assert sql.register(spark) == sql.register(spark)
    df = spark.createDataFrame([(1, "Oak, oak elm"), (2, "elm"), (3, None), (4, "")], "id long, body string")
    df.createOrReplaceTempView("woods")
    s = lexical.statistics(df, "body")
    want = {r.id: pytest.approx(r.score) for r in lexical.scored(df, "body", "oak or elm", s).collect()}
    dfs = dict(zip(["oak", "elm"], s.of(["oak", "elm"])))
    parts = " + ".join(f"lexical_score(t, '{w}', {d}, {s.n}, {float(s.avgdl)}D)" for w, d in dfs.items())
    rows = spark.sql(f"SELECT id, {parts} AS score, rrf_part(0.5D, 60, id) AS r, rrf_part(0.5D, 60, NULL) AS z FROM (SELECT id, lexical_tokens(body) AS t FROM woods) WHERE size(t) > 0").collect()
    assert {r.id: r.score for r in rows} == want and all(r.r == 0.5 / (60 + r.id) and r.z == 0 for r in rows)
