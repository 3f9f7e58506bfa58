import struct

import pytest
from pyspark.sql import functions as F

from fathomline.operators import changes as C
from fathomline.plans import models as M
from fathomline.plans import status as S
from fathomline.plans.catalog import Catalog, CatalogError, Store, fingerprint
from fathomline.plans.migrate import MigrationError, Migrator
from fathomline.sources import embedders as E
from fathomline.streaming.maintenance import Worker, follow


@pytest.fixture
def catalog(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "c"))
    store = Store(spark, str(tmp_path / "store"))
    store.write("docs", spark.createDataFrame([(1, "a", "x"), (2, "bb", "x"), (3, None, "x"), (4, "poison", "x"), (5, "later", "x"), (6, "nan", "x")], "id long, body string, kind string"))
    return Catalog(store)


def vectors(catalog, name="docs", column="body_semantic"):
    return {r.id: r[column] for r in catalog.store.read(name).collect()}


def test_store_versions(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    assert s.read("t") is None and s.write("t", spark.range(3).toDF("x")) == 1
    old = s.read("t")
    assert s.write("t", spark.range(5).toDF("x"), note="y") == 2 and s.version("t")["note"] == "y"
    assert (old.count(), s.read("t").count()) == (3, 5) and s.names() == ["t"]
    assert fingerprint(old) == fingerprint(s.read("t"))


def test_enable_and_refusals(catalog):
    e = catalog.enable("docs", "body", "m", 3, ["id"])
    assert e.vector == "body_semantic" and set(vectors(catalog).values()) == {None}
    assert catalog.enable("docs", "body", "m", 3, ["id"], if_not_exists=True).id == e.id
    for args, more in ((("docs", "body", "m", 3, ["id"]), {}), (("docs", "body", "m2", 3, ["id"]), {"if_not_exists": True}), (("docs", "no", "m", 3, ["id"]), {}), (("docs", "kind", "m", 3, []), {}), (("none", "body", "m", 3, ["id"]), {}), (("docs", "kind", "m", 0, ["id"]), {}), (("docs", "kind", "m", 3, ["id"]), {"vector": "body_semantic"}), (("docs", "kind", "m", 3, ["id"]), {"distance": "x"}), (("docs", "kind", "m", 3, ["id"]), {"vector": "v" * 60}), (("docs", "body_semantic", "m", 3, ["id"]), {})):
        with pytest.raises(CatalogError):
            catalog.enable(*args, **more)
    same, again = catalog.set_format("docs", "body", None)
    new, changed = catalog.set_format("docs", "body", "$kind: $body")
    assert not again and changed and new.format == "$kind: $body"
    catalog.store.write("docs", catalog.store.read("docs").drop("kind"))
    assert catalog.check_drift() == [e.id] and catalog.find("docs", "body").state == "quarantined"
    catalog.disable("docs", "body", drop=True)
    assert "body_semantic" not in catalog.store.read("docs").columns and not catalog.entries()


def test_adopted_columns_stay(spark, catalog, tmp_path):
    catalog.store.write("own", spark.createDataFrame([(1, "a", [1.0, 2.0]), (2, "b", None)], "id long, body string, v array<float>"))
    with pytest.raises(CatalogError):
        catalog.adopt("own", "body", "m", 3, ["id"], "v")
    e = catalog.adopt("own", "body", "m", 2, ["id"], "v")
    w = Worker(catalog, {"m": E.MockEmbedder(2)})
    assert w.backfill(e) == 1 and w.drain() == 1 and vectors(catalog, "own", "v")[2] == [1.0, pytest.approx(1.001)]
    catalog.dump(str(tmp_path / "dump"))
    catalog.uninstall()
    assert "v" in catalog.store.read("own").columns and not catalog.entries()
    catalog.restore(str(tmp_path / "dump"))
    assert catalog.find("own", "body") == e


def test_write_path(catalog):
    e = catalog.enable("docs", "body", "m", 3, ["id"])
    w = Worker(catalog, {"m": E.MockEmbedder(3)}, C.Limits(max_retries=2, backoff_ms=10_000_000))
    assert w.backfill(e) == 5 and w.backfill(e) == 0  # coalesced
    assert w.refresh(e) == 5
    v = vectors(catalog)
    assert v[1] == pytest.approx([1.0, 1.001, 1.002]) and v[2][0] == 2 and v[3] is v[4] is v[5] is v[6] is None
    dead = {r.pk_value: r.last_error for r in w.dead().collect()}
    assert set(dead) == {"4", "6"} or "5" not in dead
    queue = w.jobs().collect()
    assert [r.attempts for r in queue] == [1] * len(queue) and all(r.claimed_at is None for r in queue)
    assert w.refresh(e) == 0  # what is left waits its time
    new = catalog.store.read("docs").select("id", F.when(F.col("id") == 4, "fine").when(F.col("id") == 2, None).otherwise(F.col("body")).alias("body"), "kind").where("id != 1")
    assert w.apply("docs", new) == 2
    w.drain()
    v = vectors(catalog)
    assert set(v) == {2, 3, 4, 5, 6} and v[2] is None and v[4][0] == 4
    n = w.retry_dead(e)
    assert n == len(dead) and w.dead().count() == 0
    with pytest.raises(ValueError):
        w.retry_dead(e, [12345])
    w.truncate("docs")
    assert w.jobs().count() == 0 and catalog.store.read("docs").count() == 0


def test_poison_is_found_by_halving():
    out = E.attempt(E.MockEmbedder(2).embed, ["a", "poison", "ccc", "short", "nan"], 2)
    assert [o[0] for o in out] == ["ok", "dead", "ok", "dead", "dead"]
    assert [o[0] for o in E.attempt(E.MockEmbedder(2).embed, ["a", "later"], 2)] == ["retry", "retry"]
    assert list(E.batches_of(["a"] * 5, 2)) == [[0, 1], [2, 3], [4]] and list(E.batches_of(["aaaa", "b", "c"], 9, 3)) == [[0], [1, 2]]
    assert all(len(b) * max([5, 400, 7, 512][i] for i in b) <= 32 * 512 for b in E.padded_batches([5, 400, 7, 512]))
    assert E.embed(E.MockEmbedder(1), "abc") == [3.0] and E.convert(E.MockConverter(2, 2), [1, 2]) == [3.0, 3.01]
    for bad in ([], [float("inf")]):
        with pytest.raises(ValueError):
            E.convert(E.MockConverter(), bad)
    bridge = E.Bridge(E.MockEmbedder(2), E.RowNormaliser(E.ConvertBridge(E.MockConverter(2, 3), E.Identity(3))))
    assert sum(x * x for x in bridge.embed(["abc"])[0]) == pytest.approx(1)


def test_chunked_entry(spark, catalog):
    catalog.store.write("long", spark.createDataFrame([(1, "First part is here. " * 8), (2, "brief"), (3, "  ")], "id long, body string"))
    e = catalog.enable("long", "body", "m", 2, ["id"], chunking="recursive", chunk_size=64, chunk_overlap=0)
    w = Worker(catalog, {"m": E.MockEmbedder(2)})
    w.backfill(e)
    w.drain()
    chunks = catalog.store.read(e.destination).orderBy("chunk_id").collect()
    assert [c.chunk_id for c in chunks] == [1, 2, 3, 4] and [c.source_pk for c in chunks] == [1, 1, 1, 2]
    assert all(c.body_semantic[0] == len(c.chunk_text) for c in chunks)
    w.apply("long", spark.createDataFrame([(1, "new text"), (2, "brief")], "id long, body string"))
    assert {c.source_pk for c in catalog.store.read(e.destination).collect()} == {2}  # stale text is gone at once
    w.drain()
    chunks = catalog.store.read(e.destination).orderBy("chunk_id").collect()
    assert [(c.chunk_id, c.chunk_text) for c in chunks] == [(4, "brief"), (5, "new text")]  # ids are not used again
    assert w.keeper.kept["long.body"].n == 4  # of the first drain: the next refresh is not due yet
    catalog.disable("long", "body", drop=True)
    assert catalog.store.read(e.destination) is None


def test_cursor_backfill(catalog):
    e = catalog.enable("docs", "body", "m", 3, ["id"])
    w = Worker(catalog, {"m": E.MockEmbedder(3)})
    e, n = w.backfill_page(e, 2)
    assert (n, e.watermark) == (2, "2")
    assert w.backfill_page(e, 2)[1] == 0  # the queue is deep enough
    w.drain()
    e, n = w.backfill_page(e, 10)
    assert n == 3
    w.drain()
    assert w.backfill_page(e, 10)[0].backfill == "done"


def test_change_stream(spark, catalog, tmp_path):
    catalog.enable("docs", "body", "m", 3, ["id"])
    w = Worker(catalog, {"m": E.MockEmbedder(3)})
    feed = str(tmp_path / "feed")
    spark.createDataFrame([(1, "old", "x", "upsert", 1), (1, "newer", "x", "upsert", 2), (2, None, "x", "delete", 3), (9, "nine", "x", "upsert", 4)], "id long, body string, kind string, __op string, __seq long").write.parquet(feed)
    stream = spark.readStream.schema("id long, body string, kind string, __op string, __seq long").parquet(feed)
    q = follow(w, stream, "docs", "id", str(tmp_path / "state"))
    q.awaitTermination(120)
    assert q.exception() is None
    v = vectors(catalog)
    assert v[1][0] == 5 and v[9][0] == 4 and 2 not in v


def test_migration(spark, catalog):
    catalog.store.write("mig", spark.createDataFrame([(1, "a", [1.0] * 3), (2, "bb", [2.0] * 3), (3, "ccc", [3.0] * 3), (4, "no vector yet", None)], "id long, body string, body_semantic array<float>"))
    e = catalog.adopt("mig", "body", "m", 3, ["id"], "body_semantic")
    g = Migrator(catalog, {"m3": E.MockEmbedder(5)}, {("m", "m2"): E.MockConverter(3, 4)}, batch_rows=2)
    m = g.start("mig", "body", "m2")
    assert (m.strategy, m.new_dim, m.rows_total) == ("convert", 4, 3)
    with pytest.raises(MigrationError):
        g.start("mig", "body", "m3")
    m = g.step(m)
    assert (m.rows_done, m.last_pk) == (2, "2")
    with pytest.raises(MigrationError):
        g.finalize(m)
    df = catalog.store.read("mig")  # a fresh write meanwhile is newer than its conversion
    catalog.store.write("mig", df.withColumn("body_semantic_new", F.when(F.col("id") == 3, F.array(*[F.lit(9.0).cast("float")] * 4)).otherwise(F.col("body_semantic_new"))))
    m = g.run(m)
    assert m.state == "awaiting_finalize" and g.finalize(m).state == "done"
    v = vectors(catalog, "mig")
    assert v[1] == pytest.approx([3.0, 3.01, 3.02, 3.03]) and v[3] == [9.0] * 4 and v[4] is None
    assert catalog.find("mig", "body").model == "m2"
    m = g.run(g.start("mig", "body", "m3"))
    m, lost = g.abort(m)
    assert m.state == "aborted" and [r.id for r in lost.collect()] == [4] and "body_semantic_new" not in catalog.store.read("mig").columns
    assert e.id == m.registry_id and [r.percent for r in S.progress(catalog.store.read("migrations")).orderBy("id").collect()] == [66.7, 100.0]


def test_status(spark):
    registry = spark.createDataFrame([(1, "solo", "s1"), (2, "gone", "s9"), (3, "s3", "s3")], "id long, model string, space string")
    models = spark.createDataFrame([("solo", "embed", None, None, 1, 8, None, "{}", None), ("b", "embed", None, "s1", 1, 8, None, "{}", None), ("c", "convert", "s1", "s3", 8, 4, None, "{}", None)], M.MODELS)
    jobs = spark.createDataFrame([], C.JOBS)
    rows = S.status(registry, jobs, jobs, M.routes(models), models, F.current_timestamp()).collect()
    assert [(r.route, r.execution, r.pending) for r in rows] == [("solo", "local", 0), (None, None, 0), ("c", "bridge", 0)]


def test_catalogue_and_word_vectors(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"name":"a","target_dim":3,"sequence_len":512,"tokenizer_max_length":256,"node":1}\n{"name":"a","target_dim":4,"sequence_len":512,"node":2}\n{"name":"c","source_model":"x","target_model":"y","node":1}\n')
    got = {r.name: (r.model_type, r.target_dim, r.sequence_len) for r in M.catalogue(spark, str(tmp_path / "m.json")).collect()}
    assert got == {"a": ("embed", 4, 512), "c": ("convert", None, None)}
    odd = spark.createDataFrame([("a", "embed", None, "s", 1, 3, None, "{}", None), ("b", "embed", None, "s", 1, 4, None, "{}", None)], M.MODELS)
    assert [r.name for r in M.one_width(odd).collect()] == ["a"]
    (tmp_path / "w.bin").write_bytes(b"2 2\nKing " + struct.pack("<2f", 3, 4) + b"\nqueen " + struct.pack("<2f", 0, 2))
    words = {r.word: list(r.vector) for r in E.word_vectors(spark, str(tmp_path / "w.bin")).collect()}
    assert words["king"] == pytest.approx([0.6, 0.8]) and words["queen"] == [0, 1]


def test_patches_are_merged_and_cost_what_changes(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.write("t", spark.range(1000).selectExpr("id as a", "id % 7 as b", "cast(null as string) as v", "'x' as w"), token="k")
    for i in range(12):
        s.patch("t", ["a", "b"], "v", spark.range(1000).where(f"id % 100 = {i}").selectExpr("id as a", "id % 7 as b", f"'v{i}' as value"))
    s.patch("t", ["a", "b"], "v", spark.createDataFrame([(3, 3, None), (4, 4, "again"), (4, 5, "no such key")], "a long, b long, value string"))
    s.patch("t", ["a", "b"], "w", spark.createDataFrame([(3, 3, "y")], "a long, b long, value string"))
    rows = {r.a: (r.v, r.w) for r in s.read("t").collect()}
    assert len(rows) == 1000 and rows[3] == (None, "y") and rows[4] == ("again", "x") and rows[103] == ("v3", "x") and rows[50] == (None, "x")
    assert s.version("t")["n"] == 1 and s.version("t")["token"] == "k"
    s.patch("t", ["a", "b"], "v", spark.range(200).selectExpr("id as a", "id % 7 as b", "'late' as value"))
    v = s.version("t")
    assert v["n"] == 2 and v["token"] == "k" and not v.get("patches")  # merged: a quarter of the rows had patches
    assert s.read("t").where("v = 'late'").count() == 200 and s.read("t").where("v is not null").count() == 200 + 12 * 8
    for i in range(12):
        s.write("t", spark.range(i).toDF("x"))
    assert s.read("t").count() == 11 and len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v=")]) == 8


def test_drain_has_no_bound_of_its_own(catalog):
    e = catalog.enable("docs", "body", "m", 3, ["id"])
    w = Worker(catalog, {"m": E.MockEmbedder(3)}, C.Limits(batch_rows=1))
    w.backfill(e)
    assert w.drain(2) == 2 and w.counters["left"] == 3
    left = iter([1] * 250 + [0])
    w.refresh = lambda entry: next(left)
    assert w.drain() == 250


def test_a_lost_round_adds_no_letter_twice(catalog):
    e = catalog.enable("docs", "body", "m", 3, ["id"])
    w = Worker(catalog, {"m": E.MockEmbedder(3)})
    w.backfill(e)
    write = catalog.store.write

    def failing(name, df, **facts):
        if name == "jobs":
            raise RuntimeError("lost")
        return write(name, df, **facts)

    catalog.store.write = failing
    with pytest.raises(RuntimeError):
        w.refresh(e)
    catalog.store.write = write
    dead = sorted(r.pk_value for r in w.dead().collect())
    assert dead and w.jobs().count() == 5
    w.refresh(e)
    assert sorted(r.pk_value for r in w.dead().collect()) == dead and vectors(catalog)[2][0] == 2


@pytest.fixture
def pairs(spark, catalog):
    catalog.store.write("pairs", spark.createDataFrame([(1, 1, "a"), (1, 2, "bb"), (1, 3, "ccc"), (2, 1, "dddd"), (2, 2, None)], "a long, b long, body string"))
    return catalog


def both(catalog, column="body_semantic"):
    return {(r.a, r.b): r[column] and r[column][0] for r in catalog.store.read("pairs").collect()}


def test_keys_of_two_columns(spark, pairs):
    e = pairs.enable("pairs", "body", "m", 3, ["a", "b"])
    w = Worker(pairs, {"m": E.MockEmbedder(3)})
    pages = []
    while e.backfill != "done":
        e, n = w.backfill_page(e, 2)
        pages.append(n)
        w.drain()
    assert pages == [2, 2, 0, 0] and both(pairs) == {(1, 1): 1, (1, 2): 2, (1, 3): 3, (2, 1): 4, (2, 2): None}
    w.apply("pairs", spark.createDataFrame([(1, 1, "a"), (1, 2, "longer"), (2, 1, "dddd"), (2, 3, "x")], "a long, b long, body string"))
    assert sorted(r.pk_value for r in w.jobs().collect()) == ["(1,2)", "(2,3)"]
    w.drain()
    assert both(pairs) == {(1, 1): 1, (1, 2): 6, (2, 1): 4, (2, 3): 1}
    g = Migrator(pairs, {}, {("m", "m2"): E.MockConverter(3, 2)}, batch_rows=2)
    m = g.run(g.start("pairs", "body", "m2"))
    assert (m.rows_done, m.last_pk) == (4, '["2", "3"]') and g.finalize(m).state == "done"
    assert all(v is not None for v in both(pairs).values())


def test_chunks_of_keys_of_two_columns(spark, pairs):
    e = pairs.enable("pairs", "body", "m", 2, ["a", "b"], chunking="recursive", chunk_size=64, chunk_overlap=0)
    w = Worker(pairs, {"m": E.MockEmbedder(2)})
    w.backfill(e)
    w.drain()
    rows = pairs.store.read(e.destination).orderBy("chunk_id").collect()
    assert [(r.source_pk, r.chunk_text, r.body_semantic[0]) for r in rows] == [("(1,1)", "a", 1), ("(1,2)", "bb", 2), ("(1,3)", "ccc", 3), ("(2,1)", "dddd", 4)]
    w.apply("pairs", spark.createDataFrame([(1, 1, "a"), (1, 2, "new"), (2, 1, "dddd")], "a long, b long, body string"))
    w.drain()
    assert {(r.source_pk, r.chunk_text) for r in pairs.store.read(e.destination).collect()} == {("(1,1)", "a"), ("(1,2)", "new"), ("(2,1)", "dddd")}


def test_running_sums_and_turns(spark):
    df = spark.createDataFrame([(i, i // 3, (i * 7) % 11 if i % 13 else None) for i in range(300)], "id long, g long, n long").repartition(7)
    got = {r.id: r.s for r in C.with_running_sum(df, [F.col("g")], F.col("n"), "s").collect()}
    assert all(got[i] == sum((j * 7) % 11 for j in range(i // 3 * 3 + 3) if j % 13) for i in range(300))
    now = F.timestamp_seconds(F.lit(1000))
    jobs = spark.createDataFrame([(i, i % 4) for i in range(40)], "id long, registry_id long").withColumns({"not_before": F.timestamp_seconds(F.lit(0)), "claimed_at": F.lit(None).cast("timestamp"), "attempts": F.lit(0)})
    assert [r.registry_id for r in C.claim(jobs, now, 3).collect()] == [0, 1, 2]
    assert [r.registry_id for r in C.claim(jobs, now, 3, after=2).collect()] == [3, 0, 1]


def test_large_texts_are_skipped_and_failures_wait(spark, catalog):
    catalog.store.write("mig", spark.createDataFrame([(1, "a", [1.0] * 3), (2, "b" * 50, [2.0] * 3), (3, "later", [3.0] * 3)], "id long, body string, body_semantic array<float>"))
    catalog.adopt("mig", "body", "m", 3, ["id"], "body_semantic")
    g = Migrator(catalog, {"m3": E.MockEmbedder(5)}, {}, batch_rows=2, document_bytes=20, most_failures=2)
    waited = []
    m = g.run(g.start("mig", "body", "m3"), wait=waited.append)
    assert (m.state, m.rows_done, m.rows_skipped, m.failures) == ("failed", 1, 1, 3) and waited == [10.0, 20.0]


def test_observed_tables(spark, catalog):
    catalog.store.write("own", spark.createDataFrame([(1, "a gull", [1.0, 2.0]), (2, "a tern", None)], "id long, body string, v array<float>"))
    e = catalog.adopt("own", "body", "m", 2, ["id"], "v", observed=True)
    w = Worker(catalog, {"m": E.MockEmbedder(2)})
    assert catalog.index("own", "body").search_with_vector([1, 2]).first().pk_value == "1"
    assert w.apply("own", catalog.store.read("own").withColumn("body", F.lit("other"))) == 0 and w.jobs().count() == 0
    assert catalog.promote("own", "body").state == "active" and catalog.find("own", "body").id == e.id
    with pytest.raises(CatalogError):
        catalog.promote("own", "body")
    catalog.store.write("own", catalog.store.read("own").withColumn("v", F.col("v").cast("array<double>")))
    with pytest.raises(CatalogError):
        catalog.index("own", "body")


def test_formats_queue_and_control_state_is_kept(spark, catalog, tmp_path):
    e = catalog.enable("docs", "body", "m", 3, ["id"])
    w = Worker(catalog, {"m": E.MockEmbedder(3)})
    assert w.set_format("docs", "body", "$kind: $body") == 5 and w.set_format("docs", "body", "$kind: $body") == 0
    w.refresh(catalog.find("docs", "body"))
    dead, queue = w.dead().count(), w.jobs().count()
    assert dead
    catalog.dump(str(tmp_path / "dump"))
    high = catalog.store.version("jobs")["high_water"]
    for name in ("jobs", "jobs_dead", "registry"):
        catalog.store.drop(name)
    catalog.restore(str(tmp_path / "dump"))
    assert (w.dead().count(), w.jobs().count(), catalog.store.version("jobs")["high_water"]) == (dead, queue, high)
    assert catalog.find("docs", "body").format == "$kind: $body" and catalog.find("docs", "body").id == e.id


def test_aborted_migrations_queue_what_they_held(spark, catalog):
    catalog.store.write("mig", spark.createDataFrame([(1, "a", [1.0] * 3), (2, "bb", None)], "id long, body string, body_semantic array<float>"))
    catalog.adopt("mig", "body", "m", 3, ["id"], "body_semantic")
    w, g = Worker(catalog, {"m": E.MockEmbedder(3)}), Migrator(catalog, {"m3": E.MockEmbedder(5)}, {})
    assert w.abort(g, g.run(g.start("mig", "body", "m3"))).state == "aborted"
    assert [r.pk_value for r in w.jobs().collect()] == ["2"]


def test_all_dead_letters_are_retried_unless_bounded(spark):
    n = 100_200  # over what one call of the worker takes
    dead = spark.range(n).select("id", F.lit(1).cast("bigint").alias("registry_id"), F.col("id").cast("string").alias("pk_value"), F.lit("embed").alias("op"), F.lit(None).cast("bigint").alias("chunk_id"), F.col("id").alias("dead_id"))
    jobs, rest = C.retried(dead, dead.limit(0), None, F.current_timestamp())
    assert jobs.count() == n and rest.isEmpty()
    jobs, rest = C.retried(dead, dead.limit(0), None, F.current_timestamp(), most=200)
    assert sorted(r.dead_id for r in jobs.select("dead_id").collect()) == list(range(200)) and rest.count() == n - 200
