import re
import zlib

import numpy as np
import pytest

from fathomline.llm import queries
from fathomline.llm import rule_ensemble as r
from fathomline.llm.common import text_block
from tests.llm.helpers import SCHEMA, documents
from tests.llm.test_repeats import words_by_hand
from tests.llm.test_simhash import by_hand as fingerprint
from tests.llm.test_simhash import groups


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    vocabulary = ["".join(rng.choice(list("aeiourstln"), rng.integers(2, 9))) for _ in range(2500)]

    def prose(n):
        w = rng.choice(vocabulary, n)
        return ". ".join(" ".join(w[i : i + 8]).capitalize() for i in range(0, n, 8)) + "."

    items = [prose(30) for _ in range(6)]
    passage = prose(70)
    texts, quality = [], []
    for i in range(160):
        texts.append(prose(int(rng.integers(60, 200))))
        quality.append(1)
    for i in range(40):
        texts.append(prose(90).upper().replace(" ", "!! "))
        quality.append(0)
    texts[10] = texts[11] = texts[3]
    texts[12] = texts[4] + " also"
    for i in (20, 21, 22):
        texts[i] += " " + passage + " " + prose(30)
    for i in (30, 31):
        texts[i] += " " + items[i - 30] + " " + prose(30)
    texts += [None, "", texts[5]]
    quality += [1, 1, 1]
    ids = [*range(len(texts) - 1), 5]
    where = str(tmp_path_factory.mktemp("corpus"))
    documents(spark, texts, ids).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in zip(ids, quality) if i % 2 or q == 0], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where, texts, ids, items


def test_stages_against_brute_force(spark, folder, tmp_path):
    import pyarrow as pa

    import corpus_pipeline

    where, texts, ids, items = folder
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "best_fit_packing"]
    out, docs = [], spark.read.parquet(f"{where}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, where).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        out.append(docs)
    columns = [f.split()[0] for f in SCHEMA.split(", ")]
    assert all(d.columns == columns for d in out[:-1])
    rows = [[(x.doc_id, x.text) for x in d.collect()] for d in out[:-1]]

    model = queries.quality_model(spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet"))
    score = model.score(r.statistics(*text_block(pa.array(texts))))
    good = [(i, t) for i, t, s in zip(ids, texts, score) if s >= 0.5]
    assert sorted(map(str, rows[0])) == sorted(map(str, good)) and {i for i, _ in good} >= set(range(160)) and not {i for i, _ in good} & set(range(160, 200))

    prints = [fingerprint(t) for _, t in good]
    pairs = [(a, b) for a in set(prints) for b in set(prints) if a < b and (a ^ b).bit_count() <= 2]
    root, first = groups(pairs, set(prints)), {}
    for (i, t), f in zip(good, prints):
        first.setdefault(root[f], set()).add(i)
    assert sorted(i for i, _ in rows[1]) == sorted(min(v) for v in first.values())
    assert {10, 11} & {i for i, _ in rows[1]} == set()

    left = sorted(rows[1], key=str)
    want = words_by_hand([t for _, t in left], [i for i, _ in left], 50)
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    assert sorted((str(i), len(split(t))) for i, t in rows[2]) == sorted((w[0], w[1] - w[2]) for w in want)
    assert sum(w[2] for w in want) >= 140
    assert all(x.n_chars == len(x.text) for x in out[2].where("text is not null").collect())

    tokens = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    dirty = {i for i, t in rows[2] if any(tokens(b) in tokens(t) for b in items)}
    assert dirty == {30, 31} and sorted(map(str, rows[3])) == sorted(str(x) for x in rows[2] if x[0] not in dirty)

    pieces = out[4].collect()
    assert {p.doc_id for p in pieces} == {i for i, _ in rows[3]} and all(p.offset + p.length <= 2048 for p in pieces)
    whole = corpus_pipeline.run(spark, where).collect()
    assert sorted((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in whole) == sorted((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in pieces)
    assert zlib.crc32(b"\0\0\0\0") in {p.ids_crc32 for p in pieces}  # an empty text is its end id


def test_empty_tables(spark, folder, tmp_path):
    import corpus_pipeline

    where = folder[0]
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{where}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_columns_of_any_name_are_carried(spark, folder, tmp_path):
    import corpus_pipeline

    where = folder[0]
    extra = ["id", "raw", "contaminated", "item_ids", "overlaps", "s_upper", "first", "key", "v", "b", "__k", "score"]
    docs = spark.read.parquet(f"{where}/documents.parquet").where("doc_id < 12 or doc_id in (20, 21, 30)")
    for i, name in enumerate(extra):
        docs = docs.withColumn(name, docs.doc_id * 100 + i)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        columns = docs.columns
        stage(spark, docs, where).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == columns
    kept = docs.collect()
    assert kept and all(r[name] == r.doc_id * 100 + i for r in kept for i, name in enumerate(extra))
    assert corpus_pipeline.STAGES[-1][1](spark, docs, where).count() >= len(kept)
