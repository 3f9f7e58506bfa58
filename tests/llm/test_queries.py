import hashlib
import re
import zlib

import pytest

import __spark_entry__

DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_mpeg_ts": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op2_rule_ensemble": "doc_id held_out score predicted",
    "op3_simhash": "doc_id fingerprint component_id",
    "op4_spaced_seeds": "doc_id contaminated",
    "op5_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op6_language_mixture": "doc_id held_out lang_pred score",
    "op7_difference_cover": "doc_id n_words n_removed kept_sha256",
    "op8_html_crf": "page_id url text n_chars",
    "op9_url_rules": "page_id host path rule verdict",
    "op10_suffix_array": "doc_id n_bytes n_removed n_spans kept_sha256",
}


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}


def rows(spark, name):
    out = __spark_entry__.queries()[name](spark, DIR)
    assert out.columns[: len(COLUMNS[name].split())] == COLUMNS[name].split()
    return out.collect()


def test_ten_are_registered():
    assert set(COLUMNS) <= set(__spark_entry__.queries()) and "pipeline" in __spark_entry__.queries()


def test_op1(spark, docs):
    got = rows(spark, "op1_mpeg_ts")
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        raw = (docs[r.doc_id].text or "").encode()
        padded = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        assert sum(r.unit_bytes) == len(padded) and r.pts == [3600 * i for i in range(len(r.pts))] and r.random_access[0] == 0 and r.media_bytes % 188 == 0


@pytest.mark.parametrize("name,remainder,m", [("op2_rule_ensemble", 1, 3), ("op6_language_mixture", 2, 4)])
def test_models(spark, docs, name, remainder, m):
    got = rows(spark, name)
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % m == remainder) and 0 <= r.score <= 1 for r in got)
    if m == 3:
        quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
        held = [r.predicted == quality[r.doc_id] for r in got if r.held_out and r.doc_id in quality]
        assert all(r.predicted == (r.score >= 0.5) for r in got) and sum(held) >= 0.9 * len(held)
    else:
        held = [r.lang_pred == docs[r.doc_id].lang for r in got if r.held_out and docs[r.doc_id].lang and r.lang_pred != "und"]
        assert held and sum(held) >= 0.95 * len(held)


def test_op3(spark, docs):
    from tests.llm.test_simhash import by_hand, groups

    got = rows(spark, "op3_simhash")
    prints = {i: by_hand(r.text) for i, r in docs.items()}
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{f:016x}" for i, f in prints.items()}
    pairs = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    assert {r.doc_id: r.component_id for r in got} == groups(pairs, prints)


def test_op4(spark, docs):
    got = {r.doc_id: r for r in rows(spark, "op4_spaced_seeds")}
    tokens = lambda t: " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower()))
    items = {r.item_id: tokens(r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()}
    assert set(got) == set(docs)
    for i, r in docs.items():
        whole = {k for k, t in items.items() if f" {t} " in f" {tokens(r.text)} "}
        assert whole <= set(got[i].item_ids) and got[i].contaminated == bool(got[i].item_ids)


def test_op5(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by: dict = {}
    seqs: dict = {}
    for r in rows(spark, "op5_packing"):
        by.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by) == set(docs)
    for i, pieces in by.items():
        ids = [*whole.encode(docs[i].text or "", add_special_tokens=False).ids, 0]
        pieces.sort(key=lambda r: r.piece)
        assert [r.start for r in pieces] == [sum(x.length for x in pieces[:k]) for k in range(len(pieces))] and sum(r.length for r in pieces) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[r.start : r.start + r.length])) for r in pieces)
    for parts in seqs.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048
    floor = -(-sum(r.length for x in by.values() for r in x) // 2048)
    assert len(seqs) <= floor * 1.05 + 1


def test_op7_and_op10(spark, docs):
    from tests.llm.test_repeats import bytes_by_hand, words_by_hand

    ids, texts = list(docs), [r.text for r in docs.values()]
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in rows(spark, "op7_difference_cover")) == words_by_hand(texts, ids, 50)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows(spark, "op10_suffix_array")) == bytes_by_hand(texts, ids, 100)


def test_op8_and_op9(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{DIR}/pages.parquet").collect()}
    got = rows(spark, "op8_html_crf")
    assert {r.page_id: r.url for r in got} == {i: r.url for i, r in pages.items()} and all(r.n_chars == len(r.text) for r in got)
    assert sorted(r.page_id for r in rows(spark, "op9_url_rules")) == sorted(pages)
