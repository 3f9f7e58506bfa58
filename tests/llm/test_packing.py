import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fathomline.llm import packing as p
from tests.llm.helpers import documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
AWKWARD = ["", " ", "a", "a  b", "a \n b", "x\n\ny z", "don't  we'll I'd", " lead", "trail ", "tab\tb c", "naïve café 漢字 😀 x", " nbsp  em", "a<|endoftext|>b c", "1234 5 67,8", "it 's", "\x00\x01 q", "a  b"]


def test_ids_are_those_of_the_library():
    whole = Tokenizer.from_file(PATH)
    e = p.Encoder(PATH)
    assert e.piece is not None
    rng = np.random.default_rng(1)
    made = ["".join(rng.choice(list("ab' \n\té1.,A "), 40)) for _ in range(300)]
    for t in AWKWARD + made:
        for _ in range(2):
            assert np.frombuffer(e(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_cuts():
    assert p.cuts(1, 10) == [(0, 1)] and p.cuts(10, 10) == [(0, 10)] and p.cuts(20, 10) == [(0, 10), (10, 10)]
    assert p.cuts(23, 10) == [(0, 3), (3, 10), (13, 10)]


def test_bins_keep_their_bound_and_take_the_tightest():
    b = p.Bins(10, 2)
    assert [b.place(s) for s in (6, 7, 3, 5)] == [(0, 0), (1, 0), (1, 7), (2, 0)]
    assert b.closed == [(1, 10)] and b.open == 2
    b.place(9)
    assert b.closed[-1] == (0, 6) and b.open == 2  # the fullest gave way


@pytest.mark.parametrize("bins", [2, 1024])
def test_whole_operator(spark, bins):
    rng = np.random.default_rng(2)
    texts = AWKWARD + [None] + [" ".join(f"w{i}" for i in rng.integers(0, 99, n)) for n in rng.integers(1, 300, 120)] + ["word " * 5000]
    texts += texts[-1:]
    ids = [*range(len(texts) - 2), 5, None]
    df = documents(spark, texts, ids)
    got = p.pack(df, "doc_id", "text", PATH, length=256, open_bins=bins, with_ids=True).collect()
    whole = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for t, i in zip(texts, ids):
        want[i].append([*whole.encode(t or "", add_special_tokens=False).ids, 0])
    seqs, docs = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length <= 256
        seqs[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append(r)
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 256
    for i, kept in want.items():
        if len(kept) == 1:
            rows = sorted(docs[i], key=lambda r: r.piece)
            assert [r.piece for r in rows] == list(range(len(rows))) and sum((r.ids for r in rows), []) == kept[0]
            assert all(r.length == 256 for r in rows[1:]) and (len(kept[0]) > 256 or len(rows) == 1)
        else:
            assert sum(r.length for r in docs[i]) == sum(map(len, kept))
    total = sum(len(k) for v in want.values() for k in v)
    assert len(seqs) <= -(-total // 256) * (1.15 if bins > 2 else 1.5) + 1
    assert p.pack(df.limit(0), "doc_id", "text", PATH).count() == 0


def test_tasks_and_groups_like_one_after_the_other(spark, monkeypatch):
    """Each task's packing and that of what it left, two tasks to a group, against the same done in sequence."""
    monkeypatch.setattr(p, "GROUP", 2)
    rng = np.random.default_rng(5)
    df = documents(spark, [" ".join(["w"] * n) for n in rng.integers(1, 60, 150)]).select("doc_id", "text").repartition(5, "doc_id")
    got = p.pack(df, "doc_id", "text", PATH, length=64, open_bins=4).collect()
    parts = df.rdd.glom().collect()
    e, where, left = p.Encoder(PATH), {}, {}
    for t, rows in enumerate(parts):
        bins, fill = p.Bins(64, 4), {}
        for r in rows:
            for piece, (_, n) in enumerate(p.cuts(len(e(r.text)) // 4 + 1, 64)):
                b, at = bins.place(n)
                where[r.doc_id, piece] = (t, b, at)
                fill[b] = at + n
        for b, f in bins.rest():
            left.setdefault(t // 2, []).append((t, b, f))
    moved = {}
    for g, items in left.items():
        bins, first = p.Bins(64, 4), {}
        for t, b, f in sorted(items):
            bin_, at = bins.place(f)
            moved[t, b] = (first.setdefault(bin_, (t, b)), at)
        assert bins.open <= 4
    want = {k: ((t, b), at) if (t, b) not in moved else (moved[t, b][0], moved[t, b][1] + at) for k, (t, b, at) in where.items()}
    assert len(left) == 3
    assert {(r.doc_id, r.piece): ((r.sequence_id >> 32, r.sequence_id & 0xFFFFFFFF), r.offset) for r in got} == want
    total = sum(r.length for r in got)
    assert len({r.sequence_id for r in got}) <= total / 64 * 1.25


def test_other_tokenizer_files_are_not_encoded_by_the_short_way(tmp_path):
    import json

    spec = json.loads(open(PATH).read())
    for where, name, value in (("pre_tokenizer", "use_regex", False), ("model", "ignore_merges", True)):
        other = json.loads(json.dumps(spec))
        other[where][name] = value
        path = str(tmp_path / f"{name}.json")
        open(path, "w").write(json.dumps(other))
        e, whole = p.Encoder(path), Tokenizer.from_file(path)
        assert e.piece is None and np.frombuffer(e("don't go  there"), "<u4").tolist() == whole.encode("don't go  there", add_special_tokens=False).ids
