import hashlib
import re

import numpy as np
import pytest

from fathomline.llm import difference_cover as d
from fathomline.llm import suffix_array as s
from tests.llm.helpers import documents

LAST = 1 << 63


def words_by_hand(texts, ids, w):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    order = [i if i is not None else LAST for i in ids]
    least = {}
    for k, i in zip(split, order):
        for a in range(len(k) - w + 1):
            x = tuple(k[a : a + w])
            least[x] = min(least.get(x, i), i)
    out = []
    for k, i, key in zip(split, order, ids):
        gone = [False] * len(k)
        for a in range(len(k) - w + 1):
            if least[tuple(k[a : a + w])] < i:
                gone[a : a + w] = [True] * w
        kept = " ".join(x for x, g in zip(k, gone) if not g)
        out.append((str(key), len(k), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def bytes_by_hand(texts, ids, w):
    raw = [(t or "").encode() for t in texts]
    order = [i if i is not None else LAST for i in ids]
    least = {}
    for r, i in zip(raw, order):
        for a in range(len(r) - w + 1):
            x = r[a : a + w]
            least[x] = min(least.get(x, (i, a)), (i, a))
    out = []
    for r, i, key in zip(raw, order, ids):
        gone = np.zeros(len(r) + 2, bool)
        for a in range(len(r) - w + 1):
            if least[r[a : a + w]] < (i, a):
                gone[a + 1 : a + w + 1] = True
        kept = bytes(x for x, g in zip(r, gone[1:]) if not g)
        out.append((str(key), len(r), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdé"), rng.integers(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(int(n)) for n in (49, 50, 51, 70, 130, 20)]
    out = [None, "", " ", "a", "x " * 300, "ab" * 400, "x " * 120, "y" * 99, "y" * 100, "y" * 101]
    for _ in range(30):
        parts = [text(int(rng.integers(0, 60)))]
        for k in rng.integers(0, len(shared), 3):
            parts += [shared[k], text(int(rng.integers(0, 25)))]
        out.append(rng.choice([" ", "  ", "\n"]).join(parts))
    near = out[-1].split(" ")
    for k in range(12):
        changed = list(near)
        changed[int(rng.integers(len(near)))] = "Z"
        out.append(" ".join(changed))
    out += [out[12], out[13], out[12], out[4]]
    ids = rng.permutation(len(out) * 3)[: len(out)].tolist()
    ids[20] = None
    ids[-1] = ids[-4]
    out.append(out[15])
    ids.append(ids[15])
    return out, ids


def test_cover():
    assert d.is_cover(d.COVER, d.PERIOD) and not d.is_cover((0, 1, 3), 8)


@pytest.mark.parametrize("seed", [1, 2])
def test_passages(spark, seed):
    texts, ids = corpus(seed)
    got = d.repeated_passages(documents(spark, texts, ids), "doc_id", "text").collect()
    assert sorted((str(r.doc_id), r.n, r.n_removed, r.kept_sha256) for r in got) == words_by_hand(texts, ids, 50)
    assert any(0 < r.n_removed < r.n for r in got)
    assert all(r.n_removed == sum(r.spans[1::2]) - sum(r.spans[::2]) for r in got)


@pytest.mark.parametrize("seed,hot", [(1, 20000), (2, 2)])
def test_strings(spark, seed, hot):
    texts, ids = corpus(seed)
    got = s.removals(documents(spark, texts, ids), "doc_id", "text", s.Strings(hot=hot)).collect()
    assert sorted((str(r.doc_id), r.n, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == bytes_by_hand(texts, ids, 100)


def test_empty_tables(spark):
    none = documents(spark, ["x"]).limit(0)
    assert d.repeated_passages(none, "doc_id", "text").count() == 0
    assert s.repeated_strings(none, "doc_id", "text").count() == 0


def test_kept_texts(spark):
    texts, ids = corpus(3)
    rows = d.without_repeats(documents(spark, texts, ids), "doc_id", "text").collect()
    whole = {str(i): t for i, t in zip(ids, texts)}
    by = words_by_hand(texts, ids, 50)
    assert len(rows) == len(texts) and set(rows[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "h", "start", "c"}
    assert sorted((str(r.doc_id), hashlib.sha256(" ".join(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")).encode()).hexdigest()) for r in rows) == sorted((b[0], b[3]) for b in by)
    clean = {b[0] for b in by if not b[2]} - {b[0] for b in by if b[2]}
    assert all(r.text == whole[str(r.doc_id)] for r in rows if str(r.doc_id) in clean and ids.count(r.doc_id) == 1)


def test_deep_shallow_sorts():
    rng = np.random.default_rng(4)
    for letters, n in ((2, 3000), (1, 900), (5, 2000)):
        data = rng.integers(97, 97 + letters, n).astype(np.uint8)
        data[n // 2 : n // 2 + 400] = data[:400]
        at = rng.permutation(n - 100)
        order, group = s.deep_shallow(data, at, 100)
        keys = [data[i : i + 100].tobytes() for i in at[order]]
        assert keys == sorted(keys)
        assert [g == h for g, h in zip(group, group[1:])] == [a == b for a, b in zip(keys, keys[1:])]


def test_segments_mark_like_the_whole(monkeypatch):
    data = np.random.default_rng(6).integers(97, 101, 5000).astype(np.uint8)
    k = s.Strings()
    _, h, at = k.marks(data, np.array([0, len(data)]))
    monkeypatch.setattr(s, "SEGMENT", 700)
    _, h2, at2 = k.marks(data, np.array([0, len(data)]))
    windows = lambda h, at: sorted((w, x) for x, a in zip(h.tolist(), at.tolist()) for w in range(a >> 7, (a >> 7) + (a & 127)))
    assert windows(h, at) == windows(h2, at2) and len(windows(h, at)) == 4901
