import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from fathomline.llm import components as c
from fathomline.llm import simhash as s
from tests.llm.helpers import documents


def by_hand(text):
    low = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(pairs, vertices):
    up = {v: v for v in vertices}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {v: root(v) for v in vertices}


def test_masks_cover_every_pair_of_positions():
    for radius in (1, 2, 3):
        m = s.masks(radius)
        assert len(m) == 2 ** (radius + 1) - 1
        for at in combinations(range(64), radius):
            d = sum(1 << i for i in at)
            assert any(not d & x for x in m)
            if radius == 3 and at[0] > 3:
                break


def test_whole_operator(spark):
    rng = np.random.default_rng(3)
    base = " ".join(f"w{i}" for i in rng.integers(0, 500, 900))
    texts = ["", None, "One", "one", "a b", "É é  x\ty", base, base + " end", base.upper(), "zz " + base, "x " * 5000, "  "]
    texts += [base.replace(f"w{i} ", f"v{i} ", 1) for i in range(30)]
    ids = [100 + (7 * i) % len(texts) for i in range(len(texts))]
    ids[5], texts[8] = None, base
    df = documents(spark, texts, ids)
    fps = [by_hand(t) for t in texts]
    roots = groups([p for p in combinations(set(fps), 2) if (p[0] ^ p[1]).bit_count() <= 2], set(fps))
    least = {}
    for f, i in zip(fps, ids):
        if i is not None:
            least[roots[f]] = min(least.get(roots[f], i), i)
    want = sorted((i if i is not None else -1, f, least.get(roots[f])) for f, i in zip(fps, ids))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fp % 2**64, r.component) for r in s.near_duplicates(df, "doc_id", "text").collect())
    assert got == want
    assert s.near_duplicates(df.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize("radius,most", [(2, 2048), (2, 3), (1, 3), (1, 2048)])
def test_links_connect_like_all_pairs(spark, radius, most):
    rng = np.random.default_rng(5)
    fps = {0, -1}
    for x in rng.integers(-(2**63), 2**63 - 1, 8).tolist():
        for _ in range(40):
            x ^= s._long(1 << int(rng.integers(64)))
            fps.add(x)
            if rng.random() < 0.3:
                x ^= s._long(1 << int(rng.integers(64))) ^ s._long(1 << int(rng.integers(64)))
    df = spark.createDataFrame([(f,) for f in fps], "fp long").repartition(3)
    got = [tuple(r) for r in s.links(df, radius, most).collect()]
    want = groups([(a, b) for a, b in combinations(fps, 2) if ((a % 2**64) ^ (b % 2**64)).bit_count() <= radius], fps)
    assert groups(got, fps) == want
    roots = {r.v: r.root for r in c.components(s.links(df, radius, most), "u", "v").collect()}
    assert {f: roots.get(f, f) for f in fps} == want


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(300)]
    star = [(1000, i) for i in range(1001, 1400)]
    odd = [(None, 5), (7, None), (9, 9)]
    df = spark.createDataFrame([*path, *star, *star[:5], *odd], "a long, b long").repartition(7)
    got = {r.v: r.root for r in c.components(df).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{i: 1000 for i in range(1000, 1400)}}
    assert c.components(df.limit(0)).count() == 0
