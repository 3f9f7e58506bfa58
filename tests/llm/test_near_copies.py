import re
from itertools import combinations

import numpy as np
import pytest

from fathomline.llm import near_copies as n
from fathomline.llm import stages
from tests.llm.helpers import documents
from tests.llm.test_simhash import groups


def shingles(text):
    low = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(" ".join(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([" ".join(w)] if w else [])


def planted():
    """Texts of 60 to 250 words with copies of one to six changed words, a chain of copies and a common line."""
    rng = np.random.default_rng(17)
    texts = []
    for i in range(12):
        base = [f"w{x}" for x in rng.integers(0, 4000, int(rng.integers(60, 250)))]
        texts.append(" ".join(base))
        for k in range(8):
            copy = list(base)
            for j in rng.choice(len(copy), 1 + k % 6, replace=False):
                copy[j] = f"c{rng.integers(10**6)}"
            texts.append(" ".join(copy))
            if i < 3:
                base = copy
    line = " ".join(f"line{i}" for i in range(12))
    texts += [line + " " + " ".join(f"u{x}" for x in rng.integers(0, 10**6, 30)) for _ in range(25)]
    return texts + [None, "", " ", "One two", "one  two", "one", texts[0].upper(), texts[0]]


@pytest.mark.parametrize("pivots,block", [(0, 2048), (1, 4)])
def test_groups_like_brute_force(spark, pivots, block, monkeypatch):
    monkeypatch.setattr(n, "BLOCK", block)
    texts = planted()
    sets = [shingles(t) for t in texts]
    alike = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b)
    pairs = [(i, j) for i, j in combinations(range(len(texts)), 2) if alike(sets[i], sets[j])]
    want = groups(pairs, range(len(texts)))
    assert len(pairs) > 60 and len(set(want.values())) > 40
    df = documents(spark, texts)
    assert {r.doc_id: r.component for r in n.near_copies(df, "doc_id", "text", pivots).collect()} == want
    assert n.near_copies(df.limit(0), "doc_id", "text", pivots).count() == 0
    if pivots:
        kept = {r.doc_id for r in stages.near_duplicates(spark, df, "").collect()}
        assert kept == set(want.values())


def test_prefixes_of_similar_sets_meet_in_any_order():
    rng = np.random.default_rng(2)
    for size in range(1, 40):
        own = np.sort(rng.integers(0, 2**63, size, dtype=np.uint64))
        for gone in range(size // 5 + 1):
            other = np.delete(own, rng.choice(size, gone, replace=False))
            frequent = np.sort(rng.choice(own, size // 2, replace=False))
            counts = rng.integers(3, 9, len(frequent))
            if 5 * len(other) >= 4 * size:
                assert set(n.prefix(own, frequent, counts).tolist()) & set(n.prefix(other, frequent, counts).tolist())


def test_texts_that_share_only_passages_meet_in_no_bucket(spark):
    rng = np.random.default_rng(5)
    passage = [f"p{i}" for i in range(60)]
    apart = [" ".join(passage + [f"u{x}" for x in rng.integers(0, 10**9, 80)]) for _ in range(30)]
    alike = " ".join(f"c{i}" for i in range(100))
    listed = n._met(documents(spark, [*apart, alike, alike + " end"]), "text", 32, 4400).where("b >= 64")
    found = n.unpacked(listed.toArrow().column("z"), 2)[1]
    assert len(np.unique(found)) == 2


def test_filter_tells_shingles_of_several_texts(spark):
    texts = planted()
    sets = [n.block_sets(*n.text_block(n.pa.array([t or ""])))[0] for t in texts]
    h, count = np.unique(np.concatenate(list({s.tobytes(): s for s in sets}.values())), return_counts=True)
    flags = np.unpackbits(n._shared(documents(spark, texts).repartition(3), "text", len(h)), bitorder="little")
    set_there = flags[(h >> np.uint64(64 - int(len(flags) - 1).bit_length())).astype(np.int64)] == 1
    assert set_there[count > 1].all() and set_there[count == 1].mean() < 0.5


def python_in_a_row(plan: str) -> int:
    """The most Python steps that one task of a plan (as text) runs at a time: those with no exchange between them."""
    above, most = [], 0
    for line in plan.splitlines():
        m = re.search(r"\w", line)
        if m:
            above = [x for x in above if x[0] < m.start()]
            since = above[-1][1] if above else 0
            since = 0 if "Exchange" in line.split("(")[0] else since + bool(re.match(r"(\w*InArrow|\w*InPandas|ArrowEvalPython)", line[m.start() :]))
            above.append((m.start(), since))
            most = max(most, since)
    return most


def test_a_task_needs_one_python_worker(spark, monkeypatch):
    df, plans = documents(spark, planted()), []
    plan_of = lambda frame: plans.append(frame._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(n, "cut", lambda frame, real=n.cut: (plan_of(frame), real(frame))[1])
    monkeypatch.setattr(type(df), "toArrow", lambda frame, real=type(df).toArrow: (plan_of(frame), real(frame))[1])
    n.near_copies(df, "doc_id", "text").count()
    assert sum("InArrow" in p for p in plans) > 8
    assert max(map(python_in_a_row, plans)) == 1
