from itertools import combinations

import numpy as np
import pytest

from fathomline.llm import spaced_seeds as s
from tests.llm.helpers import documents


@pytest.mark.parametrize("n", range(5, 21))
def test_no_fifth_of_substitutions_hides_an_item(n):
    k = n // 5
    usable = [[j for j, c in enumerate(m) if c == "1"] for m in s.masks_of(n, s.MASKS)]
    spans = [len(m) for m in s.masks_of(n, s.MASKS)]
    for out in combinations(range(n), k):
        gone = set(out)
        assert any(not any(a + j in gone for j in u) for u, w in zip(usable, spans) for a in range(n - w + 1)), out


@pytest.mark.parametrize("n", range(5, 21))
def test_a_fifth_of_substitutions_leaves_the_true_share(n):
    k = n // 5
    item = np.arange(1, n + 1, dtype=np.uint64)
    for out in combinations(range(n), k):
        text = item.copy()
        text[list(out)] = 0
        assert s.matched(text, item, np.array([0])) == (n - k) / n, out


def test_words_of_one_passage_add_up_and_far_single_words_do_not():
    item = np.arange(1, 41, dtype=np.uint64)
    text = item.copy()
    text[[1, 3, 36, 38]] = 0
    text = np.insert(text, 20, 0)
    assert s.matched(text, item, np.array([0, 1])) == 0.9
    # four words that recur a hundred times, each time with one other word in place
    far = np.zeros(6000, np.uint64)
    for j in range(100):
        far[60 * j + 10 : 60 * j + 14] = item[10:14]
        far[60 * j + j % 40] = item[j % 40]
    assert s.matched(far, item, np.arange(0, 6000, 60)) <= 8 / 40


@pytest.mark.parametrize("most", [1 << 20, 10])
def test_contamination(spark, most):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}é" for i in range(3000)] + ["the", "of"] * 300
    text = lambda n: [str(w) for w in rng.choice(vocabulary, n)]
    items = [text(n) for n in (15, 20, 33, 60)] + [["Two", "words"], [], ["one"]]
    bench = spark.createDataFrame([*((i, " ".join(t), "x") for i, t in enumerate(items)), (None, "zzz", "x"), (90, None, "x"), (91, " ".join(items[0]).upper(), "x")], "item_id long, text string, doc_id string")
    docs, want = [], []

    def add(words, found):
        docs.append(words if words is None else " ".join(words))
        want.append(found)

    same = {0: [0, 91], 1: [1], 2: [2], 3: [3]}
    for i in range(4):
        add(text(40) + items[i] + text(30), same[i])
        add([w.upper() + "," for w in items[i]], same[i])
        for share, found in ((0.19, same[i]), (0.35, [])):
            x = list(items[i])
            for j in rng.choice(len(x), int(len(x) * share), replace=False):
                x[j] = "changed"
            add(text(5) + x + text(5), found)
        add(text(9) + items[i][: len(items[i]) // 2] + text(50), [])
        half = len(items[i]) // 2
        add(text(3) + items[i][:half] + ["inserted"] + items[i][half:], same[i])
    add(text(20) + ["two", "words"] + text(3), [4])
    add(["ones", "two"], [])
    add(["x", "one"], [6])
    add(items[0] + text(10) + items[2], [0, 2, 91])
    add(text(6000) + items[1], [1])
    add(None, [])
    add([], [])
    add(items[3], [3])
    add(items[3], [3])
    df = documents(spark, docs)
    got = {r.doc_id: (r.contaminated, list(r.item_ids)) for r in s.contamination(df, bench, most_bytes=most).collect()}
    assert got == {i: (bool(w), w) for i, w in enumerate(want)}
    assert s.contamination(df.limit(0), bench, most_bytes=most).count() == 0
    assert not s.contamination(df, bench.limit(0), most_bytes=most).where("contaminated").count()
