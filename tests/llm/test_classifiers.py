import numpy as np

from fathomline.llm import language_mixture as l
from fathomline.llm import queries
from fathomline.llm import rule_ensemble as r
from tests.llm.helpers import documents

WORDS = {"en": "the and of house water light people think with from about never", "de": "der und nicht haus wasser licht menschen denken mit aus über niemals", "fr": "le et pas maison eau lumière gens penser avec depuis jamais près"}


def prose(rng, lang="en", n=60):
    w = rng.choice(WORDS[lang].split(), n)
    return ". ".join(" ".join(w[i : i + 9]).capitalize() for i in range(0, n, 9)) + "."


def junk(rng):
    kind = rng.integers(3)
    if kind == 0:
        return " | ".join(rng.choice(WORDS["en"].split(), 40))
    return prose(rng).upper().replace(" ", "!! ") if kind == 1 else f"{rng.choice(WORDS['en'].split())} " * 60


def test_statistics_by_hand():
    from fathomline.llm.common import text_block
    import pyarrow as pa

    texts = ["", None, "  \n ", "Aa bb. bb. bb. 12 #x\nCC\nCC"]
    s = dict(zip(r.STATISTICS, r.statistics(*text_block(pa.array(texts)))[3]))
    size = len(texts[3])
    want = {"log_bytes": np.log1p(size), "log_words": np.log1p(8), "mean_word": 19 / 8, "short_words": 1.0, "upper": 5 / 13, "digits": 2 / size, "symbols": 1 / size, "marks": 3 / size, "white": 7 / size, "lines_per_word": 3 / 8, "symbol_words": 1 / 8, "mark_words": 3 / 8, "upper_words": 2 / 8, "bare_words": 1 / 8, "distinct_words": 5 / 8, "top_word": 3 / 8, "doubled_words": 3 / 8, "distinct_lines": 2 / 3}
    assert {k: round(s[k], 9) for k in want} == {k: round(v, 9) for k, v in want.items()}
    zero = r.statistics(*text_block(pa.array(texts)))[:3]
    assert not zero[:2].any() and not zero[2, 1:].any()


def test_quality(spark):
    rng = np.random.default_rng(1)
    good = rng.random(300) < 0.7
    texts = [prose(rng) if g else junk(rng) for g in good] + [None, "", prose(rng)]
    df = documents(spark, texts, [*range(301), None, 299])
    labels = spark.createDataFrame([*((i, int(g), 0) for i, g in enumerate(good) if i < 200), (None, 1, 0), (7, None, 0), (5, int(good[5]), 0)], "doc_id long, quality int, toxic int")
    model = r.train(df, labels)
    rows = r.scored(df, model).collect()
    assert len(rows) == 303 and all(0 <= x.score <= 1 for x in rows)
    assert np.mean([(x.score >= 0.5) == good[x.doc_id] for x in rows if x.doc_id is not None and 200 <= x.doc_id < 299]) > 0.97
    x = np.random.default_rng(2).random((50, len(r.STATISTICS)))
    frame = spark.createDataFrame([tuple(map(float, v)) for v in x], ", ".join(f"s_{s} double" for s in r.STATISTICS))
    assert np.allclose([v[0] for v in frame.select(model.column()).collect()], model.score(x))
    kept = r.accepted(df, model)
    assert kept.columns == df.columns and 0 < kept.count() < 303
    for some in (labels.limit(0), labels.where("quality = 1")):
        assert all(0 <= x.score <= 1 for x in r.scored(df, r.train(df, some)).collect())
    assert r.scored(df.limit(0), model).count() == 0


def test_training_rows_are_bounded_and_not_held_out(spark):
    rng = np.random.default_rng(1)
    df = documents(spark, [prose(rng) for _ in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    held = {x.doc_id for x in labels.where(queries.crc32_mod("doc_id", 3) == 1).collect()}
    import zlib

    assert held == {i for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert r.train(df, labels, most=1).rules == []


def test_language(spark):
    rng = np.random.default_rng(3)
    langs = [("en", "de", "fr")[i % 3] for i in range(90)]
    texts = [prose(rng, x) for x in langs] + [None, "", "12 34 !!", "…", prose(rng, "en", 90) + " " + prose(rng, "de", 45)] + [prose(rng, "fr")] * 2
    df = documents(spark, texts, None, langs + [None] * 7)
    model = l.train(df.where("doc_id < 45"))
    assert model.names == ["de", "en", "fr"] and np.allclose(np.exp(model.logp).sum(0), 1, atol=1e-3)
    got = {x.doc_id: x for x in l.identified(df, model).collect()}
    assert all(got[i].lang_pred == x for i, x in enumerate(langs)) and all(0 <= x.score <= 1 for x in got.values())
    assert [got[i].lang_pred for i in range(90, 94)] == ["und"] * 4 and got[90].score == 0
    assert got[94].languages == ["en", "de"] and abs(got[94].proportions[0] - 2 / 3) < 0.1
    assert all(len(got[i].languages) == 1 for i in range(90)) and got[95] == got[95].__class__(**{**got[96].asDict(), "doc_id": 95})
    assert {x.lang_pred for x in l.identified(df, l.train(df.limit(0))).collect()} == {"und"}
    assert l.identified(df.limit(0), model).count() == 0


def test_counts_of_grams_by_hand(spark):
    df = documents(spark, ["ab c", "ab", "É"], None, ["x", "x", "y"])
    model = l.train(df, smoothing=0.0)
    low = lambda b: ((b[0] << 16 | b[1] << 8 | b[2]) * 2654435761 % 2**32) >> 17
    p = np.exp(model.logp)
    assert np.allclose([p[low(g), 0] for g in (b" ab", b"ab ", b" c ")], [0.4, 0.4, 0.2])
    assert np.allclose([p[low(g), 1] for g in (b" \xc3\xa9", b"\xc3\xa9 ")], [0.5, 0.5])


def test_many_languages():
    rng = np.random.default_rng(4)
    ll = rng.normal(-9, 1, (40, 3)).astype(np.float32)
    ll[:20, 1] += 8
    ll[20:30, 0] += 8
    ll[30:, 2] += 8
    share, _ = l.mixtures(ll, np.array([0, 20, 20, 40]))
    assert share[0].argmax() == 1 and share[0, 1] == 1 and not share[1].any()
    assert abs(share[2, 0] - 0.5) < 0.1 and abs(share[2, 2] - 0.5) < 0.1


def one_by_one(ll, iterations=12):
    """The set of the highest penalised likelihood of those from all languages down to one, each round without the least."""
    left, best = list(range(ll.shape[1])), (-np.inf, None, None)
    while left:
        p, x = np.ones(len(left)) / len(left), np.exp(ll[:, left])
        for _ in range(iterations if len(left) > 1 else 0):
            r = x * p
            p = (r / r.sum(1, keepdims=True)).mean(0)
        score = np.log((x * p).sum(1)).sum() - 0.5 * np.log(len(ll) + 1) * (len(left) - 1)
        if score > best[0]:
            best = (score, list(left), p)
        left.pop(int(p.argmin()))
    return best


def test_sets_of_up_to_twelve_languages_like_plain_elimination():
    rng = np.random.default_rng(0)
    chosen = set()
    for t in range(150):
        k, m = int(rng.integers(2, 13)), int(rng.integers(5, 250))
        ll = rng.normal(-9, 1.5, (m, k))
        ll[np.arange(m), rng.choice(rng.choice(k, int(rng.integers(1, k + 1)), replace=False), m)] += rng.uniform(1, 9)
        ll = ll.astype(np.float32)
        like = l.Likelihoods(lambda lo, hi: ll[lo:hi], m, k, 10**9 if t % 2 else 30 * k)
        assert (like.held is None) == (t % 2 == 0 and m > 30)
        share, score = l.mixtures(like, np.array([0, m]))
        best, names, p = one_by_one(ll.astype(float))
        assert np.flatnonzero(share[0]).tolist() == names and np.allclose(share[0, names], p, atol=1e-3) and abs(score[0] * m - best) < 0.05
        chosen.add(len(names))
    assert chosen >= {1, 2, 5, 9, 10}


def test_more_than_eight_languages_in_one_document(spark):
    rng = np.random.default_rng(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = {f"l{i:02}": ["".join(rng.choice(list(letters[2 * i : 2 * i + 4]), 5)) for _ in range(30)] for i in range(11)}
    texts = [" ".join(rng.choice(w, 80)) for w in own.values()]
    mixed = " ".join(" ".join(rng.choice(own[f"l{i:02}"], 40)) for i in range(10))
    model = l.train(documents(spark, texts, None, list(own)))
    got = {r.doc_id: r for r in l.identified(documents(spark, [mixed, texts[3]]), model).collect()}
    assert sorted(got[0].languages) == [f"l{i:02}" for i in range(10)] and abs(sum(got[0].proportions) - 1) < 1e-6
    assert got[1].languages == ["l03"]


def test_lasso_is_at_its_optimum():
    """The subgradient conditions of the minimum hold."""
    rng = np.random.default_rng(8)
    x = (rng.random((400, 6)) < 0.4).astype(float)
    y = (x[:, 0] + 0.3 * rng.normal(size=400) > 0.5).astype(float)
    penalty = 0.02
    b, w = r.lasso_logistic(x, y, penalty, steps=4000)
    scale = np.maximum(x.std(0), 0.05)
    gap = r.sigmoid(x @ w + b) - y
    grad = (x / scale).T @ gap / len(y)
    assert abs(gap.mean()) < 1e-4 and w[0] > 0 and (w == 0).any()
    assert all(abs(g + penalty * np.sign(v)) < 1e-3 if v else abs(g) <= penalty + 1e-3 for g, v in zip(grad, w))


def test_first_split_by_enumeration():
    rng = np.random.default_rng(9)
    x, residual = rng.random((80, 3)), rng.normal(size=80)
    weight = np.ones(80)
    cuts = [r.thresholds(x[:, j], quantiles=200) for j in range(3)]
    nodes = r.grow(x, residual, weight, cuts, 1, 5)

    def gain(j, c):
        low = x[:, j] <= c
        if min(low.sum(), (~low).sum()) < 5:
            return -1
        return sum(residual[s].sum() ** 2 / (s.sum() + 1) for s in (low, ~low))

    best = max(((gain(j, c), j, c) for j in range(3) for c in cuts[j]))
    assert {n[0][0][:1] + n[0][0][2:] for n in nodes} == {(best[1], best[2])}
    for rule, value in nodes:
        on = r.holds(rule, x)
        assert abs(value - residual[on].sum() / (on.sum() + 1)) < 1e-9


def test_held_out_labels_never_change_the_model(spark):
    rng = np.random.default_rng(2)
    good = rng.random(120) < 0.6
    df = documents(spark, [prose(rng) if g else junk(rng) for g in good])
    import zlib

    rows = [(i, int(g)) for i, g in enumerate(good)]
    wrong = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q) for i, q in rows]
    models = [queries.quality_model(df, spark.createDataFrame(x, "doc_id long, quality int")) for x in (rows, wrong)]
    assert rows != wrong and models[0].rules and models[0] == models[1]
