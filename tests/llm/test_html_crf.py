import re
import time
from itertools import product

import numpy as np
import pytest

from fathomline.llm import html_crf as h


@pytest.fixture(scope="module")
def model():
    return h.default_field()


def test_blocks():
    page = """<!doctype html><html><head><title>no</title><style>p{}</style></head><body class="x"><script>var a="<p>no</p>";</script>
    <p>One &amp;amp; two<br>three<p><b>four<p>fi<i>ve</i></b>  six<!-- no <p> --><ul><li>a<li>b</ul><div hidden>c</div>tail <a href="x>y">link</a><p>&lt;p&gt; &eacute;"""
    assert [b.text for b in h.leaf_blocks(page)] == ["One &amp; two three", "four", "five six", "a", "b", "c", "tail link", "<p> é"]
    features = {b.text: set(b.features) for b in h.leaf_blocks(page)}
    assert {"tag=li", "in=ul", "word=x", "at=3"} <= features["a"] and "word=!hidden" in features["c"] and "links=1" in features["tail link"]
    for odd in ("", "<", "<p", "</p>", "a<b", "<!--", "<script>", "<p>x</", "<p class='a>x", "<<<>>>", "&#xD800;&#0;x"):
        h.leaf_blocks(odd)


def test_viterbi_by_enumeration():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 8):
        model = h.Field({f"f{i}": float(rng.normal()) for i in range(9)}, tuple(rng.normal(size=2)), tuple(map(tuple, rng.normal(size=(2, 2)))))
        blocks = [h.Block("x", [f"f{j}" for j in rng.integers(0, 9, 3)]) for _ in range(n)]

        def score(y):
            return model.first[y[0]] + sum(sum(model.weights[f] for f in b.features) * k for b, k in zip(blocks, y)) + sum(model.step[a][b] for a, b in zip(y, y[1:]))

        assert model.decode(blocks) == [bool(k) for k in max(product((0, 1), repeat=n), key=score)]
    assert model.decode([]) == []


def test_held_out_pages(model):
    pages = h.labelled_pages(80, seed=123)
    wrong = [a != b for blocks, labels in pages for a, b in zip(model.decode(blocks), labels)]
    assert np.mean(wrong) < 0.02
    assert h.fit([]).decode(pages[0][0]) == [False] * len(pages[0][0])


PAGE = "<html><head><title>T</title></head><body><nav><ul><li><a href='/a'>Menu</a></li></ul></nav><div class='cookie-notice'><p>We use cookies.</p></div><article><h1>Head &amp; line</h1><p><b>First.<br><p>Second\n one, longer.</p><div class='ad'>Buy this now.</div><p>Third.</p></article><aside><h3>More</h3><p>Other text.</p></aside><div id='comments'><h3>Comments</h3><div class='comment'><p>Nice article, thanks.</p></div></div><form>Search <input></form><footer>&copy; x</footer></body>"


def test_column(spark, model):
    want = "Head & line First. Second one, longer. Third."
    long = PAGE.replace("<p>Third.</p>", "<p>Word word, word.</p>" * 4000)
    rows = [(0, "u", PAGE, 1), (1, None, None, 1), (2, "u", "", 1), (3, "u", PAGE, 1), (4, "u", long, 1), (None, "u", "<p>", 1), (6, "u", PAGE.replace("</body>", "").replace("</article>", ""), 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int").repartition(2)
    got = {r.page_id: r for r in h.extracted(df).collect()}
    assert len(got) == len(rows) and got[0].text == want == got[3].text and got[0].n_chars == len(want)
    assert got[1].text == got[2].text == got[None].text == "" and got[1].n_chars == 0
    assert got[4].text.count("Word word, word.") == 4000
    assert "More" not in got[6].text and "Comments" not in got[6].text
    assert h.extracted(df.limit(0)).count() == 0


def test_broken_markup_keeps_its_text():
    texts = lambda page: [b.text for b in h.leaf_blocks(page)]
    assert texts("<p data-x=it's>Hello world</p><p>we don't go</p><p>end</p>") == ["Hello world", "we don't go", "end"]
    assert texts("<p title=\"a>One</p><p>two</p>") == ["One", "two"]
    assert texts("<p a='b>c'>One</p>") == ["One"] and texts("<p a = b>One</p></>two<!-->three<!--->four<!-- x --!>five") == ["One", "twothreefourfive"]
    assert texts("<div><svg><path></div><p>text") == ["text"] and texts("<head><title>x</title><p>text</p>") == ["text"]
    assert texts("<p>a<script>if (a<b && c>'</p>') x(\"<p>\")</script >b</p>") == ["a", "b"] and texts("<p>a<title>b") == ["a", "b"]
    assert texts("<a href=/x/>link</a>") == ["link"] and texts("a < b <3 c<") == ["a < b <3 c<"]


def slow_tags(page):
    """Names, starts and ends of tags by a state machine, character by character (no comments, no scripts, quotes closed)."""
    out, i = [], 0
    while i < len(page):
        m = re.match(r"</?[a-zA-Z]", page[i : i + 3])
        if not m:
            i += 1
            continue
        start, state, name, quote = i, "name", "", ""
        i += 2 if page[i + 1] == "/" else 1
        while i < len(page):
            c = page[i]
            if state == "quoted":
                state = "between" if c == quote else state
            elif c == ">":
                break
            elif state == "name":
                if c in " \t\n/":
                    state = "between"
                else:
                    name += c
            elif state == "between":
                state = state if c in " \t\n/" else "attribute"
            elif state == "attribute":
                state = "value" if c == "=" else "after" if c in " \t\n" else "between" if c == "/" else state
            elif state == "after":
                state = "value" if c == "=" else state if c in " \t\n" else "between" if c == "/" else "attribute"
            elif state == "value":
                if c in "\"'":
                    state, quote = "quoted", c
                elif c not in " \t\n":
                    state = "bare"
            elif state == "bare" and c in " \t\n":
                state = "between"
            i += 1
        if i == len(page):
            return None  # open to the end
        i += 1
        out.append((start, i, name.lower()))
    return out


def test_tags_like_a_state_machine():
    rng = np.random.default_rng(3)
    seen = 0
    for _ in range(4000):
        page = "".join(rng.choice(list("<<>/ab= \"'\"' x"), 24)) + "\"'>>"
        tags, found, at = h.Tags(page), [], 0
        while t := tags.after(at):
            at = t[1]
            found.append(t)
        want = slow_tags(page)
        if want is None or any(not n for *_, n in found):
            continue  # what nothing closes is read on in another way
        seen += 1
        assert found == want, page
    assert seen > 500


def test_time_is_linear(model):
    for part in ('<a "', "<a ", "<a x='>", "</script ", "<li><b>", "<div>", "<svg>", "<dd><dl><div><dt>", "<title>", "<p title=\"x>", "<a x=\"1>"):
        began = time.perf_counter()
        h.main_text("<p>x</p>" + part * (300_000 // len(part)), model)
        assert time.perf_counter() - began < 6, part


def test_gradient_by_differences():
    """At the end of a long fit no small change of a weight raises the objective, by enumeration of all labellings."""
    pages = [([h.Block("", ["a"]), h.Block("", ["b"]), h.Block("", ["a", "b"])], [True, False, True]), ([h.Block("", ["b"])], [True]), ([h.Block("", ["a"]), h.Block("", ["b"])], [False, False]), ([h.Block("", ["a"])], [True])]
    ridge = 0.05
    names = ["a", "b"]

    def objective(theta):
        w, first, step = dict(zip(names, theta[:2])), theta[2:4], theta[4:].reshape(2, 2)

        def score(blocks, y):
            return first[y[0]] + sum(sum(w[f] for f in b.features) * k for b, k in zip(blocks, y)) + sum(step[i][j] for i, j in zip(y, y[1:]))

        total = 0.0
        for blocks, y in pages:
            total += score(blocks, [int(k) for k in y]) - np.logaddexp.reduce([score(blocks, z) for z in product((0, 1), repeat=len(blocks))])
        return total / sum(len(b) for b, _ in pages) - ridge / 2 * (theta**2).sum()

    got = h.fit(pages, rounds=3000, ridge=ridge)
    theta = np.array([got.weights["a"], got.weights["b"], *got.first, *got.step[0], *got.step[1]])
    here = objective(theta)
    for i in range(len(theta)):
        for d in (-0.05, 0.05):
            moved = theta.copy()
            moved[i] += d
            assert objective(moved) < here + 1e-6


def test_unknown_class_names(model):
    page = PAGE.replace("cookie-notice", "zq1").replace("'ad'", "'zq2'").replace("comments", "zq3").replace("comment", "zq4").replace("<article>", "<article class='zq5'>")
    text = h.main_text(page, model)
    assert "Head & line First. Second one, longer." in text and "Third." in text and "Menu" not in text and "Other text" not in text and "© x" not in text
