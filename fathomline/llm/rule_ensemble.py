"""Quality classifier: a sparse ensemble of rules.

Statistics of whole texts (character classes, word lengths, repetition, lines) are the only inputs. Small boosted trees are
grown on labelled rows; every path from a root is a conjunctive rule over thresholds; lasso logistic regression keeps a few
weighted rules; these are compiled into one Spark column expression, in which scoring is plain arithmetic.

Training takes at most `MOST_LABELLED` labelled rows (those of least hash) to the driver, as statistics, not texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import Renamed, blocks, text_block
from fathomline.llm.dealing import give_back
from fathomline.llm.kernels import byte_prefix, ranges, words

#: Bound on the labelled rows used for fitting.
MOST_LABELLED = 20_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*b"#$%&*+<=>@[\\]^_`{|}~/"]] = True
_MARK = np.zeros(256, bool)
_MARK[[*b".,;:!?'\"()-"]] = True

STATISTICS = ("log_bytes", "log_words", "mean_word", "long_words", "short_words", "upper", "digits", "symbols", "marks", "exclaims", "high_bytes", "white", "lines_per_word", "symbol_words", "mark_words", "upper_words", "bare_words", "distinct_words", "top_word", "doubled_words", "distinct_lines", "entropy")


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of STATISTICS per text; a text without words has zeros beyond its size."""
    n = len(at) - 1
    out = np.zeros((n, len(STATISTICS)), np.float64)
    size = np.diff(at)
    out[:, 0] = np.log1p(size)
    starts, ends, of = words(data, at)
    count = np.diff(of)
    out[:, 1] = np.log1p(count)
    if not len(starts):
        return out
    doc = np.repeat(np.arange(n), count)
    wh = ranges(byte_prefix(data, 11), starts, ends, 11)
    length = ends - starts

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])
        return sums[at[1:]] - sums[at[:-1]]

    def in_words(values: np.ndarray) -> np.ndarray:
        return np.bincount(doc, values, n)

    symbol, mark = _SYMBOL[data], _MARK[data]
    upper = (data >= 65) & (data <= 90)
    letter = upper | (data >= 97) & (data <= 122) | (data >= 128)
    digit = (data >= 48) & (data <= 57)
    first, last = data[starts], data[ends - 1]
    letters = np.concatenate([[0], np.cumsum(letter, dtype=np.int32)])
    uppers = np.concatenate([[0], np.cumsum(upper, dtype=np.int32)])
    word_letters, word_uppers = letters[ends] - letters[starts], uppers[ends] - uppers[starts]
    doubled = np.zeros(len(wh), bool)
    doubled[1:] = (wh[1:] == wh[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((wh, doc))
    new = np.ones(len(wh), bool)
    new[1:] = (wh[order][1:] != wh[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    places = np.flatnonzero(new)
    top = np.zeros(n)
    np.maximum.at(top, doc[order][places], np.diff(np.concatenate([places, [len(wh)]])))
    feed = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([at[:-1][size > 0], feed + 1]))
    line_start = line_start[line_start < len(data)]
    line_end = np.concatenate([line_start[1:], [len(data)]])
    line_doc = np.searchsorted(at, line_start, "right") - 1
    lh = ranges(byte_prefix(data, 11), line_start, np.maximum(line_end - (data[line_end - 1] == 10), line_start), 11)
    lines = np.bincount(line_doc, minlength=n)
    pair = np.unique(np.column_stack([line_doc.astype(np.uint64), lh]), axis=0)
    different = np.bincount(pair[:, 0].astype(np.int64), minlength=n)
    w, b = np.maximum(count, 1), np.maximum(size, 1)
    out[:, 2] = in_words(length) / w
    out[:, 3] = in_words(length > 12) / w
    out[:, 4] = in_words(length <= 3) / w
    out[:, 5] = total(upper) / np.maximum(total(letter), 1)
    out[:, 6], out[:, 7], out[:, 8], out[:, 9] = total(digit) / b, total(symbol) / b, total(mark) / b, total(data == 33) / b
    out[:, 10] = total(data >= 128) / b
    out[:, 11] = (size - in_words(length)) / b
    out[:, 12] = lines / w
    out[:, 13] = in_words(_SYMBOL[first] | _SYMBOL[last]) / w
    out[:, 14] = in_words(_MARK[last]) / w
    out[:, 15] = in_words((word_uppers == word_letters) & (word_letters > 1)) / w
    out[:, 16] = in_words(word_letters == 0) / w
    out[:, 17] = np.bincount(doc[order][places], minlength=n) / w
    out[:, 18] = top / w
    out[:, 19] = in_words(doubled) / w
    out[:, 20] = different / np.maximum(lines, 1)
    for i in np.flatnonzero(size):
        p = np.bincount(data[at[i] : at[i + 1]], minlength=256)
        p = p[p > 0] / size[i]
        out[i, 21] = -(p * np.log2(p)).sum()
    out[count == 0, 2:] = 0
    return out


def with_statistics(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns `keep` and one double column per statistic (prefix s_)."""
    names = [f"s_{s}" for s in STATISTICS]
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep) + ", " + ", ".join(f"{x} double" for x in names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, text):
                s = statistics(*text_block(b.column(text)))
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *(pa.array(np.ascontiguousarray(c)) for c in s.T)], names=[*keep, *names])
        give_back()

    return df.select(*keep, *([text] if text not in keep else [])).mapInArrow(each, schema)


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, threshold), all of which must hold


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, above, t in rule:
        out &= (x[:, j] > t) == above
    return out


def grow(x: np.ndarray, residual: np.ndarray, weight: np.ndarray, cuts: list[np.ndarray], depth: int, least: int) -> list[tuple[Rule, float]]:
    """A regression tree's nodes as (rule, Newton step), leaves and inner nodes alike; leaves are those no other extends."""
    out: list[tuple[Rule, float]] = []

    def node(rows: np.ndarray, rule: Rule) -> None:
        g, h = residual[rows], weight[rows]
        if rule:
            out.append((rule, float(g.sum() / (h.sum() + 1.0))))
        if len(rule) == depth or len(rows) < 2 * least:
            return
        best = (1e-6, -1, 0.0)
        whole = g.sum() ** 2 / (h.sum() + 1.0)
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            bin_of = np.searchsorted(c, x[rows, j], "left")
            gs, hs, ns = (np.cumsum(np.bincount(bin_of, v, len(c) + 1))[:-1] for v in (g, h, np.ones(len(rows))))
            gain = gs**2 / (hs + 1.0) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1.0) - whole
            gain[(ns < least) | (len(rows) - ns < least)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, float(c[k]))
        if best[1] >= 0:
            above = x[rows, best[1]] > best[2]
            node(rows[~above], (*rule, (best[1], False, best[2])))
            node(rows[above], (*rule, (best[1], True, best[2])))

    node(np.arange(len(x)), ())
    return out


def thresholds(v: np.ndarray, quantiles: int = 64, gaps: int = 16) -> np.ndarray:
    """Midpoints between neighbouring values: after quantiles, and in the widest gaps, where classes may part."""
    u, at = np.unique(v, return_inverse=True)
    if len(u) < 2:
        return np.zeros(0)
    places = np.sort(at)[np.linspace(0, len(v) - 1, quantiles + 2).astype(int)[1:-1]]
    wide = np.argsort(-np.diff(u), kind="stable")[:gaps]
    places = np.unique(np.concatenate([places, wide]))
    places = places[places < len(u) - 1]
    return (u[places] + u[places + 1]) / 2


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights that minimise mean log loss plus `penalty` * |weights|, by accelerated proximal gradient."""
    n, d = r.shape
    scale = np.maximum(r.std(0), 0.05)
    a = (r / scale).astype(np.float32)
    step = 1 / (0.25 * max(1.0, float(np.linalg.eigvalsh(a.T @ a / n)[-1]) if d else 1.0) + 0.25)
    w, b = np.zeros(d, np.float32), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    v, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        e = (sigmoid(a @ v + c) - y).astype(np.float32)
        new = v - step * (a.T @ e / n)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        b2 = c - step * float(e.mean())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t2 * (new - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = new, b2, t2
    return b, w / scale


@dataclass
class Ensemble:
    """A fitted model: an intercept and weighted rules."""

    intercept: float
    rules: list[tuple[Rule, float]]

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.intercept + sum((w * holds(r, x) for r, w in self.rules), np.zeros(len(x))))

    def column(self) -> Column:
        """The score as an expression over the s_ columns."""
        z = F.lit(self.intercept)
        for rule, w in self.rules:
            test = F.lit(True)
            for j, above, t in rule:
                c = F.col(f"s_{STATISTICS[j]}")
                test = test & ((c > F.lit(t)) if above else (c <= F.lit(t)))
            z = z + F.when(test, F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 0.001, seed: int = 1) -> Ensemble:
    """Boost small trees on halves of the rows, take all their paths as rules, and let the lasso choose. Without both
    classes the score is the smoothed share of class 1."""
    n = len(y)
    if n == 0 or y.min() == y.max():
        return Ensemble(float(np.log((y.sum() + 1) / (n - y.sum() + 1))), [])
    rng = np.random.default_rng(seed)
    cuts = [thresholds(x[:, j]) for j in range(x.shape[1])]
    z = np.full(n, np.log(y.mean() / (1 - y.mean())))
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        rows = rng.random(n) < 0.5
        p = sigmoid(z)
        nodes = grow(x[rows], (y - p)[rows], (p * (1 - p))[rows], cuts, depth, max(5, n // 400))
        inner = {r[:k] for r, _ in nodes for k in range(1, len(r))}
        for r, value in nodes:
            rules[r] = None
            if r not in inner:
                z += 0.3 * value * holds(r, x)
    kept, seen = [], set()
    for r in rules:
        column = holds(r, x)
        if 5 <= column.sum() <= n - 5 and (mark := np.packbits(column).tobytes()) not in seen:
            seen.add(mark)
            kept.append(r)
    if not kept:
        return Ensemble(float(np.log(y.mean() / (1 - y.mean()))), [])
    b, w = lasso_logistic(np.column_stack([holds(r, x) for r in kept]).astype(np.float32), y, penalty)
    return Ensemble(b, [(r, float(v)) for r, v in zip(kept, w, strict=True) if abs(v) > 1e-4])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = MOST_LABELLED) -> Ensemble:
    """Fit on labelled documents (null ids, labels and texts left out; a document labelled twice counts once, at the
    larger label). labels must already be without rows that are held out."""
    chosen = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("__id")).agg(F.max(label).alias("__y")).orderBy(F.xxhash64("__id"), "__id").limit(most)
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(chosen), "__id")
    got = np.array([list(r) for r in with_statistics(rows, "__text", ["__id", "__y"]).orderBy("__id", "s_entropy").collect()], np.float64).reshape(-1, 2 + len(STATISTICS))
    return fit(got[:, 2:], (got[:, 1] > 0).astype(np.float64))


def scored(docs: DataFrame, model: Ensemble, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score (0 to 1) of each row; null and empty texts are scored by their statistics, which are zero."""
    return with_statistics(docs, text, [key]).select(key, model.column().alias("score"))


def accepted(docs: DataFrame, model: Ensemble, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of `docs` with a score of at least `least`, whatever their other columns are called."""
    own = Renamed(docs)
    return own.back(with_statistics(own.df, own[text], own.df.columns).where(model.column() >= least).select(*own.df.columns))
