"""Language identification as inference of a mixture.

Counts of byte 3-grams (hashed to `BUCKETS`) per language are gathered over all labelled rows and make smoothed
likelihoods. A document's words are draws from a mixture of languages: expectation-maximisation estimates its proportions
from the words' n-gram likelihoods. Starting from all languages, however many, the least is taken out and the rest estimated
again; of these sets the one of the highest penalised likelihood (half a logarithm of the words for each further language)
is chosen, and its largest proportion names the document.

Several languages go at once only where that skips no better set: with responsibilities r, taking out the set D costs at
most the sum over words of -log(1 - r(D)); where this is less than the penalty of one language, the set without D beats
every set between.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import blocks, text_block
from fathomline.llm.kernels import words
from fathomline.llm.spaced_seeds import folded

BUCKETS = 1 << 15
SMOOTHING = 0.2
ITERATIONS = 12
#: Likelihoods (words x languages) that are held at a time; beyond it they are computed again for each pass.
MOST_HELD = 1 << 24

_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True


def grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the 3-grams at each byte of the texts laid out with a space before each and two after all; starts and
    ends of words there; and where each text's words begin. A word's grams are those from its start - 1 to its end - 2."""
    n, size = len(at) - 1, np.diff(at)
    out = np.full(len(data) + n + 2, 32, np.uint8)
    low = folded(data) if len(data) else data
    out[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), size)] = np.where(_LETTER[low], low, 32)
    starts, ends, _ = words(out, np.array([0, len(out)]))
    of = np.searchsorted(starts, at + np.arange(n + 1))
    x = out.astype(np.uint32)
    code = (x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761)
    return code >> np.uint32(32 - 15), starts, ends, of


@dataclass
class Model:
    """Languages in order and the log likelihood of each bucket in each, (buckets, languages)."""

    names: list[str]
    logp: np.ndarray


def train(docs: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = SMOOTHING) -> Model:
    """Count over all rows with a text and a language. The counts, at most languages x BUCKETS, come to the driver."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for b in blocks(batch, text):
                code, starts, ends, of = grams(*text_block(b.column(text)))
                inside = np.zeros(len(code) + 1, np.int32)
                np.add.at(inside, starts - 1, 1)
                np.add.at(inside, ends - 1, -1)
                at = np.flatnonzero(np.cumsum(inside[:-1]))
                names, which = np.unique(b.column(lang).to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
                word_doc = np.searchsorted(of, np.searchsorted(starts - 1, at, "right") - 1, "right") - 1
                for k, name in enumerate(names):
                    own = np.bincount(code[at[which[word_doc] == k]], minlength=BUCKETS)
                    counts[name] = counts[name] + own if name in counts else own
        for name, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at].astype(np.int64))], names=["lang", "bucket", "n"])

    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(text, F.col(lang).cast("string").alias(lang))
    got = rows.mapInArrow(each, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(got.column("lang").to_pylist()))
    counts = np.zeros((BUCKETS, len(names)))
    np.add.at(counts, (got.column("bucket").to_numpy(), np.searchsorted(names, got.column("lang").to_numpy().astype(str)) if names else []), got.column("n").to_numpy())
    with np.errstate(divide="ignore"):  # without smoothing an unseen gram is impossible
        return Model(names, np.log((counts + smoothing) / (counts.sum(0) + smoothing * BUCKETS)).astype(np.float32))


class Likelihoods:
    """Log likelihoods of words in all languages, by slices of bounded size. own(lo, hi): those of words lo to hi."""

    def __init__(self, own: Callable[[int, int], np.ndarray], words: int, languages: int, most: int = MOST_HELD):
        self.words, self.languages = words, languages
        step = max(1, most // max(1, languages))
        self.edges = [*range(0, words, step), words] if words else []
        self.own = own
        self.held = self._of(0, words) if 0 < words <= step and languages else None

    def _of(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        ll = self.own(lo, hi)
        top = ll.max(1, keepdims=True)
        return np.exp(ll - top), top[:, 0].astype(np.float64)

    def __iter__(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """First and last word, likelihoods relative to the word's best, and the best's logarithm."""
        for lo, hi in zip(self.edges, self.edges[1:], strict=False):
            yield lo, hi, *(self.held or self._of(lo, hi))


def _by_text(rows: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of each text; text: their texts' numbers in order."""
    out = np.zeros((n, *rows.shape[1:]))
    if len(text):
        first = np.flatnonzero(np.diff(text, prepend=-1))
        out[text[first]] = np.add.reduceat(rows, first, axis=0, dtype=np.float64)
    return out


def mixtures(like: Likelihoods | np.ndarray, of: np.ndarray, iterations: int = ITERATIONS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (texts, languages) of the best set by penalised likelihood, and that likelihood per word. of: where each
    text's words begin. Texts without words have zeros."""
    if isinstance(like, np.ndarray):
        like = Likelihoods(lambda lo, hi, ll=like: ll[lo:hi], *like.shape)
    n, k = len(of) - 1, like.languages
    count = np.diff(of)
    best, best_score = np.zeros((n, k)), np.full(n, -np.inf)
    if not k:
        return best, best_score
    text = np.repeat(np.arange(n), count)
    active = np.ones((n, k), bool)
    todo = np.flatnonzero(count)
    while len(todo):
        place = np.full(n, -1)
        place[todo] = np.arange(len(todo))
        used = np.flatnonzero(active[todo].any(0))  # the other languages are out for all of these

        def slices() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for lo, hi, x, top in like:
                at = place[text[lo:hi]]
                rows = np.flatnonzero(at >= 0)
                if len(rows):
                    yield (x, at, top) if len(rows) == len(at) and len(used) == k else (x[np.ix_(rows, used)], at[rows], top[rows])

        parts = list(slices()) if like.held else None
        on, m = active[np.ix_(todo, used)], count[todo].astype(np.float64)
        p = on / on.sum(1, keepdims=True)
        for _ in range(iterations if on.sum(1).max() > 1 else 0):
            shares = np.zeros(p.shape)
            for x, at, _top in parts or slices():
                r = x * p.astype(np.float32)[at]
                r /= r.sum(1, keepdims=True) + np.float32(1e-30)
                shares += _by_text(r, at, len(todo))
            p = shares / m[:, None]
        penalty = 0.5 * np.log(m + 1)
        score = -penalty * (on.sum(1) - 1)
        cost = np.zeros(p.shape)
        order = np.argsort(p, axis=1, kind="stable")
        for x, at, top in parts or slices():
            r = x * p.astype(np.float32)[at]
            whole = r.sum(1, keepdims=True) + np.float32(1e-30)
            score += _by_text(top + np.log(whole[:, 0].astype(np.float64)), at, len(todo))
            gone = np.cumsum(np.take_along_axis(r / whole, order[at], 1), axis=1, dtype=np.float64)
            cost += _by_text(-np.log(np.maximum(1 - gone, 1e-9)), at, len(todo))
        better = np.flatnonzero(score > best_score[todo])
        best[todo[better]] = 0
        best[np.ix_(todo[better], used)] = p[better]
        best_score[todo[better]] = score[better]
        more = np.flatnonzero(on.sum(1) > 1)
        free = (cost[more] < penalty[more, None]).sum(1)  # inactive ones cost nothing and come first
        out = np.minimum(np.maximum(free, (~on[more]).sum(1) + 1), len(used) - 1)
        rank = np.argsort(order[more], axis=1)
        active[np.ix_(todo[more], used)] = rank >= out[:, None]
        todo = todo[more]
    best_score[count > 0] /= count[count > 0]
    return best, best_score


def identified(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score (the proportion of that language), languages and proportions (the chosen set, largest first).

    A text that is null or has no letter is `und` with score 0, as is every text when nothing was learned. Of equal
    proportions the first language in order is named. A text of any length is one row of one task, which holds its bytes and at
most `MOST_HELD` likelihoods."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logp = shared.value.names, shared.value.logp
        for batch in batches:
            for b in blocks(batch, text, max(1 << 14, (1 << 20) * 8 // max(8, len(names)))):
                texts = b.column(text)
                code, starts, ends, of = grams(*text_block(texts))
                k = len(names)

                def own(lo: int, hi: int) -> np.ndarray:
                    first, last = starts[lo] - 1, ends[hi - 1]
                    sums = np.concatenate([np.zeros((1, k)), np.cumsum(logp[code[first:last]], axis=0, dtype=np.float64)])
                    return (sums[ends[lo:hi] - 1 - first] - sums[starts[lo:hi] - 1 - first]).astype(np.float32)

                share, _ = mixtures(Likelihoods(own, len(starts), k), of)
                order = np.argsort(-share, axis=1, kind="stable")
                pred, score, langs, shares = [], [], [], []
                for i in range(b.num_rows):
                    t = texts[i].as_py()
                    if of[i] == of[i + 1] or not k or not any(map(str.isalpha, t)):
                        pred.append("und")
                        score.append(0.0)
                        langs.append([])
                        shares.append([])
                        continue
                    used = [int(j) for j in order[i] if share[i, j] > 0]
                    pred.append(names[used[0]])
                    score.append(min(1.0, float(share[i, used[0]])))
                    langs.append([names[j] for j in used])
                    shares.append([float(share[i, j]) for j in used])
                yield pa.RecordBatch.from_arrays([b.column(key), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(langs, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))], names=[key, "lang_pred", "score", "languages", "proportions"])

    return docs.select(key, text).mapInArrow(each, f"{key} {docs.schema[key].dataType.simpleString()}, lang_pred string, score double, languages array<string>, proportions array<double>")
