"""Text analysis and the web-style query language.

`simple` lowers and takes runs of letters and digits, as built-in expressions. `english` also drops stop words and stems
(Porter's published algorithm) in an Arrow function over distinct tokens. Positions count all words, dropped ones too.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_RUN = re.compile(r"[^\W_]+")
MOST_POSITION, MOST_POSITIONS = 16383, 256

# The common English stop word list.
STOP_WORDS = frozenset("i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split())


@lru_cache(maxsize=100_000)
def stem(w: str) -> str:
    """Porter's algorithm of 1980."""
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w

    def cons(s: str, i: int) -> bool:
        return s[i] not in "aeiou" and not (s[i] == "y" and i and cons(s, i - 1))

    def measure(s: str) -> int:
        kinds = [cons(s, i) for i in range(len(s))]
        return sum(1 for a, b in zip(kinds, kinds[1:], strict=False) if not a and b)

    def vowel(s: str) -> bool:
        return any(not cons(s, i) for i in range(len(s)))

    def double(s: str) -> bool:
        return len(s) > 1 and s[-1] == s[-2] and cons(s, len(s) - 1)

    def cvc(s: str) -> bool:
        return len(s) > 2 and cons(s, len(s) - 1) and not cons(s, len(s) - 2) and cons(s, len(s) - 3) and s[-1] not in "wxy"

    def step(s: str, table: str, least: int) -> str:
        for pair in table.split():
            old, _, new = pair.partition(":")
            if s.endswith(old):
                base = s[: -len(old)]
                return base + new if measure(base) > least and (old != "ion" or base[-1:] in ("s", "t")) else s
        return s

    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and cvc(w):
                    w += "e"
                break
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    w = step(w, "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble", 0)
    w = step(w, "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:", 0)
    w = step(w, "ement: ment: ance: ence: able: ible: ant: ent: ism: ate: iti: ous: ive: ize: ion: al: er: ic: ou:", 1)
    if w.endswith("e") and (measure(w[:-1]) > 1 or measure(w[:-1]) == 1 and not cvc(w[:-1])):
        w = w[:-1]
    return w[:-1] if measure(w) > 1 and double(w) and w.endswith("l") else w


def words_of(text: str) -> list[str]:
    return _RUN.findall(text.lower())


def lexemes(text: str, config: str) -> list[str | None]:
    """The query side of `tokens`: None where a word was dropped."""
    words = words_of(text)
    if config == "simple":
        return list(words)
    if config == "english":
        return [None if w in STOP_WORDS else stem(w) for w in words]
    raise ValueError(f"unknown text configuration {config!r}: simple or english")


def tokens(text: Column | str, config: str = "simple") -> Column:
    """array<string> of the text's words in order; for `english` null where a stop word stood. Null for a null text.
    For `english` make it a column of its own before using it in higher-order functions."""
    text = F.col(text) if isinstance(text, str) else text
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    if config == "simple":
        return words
    if config != "english":
        raise ValueError(f"unknown text configuration {config!r}: simple or english")

    @F.arrow_udf("array<string>")
    def reduced(a):
        import pyarrow as pa
        import pyarrow.compute as pc

        coded = pc.dictionary_encode(a.flatten())
        each = pa.array([None if w in STOP_WORDS else stem(w) for w in coded.dictionary.to_pylist()], pa.string())
        flat = each.take(coded.indices)
        out, at = [], 0
        for n, null in zip(pc.fill_null(pc.list_value_length(a), 0).to_pylist(), a.is_null().to_pylist(), strict=True):
            out.append(None if null else flat.slice(at, n).to_pylist())
            at += n
        return pa.array(out, pa.list_(pa.string()))

    return reduced(words)


def text_vector(tok: Column) -> Column:
    """array<struct<lexeme, positions>> sorted by lexeme; positions from 1, at most 256 each, none above 16383."""
    placed = F.filter(F.transform(tok, lambda t, i: F.struct(t.alias("t"), F.least(i + 1, F.lit(MOST_POSITION)).alias("p"))), lambda s: s["t"].isNotNull())
    names = F.array_sort(F.array_distinct(F.transform(placed, lambda s: s["t"])))
    return F.transform(names, lambda n: F.struct(n.alias("lexeme"), F.slice(F.array_distinct(F.transform(F.filter(placed, lambda s: s["t"] == n), lambda s: s["p"])), 1, MOST_POSITIONS).alias("positions")))


# A query is None (matches nothing) or a tree of these.
@dataclass(frozen=True)
class Phrase:
    """Lexemes with their distances from the first: one word, or words that stand so."""

    words: tuple[tuple[str, int], ...]


@dataclass(frozen=True)
class Not:
    of: Node


@dataclass(frozen=True)
class Both:
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Either:
    parts: tuple[Node, ...]


Node = Phrase | Not | Both | Either


def parse_query(query: str, config: str = "simple") -> Node | None:
    """Words are all required, "a phrase" must stand so, `or` parts alternatives, a leading - excludes. Never an error."""
    groups: list[list[Node]] = [[]]
    for m in re.finditer(r'(-?)"([^"]*)(?:"|$)|(\S+)', query):
        word = m.group(3)
        if word is not None and word.lower() == "or":
            if groups[-1]:
                groups.append([])
            continue
        negative = m.group(1) == "-" or bool(word and word.startswith("-") and len(word) > 1)
        found = [(w, i) for i, w in enumerate(lexemes(m.group(2) if word is None else word, config)) if w is not None]
        if not found:
            continue
        node: Node = Phrase(tuple((w, i - found[0][1]) for w, i in found))
        groups[-1].append(Not(node) if negative else node)
    parts = [g[0] if len(g) == 1 else Both(tuple(g)) for g in groups if g]
    return None if not parts else parts[0] if len(parts) == 1 else Either(tuple(parts))


def positive_terms(node: Node | None) -> list[str]:
    """Lexemes that aren't excluded, phrases' included, once each, in binary order."""
    if node is None or isinstance(node, Not):
        return []
    if isinstance(node, Phrase):
        return sorted({w for w, _ in node.words})
    return sorted({t for p in node.parts for t in positive_terms(p)})


def occurrences(tok: Column, word: str) -> Column:
    return F.size(F.filter(tok, lambda t: t == word))


def matches(tok: Column, node: Node | None) -> Column:
    """Whether tokens satisfy the query."""
    if node is None:
        return F.lit(False)
    if isinstance(node, Not):
        return ~matches(tok, node.of)
    if isinstance(node, Phrase):
        all_in = F.lit(True)
        for w, _ in node.words:
            all_in = all_in & (occurrences(tok, w) > 0)
        if len(node.words) == 1:
            return all_in
        first, *others = node.words

        def here(i: Column) -> Column:
            ok = F.coalesce(F.get(tok, i) == first[0], F.lit(False))
            for w, d in others:
                ok = ok & F.coalesce(F.get(tok, i + d) == w, F.lit(False))
            return ok

        return F.when(all_in, F.exists(F.sequence(F.lit(0), F.greatest(F.size(tok) - 1, F.lit(0))), here)).otherwise(F.lit(False))
    out = [matches(tok, p) for p in node.parts]
    for other in out[1:]:
        out[0] = (out[0] & other) if isinstance(node, Both) else (out[0] | other)
    return out[0]


def cover_density(tok: Column, terms: list[str]) -> Column:
    """Rank by covers: each shortest stretch that holds all the terms, from one start on, scores the number of terms' weight
    (0.1, the default class) over 1 + its excess length. 0 without any cover."""
    if not terms:
        return F.lit(0.0)
    hits = F.filter(F.transform(tok, lambda t, i: F.struct(i.alias("i"), t.alias("t"))), lambda s: F.coalesce(s["t"].isin(terms), F.lit(False)))
    n = len(terms)

    def first_of(rest: Column, term: str) -> Column:
        return F.array_min(F.transform(F.filter(rest, lambda r: r["t"] == term), lambda r: r["i"]))

    def cover(s: Column, at: Column) -> Column:
        rest = F.slice(hits, at + 1, F.size(hits))
        firsts = [first_of(rest, t) for t in terms]
        end = firsts[0] if n == 1 else F.greatest(*firsts)
        complete = firsts[0].isNotNull()
        for f in firsts[1:]:
            complete = complete & f.isNotNull()
        return F.struct(F.when(complete, end).alias("end"), s["i"].alias("start"))

    covers = F.filter(F.transform(hits, cover), lambda c: c["end"].isNotNull())
    # Of covers with one end only the last start is a shortest one.
    shortest = F.filter(covers, lambda c: ~F.exists(covers, lambda d: (d["end"] == c["end"]) & (d["start"] > c["start"])))
    return F.aggregate(shortest, F.lit(0.0), lambda a, c: a + F.lit(0.1) / (F.lit(1.0) + c["end"] - c["start"] - (n - 1)))
