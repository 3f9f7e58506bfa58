"""Recursive splitting of documents into chunks of bounded length, with offsets in code points.

The text is cut at the strongest separator there is; what is still too long is cut at the next weaker one, and last at any
character. The pieces are then put together greedily up to the chunk size, each chunk taking up to `overlap` characters of
the one before. The output is deterministic.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_SIZE, DEFAULT_OVERLAP = 2000, 200
LEAST_SIZE, MOST_SIZE = 64, 100_000
MOST_CHUNKS, MOST_BYTES, MOST_AMPLIFICATION = 10_000, 32 << 20, 4

# Separators, the strongest first.
SEPARATORS = ("\r\n\r\n", "\n\n", "\r\n", "\n", ". ", "? ", "! ", "; ", ", ", " ")
# The code points with the Unicode property White_Space.
_BLANK = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


class SplitError(ValueError):
    """The document is refused as a whole."""


def check_geometry(size: int, overlap: int) -> list[str]:
    """Bounds of a declared geometry; returns warnings."""
    if not LEAST_SIZE <= size <= MOST_SIZE:
        raise SplitError(f"chunk_size must be in {LEAST_SIZE}..{MOST_SIZE}")
    if not 0 <= overlap < size:
        raise SplitError("chunk_overlap must be at least 0 and less than chunk_size")
    return ["chunk_overlap is over 75% of chunk_size: documents may be refused for their output"] if overlap * 4 > size * 3 else []


def _pieces(text: str, lo: int, hi: int, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Adjoining spans of at most `size` that cover [lo, hi), by an explicit stack of (span, next separator)."""
    todo = [(lo, hi, 0)]
    while todo:
        a, b, level = todo.pop()
        if b - a <= size:
            if b > a:
                yield a, b
            continue
        if level == len(SEPARATORS):
            stride = max(size - overlap, 1)
            for p in range(a, b, stride):
                yield p, min(p + stride, b)
            continue
        mark = SEPARATORS[level]
        cuts, at = [a], text.find(mark, a, b)
        while at >= 0:
            cuts.append(at + len(mark))
            at = text.find(mark, cuts[-1], b)
        if cuts[-1] < b:
            cuts.append(b)
        todo.extend((x, y, level + 1) for x, y in zip(cuts[-2::-1], cuts[:0:-1], strict=True))


def split(text: str, size: int = DEFAULT_SIZE, overlap: int = DEFAULT_OVERLAP) -> list[tuple[int, int, int, str]]:
    """(seq, start, end, text) of the chunks; blank ones are left out. A document over a bound is refused whole."""
    if size < 1 or not 0 <= overlap < size:
        raise SplitError(f"invalid geometry: size {size}, overlap {overlap}")
    if len(text) > MOST_BYTES or len(text) * 4 > MOST_BYTES and len(text.encode()) > MOST_BYTES:
        raise SplitError(f"document is over {MOST_BYTES} bytes")
    if not text.strip(_BLANK):
        return []
    budget, spent = max(len(text) * MOST_AMPLIFICATION, size), 0
    out: list[tuple[int, int, int, str]] = []

    def close(a: int, b: int) -> None:
        nonlocal spent
        spent += b - a
        if spent > budget:
            raise SplitError(f"chunks would take more than {budget} characters")
        chunk = text[a:b]
        if chunk.strip(_BLANK):
            if len(out) == MOST_CHUNKS:
                raise SplitError(f"more than {MOST_CHUNKS} chunks")
            out.append((len(out), a, b, chunk))

    begin = end = 0
    for a, b in _pieces(text, 0, len(text), size, overlap):
        if b - begin > size and end > begin:
            close(begin, end)
            begin = max(end - overlap, begin + 1, b - size)
        end = b
    close(begin, end)
    return out


CHUNKS = "array<struct<seq:int,start:bigint,end:bigint,text:string>>"


def split_column(text: Column | str, size: int = DEFAULT_SIZE, overlap: int = DEFAULT_OVERLAP) -> Column:
    """struct<chunks, error> of each text; a refused document has no chunks and an error."""
    text = F.col(text) if isinstance(text, str) else text

    @F.arrow_udf(f"struct<chunks:{CHUNKS},error:string>")
    def each(a):
        import pyarrow as pa

        out = []
        for t in a.to_pylist():
            try:
                out.append({"chunks": None if t is None else [dict(zip(("seq", "start", "end", "text"), c, strict=True)) for c in split(t, size, overlap)], "error": None})
            except SplitError as e:
                out.append({"chunks": [], "error": str(e)})
        kind = pa.struct([("chunks", pa.list_(pa.struct([("seq", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))), ("error", pa.string())])
        return pa.array(out, kind)

    return each(text)


def chunked(df: DataFrame, key: str, text: str, size: int = DEFAULT_SIZE, overlap: int = DEFAULT_OVERLAP) -> tuple[DataFrame, DataFrame]:
    """(source_pk, chunk_seq, char_start, char_end, chunk_text) of all documents, and (source_pk, error) of refused ones."""
    made = df.select(F.col(key).alias("source_pk"), split_column(text, size, overlap).alias("s"))
    chunks = made.select("source_pk", F.inline("s.chunks")).toDF("source_pk", "chunk_seq", "char_start", "char_end", "chunk_text")
    return chunks, made.where("s.error is not null").select("source_pk", "s.error")
