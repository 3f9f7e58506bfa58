"""Best-fit packing into sequences of bounded length.

Each task packs its own rows online with a bounded number of open bins: a bitset over free space finds the open bin that
fits tightest in one shift; when nothing fits and all bins are open, the fullest closes. What is still open when a task ends
goes on, bin by bin in the order of tasks and bins, to another such packer with the same bound on open bins, one for up to
`GROUP` tasks, so that the number of tasks costs next to nothing. Texts are read once and never shuffled; what is moved are
the pieces of open bins.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import blocks, cut

LENGTH = 2048
OPEN_BINS = 1024
#: Tasks whose open bins are packed together at the end.
GROUP = 256
END_ID = 0
#: Distinct words whose ids a worker keeps.
REMEMBERED = 200_000

#: The published splitting pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_UNSAFE = re.compile(r"\s\s")


def _byte_of() -> dict[str, int]:
    """Byte-level BPE files write bytes as characters: printable ones as themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids of a text as little-endian uint32 bytes, equal to those of `tokenizers` for a byte-level BPE file.

    A token never begins with a non-space and runs over a space, so a text without two white-space characters in a row can
    be encoded word by word, and words are remembered. Texts with added tokens in them or with runs of white space are
    encoded whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.load = lambda: Tokenizer.from_file(path)
        self.whole = self.load()
        spec = json.loads(self.whole.to_str())
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.known: dict[str, bytes] = {}
        self.piece = None
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        odd = model.get("dropout") or model.get("ignore_merges") or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("byte_fallback")
        plain = spec.get("normalizer") is None and model.get("type", "BPE") == "BPE" and not odd and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        if plain:
            import tiktoken

            byte = _byte_of()
            ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
            merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
            made = [ranks.get(bytes(byte[c] for c in "".join(m)), -1) for m in merges]
            if all(x < y for x, y in zip(made, made[1:], strict=False)):  # then ids are ranks
                self.piece = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
                self.whole = None  # loaded again for a text that needs it

    def _ids(self, text: str) -> bytes:
        if self.piece is None or any(s in text for s in self.special):
            self.whole = self.whole or self.load()
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.piece(text), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if self.piece is None or _UNSAFE.search(text) or any(s in text for s in self.special):
            return self._ids(text)
        first, *rest = text.split(" ")
        known = self.known
        got = list(map(known.get, rest))
        if None in got:
            if len(known) > REMEMBERED:
                known.clear()
            for i, x in enumerate(got):
                if x is None:
                    got[i] = x = self._ids(" " + rest[i])
                    if len(x) <= 64:
                        known[rest[i]] = x
        return self._ids(first) + b"".join(got)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Bins:
    """Bounded-space best fit. place() returns (bin, offset); closed bins are appended to `closed` as (bin, fill)."""

    def __init__(self, length: int = LENGTH, most: int = OPEN_BINS):
        self.length, self.most = length, most
        self.bits = 0
        self.by_free: list[list[int]] = [[] for _ in range(length + 1)]
        self.open = self.made = 0
        self.closed: list[tuple[int, int]] = []

    def _take(self, free: int) -> int:
        own = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return own

    def place(self, size: int) -> tuple[int, int]:
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            own = self._take(free)
        else:
            if self.open >= self.most:
                fullest = (self.bits & -self.bits).bit_length() - 1
                self.closed.append((self._take(fullest), self.length - fullest))
            own, free = self.made, self.length
            self.made += 1
        left = free - size
        if left:
            self.by_free[left].append(own)
            self.bits |= 1 << left
            self.open += 1
        else:
            self.closed.append((own, self.length))
        return own, self.length - free

    def rest(self) -> list[tuple[int, int]]:
        return [(b, self.length - free) for free in range(1, self.length + 1) for b in self.by_free[free]]


def cuts(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one if it fits, else full ones of which the first may be shorter."""
    if n <= length:
        return [(0, n)]
    lead = n % length
    return [(0, lead)] * (lead > 0) + [(s, length) for s in range(lead, n, length)]


def pack(df: DataFrame, key: str, text: str, tokenizer: str, length: int = LENGTH, open_bins: int = OPEN_BINS, with_ids: bool = False) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset (and its ids).

    A document is its ids and the end id; null and empty texts are the end id alone; repeated rows are packed each.
    Sequences are gapless from offset 0 and at most `length` long. A text of any length is encoded by one task."""
    kind = df.schema[key].dataType.simpleString()
    names = [key, "piece", "start", "length", "ids_crc32", "__bin", "offset", "__fill", "__open", *(["ids"] if with_ids else [])]
    schema = f"{key} {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, __bin bigint, offset bigint, __fill bigint, __open boolean" + (", ids array<int>" if with_ids else "")
    end = np.array([END_ID], "<u4").tobytes()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins, task = encoder(tokenizer), Bins(length, open_bins), TaskContext.get().partitionId() << 32
        held: dict[int, list[tuple]] = {}
        ready: list[tuple] = []

        def finish(which: list[tuple[int, int]], is_open: bool) -> None:
            for b, fill in which:
                ready.extend((*r, fill, is_open, *ids) for r, ids in held.pop(b))

        def out() -> pa.RecordBatch:
            columns = list(zip(*ready, strict=True)) if ready else [()] * len(names)
            arrow = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)
            ready.clear()
            return arrow

        for batch in (part for whole in batches for part in blocks(whole, text)):
            kinds = [batch.schema.field(key).type, pa.int32(), *[pa.int64()] * 6, pa.bool_(), *([pa.list_(pa.int32())] if with_ids else [])]
            for k, t in zip(batch.column(key).to_pylist(), batch.column(text), strict=True):
                ids = encode(t.as_py() or "") + end
                for piece, (start, n) in enumerate(cuts(len(ids) // 4, length)):
                    own = ids[start * 4 : (start + n) * 4]
                    b, offset = bins.place(n)
                    held.setdefault(b, []).append(((k, piece, start, n, zlib.crc32(own), task | b, offset), (np.frombuffer(own, "<u4").astype(np.int32),) if with_ids else ()))
                if bins.closed:
                    finish(bins.closed, False)
                    bins.closed.clear()
                if len(ready) > 5000:
                    yield out()
        finish(bins.rest(), True)
        if ready:
            yield out()

    placed = cut(df.select(key, text).mapInArrow(each, schema))
    left = placed.where("__open and offset = 0").select("__bin", "__fill", F.expr(f"shiftright(__bin, 32) div {GROUP}").alias("g"))

    def again(table: pa.Table) -> pa.Table:
        """Open bins as items, in order, into bounded open bins; a new sequence has the number of its first."""
        ids, fills = table.column("__bin").to_numpy(), table.column("__fill").to_numpy()
        order = np.argsort(ids)
        bins = Bins(length, open_bins)
        at = [bins.place(int(f)) for f in fills[order]]
        first = {b: int(i) for i, (b, o) in zip(ids[order], at, strict=True) if not o}
        return pa.table({"__bin": ids[order], "sequence_id": pa.array([first[b] for b, _ in at], pa.int64()), "__base": pa.array([o for _, o in at], pa.int64())})

    merged = left.groupBy("g").applyInArrow(again, "__bin bigint, sequence_id bigint, __base bigint")
    keep = [key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    moved = placed.where("__open").join(merged, "__bin").withColumn("offset", F.col("offset") + F.col("__base")).select(*keep)
    return placed.where("not __open").withColumn("sequence_id", F.col("__bin")).select(*keep).unionByName(moved)
