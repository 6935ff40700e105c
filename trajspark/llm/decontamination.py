"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Symbols are words (A-Z lower-cased, then runs of digits, letters and bytes over 7F).  The
patterns are the windows of `size` consecutive words of every test item; an item of fewer
words is one pattern.  Patterns of one length m are searched together:

1. SHIFT: for each block of B words (2, or 1 if m is 1) how far the search may move on when a
   window of the text ends with it: the least distance from the block to the end of any
   pattern, m - B + 1 if no pattern has it.
2. A text's windows are walked by many cursors, LANE window ends each, that jump by the shifts
   of the blocks they see; what lies between is never looked at.
3. Where the shift is 0, the bucket of patterns that end with this block and begin with the
   window's first block is compared word for word, and what is left byte for byte.

Tables hold at most BLOCK_BYTES of test text.  A larger benchmark is searched in blocks, one
after the other: the driver holds one of them, the hits of each are written to the shared
folder, and meet again by a row number of the documents.

Null and empty texts and items have no words; an item without an id is searched under ''.
Repeated items count by their item_id; repeated documents, and rows with the same or no doc_id,
are searched each.  Empty tables give no hits or no rows.  Whole texts are searched whatever
their length.  Columns other than doc_id, text, item_id are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _arrays as A
from ._arrays import U
from ._tables import arrow_rows, cut, numbered

BLOCK_BYTES = 8 << 20
#: Window ends that one cursor walks.
LANE = 128
TO_WORDS = bytes(A.LOWER[b] if A.ALNUM[A.LOWER[b]] else 32 for b in range(256))
PLACE = A.mix(np.arange(301, 366, dtype=np.uint64) * A.GOLD) | U(1)


def item_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TO_WORDS).split()


def _word_hashes(words: list[bytes]) -> np.ndarray:
    length = np.array([len(w) for w in words], np.int64)
    end = np.cumsum(length)
    return A.SpanHash(np.frombuffer(b"".join(words), np.uint8))(end - length, end)


def _sequence_hash(w: np.ndarray, start: np.ndarray, m: int) -> np.ndarray:
    h = np.zeros(len(start), U)
    for j in range(m):
        h += w[start + j] * PLACE[j % 64] + np.array([j // 64], U)
    return A.mix(h)


class Tables:
    """SHIFT, suffix buckets and patterns of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str]], m: int):
        self.m, self.b = m, min(2, m)
        self.far = m - self.b + 1
        words = list(patterns)
        w = _word_hashes([x for p in words for x in p]).reshape(-1, m)
        ends = _sequence_hash(w.ravel(), np.arange(len(w)) * m + m - self.b, self.b)
        heads = _sequence_hash(w.ravel(), np.arange(len(w)) * m, self.b)
        bucket = A.mix(ends * PLACE[60] + heads)
        order = np.argsort(bucket, kind="stable")
        self.buckets, self.hashes = bucket[order], w[order]
        self.words = [words[k] for k in order.tolist()]
        self.items = [sorted(set(patterns[x])) for x in self.words]
        blocks = np.concatenate([_sequence_hash(w.ravel(), np.arange(len(w)) * m + j, self.b) for j in range(self.far)])
        shift = np.repeat(self.far - 1 - np.arange(self.far), len(w))
        by = np.lexsort((shift, blocks))
        first = np.concatenate(([True], blocks[by][1:] != blocks[by][:-1])) if len(by) else np.zeros(0, bool)
        self.blocks, self.shift = blocks[by][first], shift[by][first]

    def shifts(self, block: np.ndarray) -> np.ndarray:
        """The shift for each block: the table's, or the farthest for blocks that no pattern has."""
        k = np.minimum(np.searchsorted(self.blocks, block), len(self.blocks) - 1)
        return np.where(self.blocks[k] == block, self.shift[k], self.far)

    def stops(self, w: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Starts of the windows of rows bounds[i]..bounds[i+1] at whose ends the shift is 0."""
        n = np.maximum(0, np.diff(bounds) - self.m + 1)
        lanes = -(-n // LANE)
        row = np.repeat(np.arange(len(n)), lanes)
        nth = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = bounds[:-1][row] + nth * LANE
        until = np.minimum(at + LANE, bounds[:-1][row] + n[row])
        found = []
        while len(at):
            shift = self.shifts(_sequence_hash(w, at + self.m - self.b, self.b))
            found.append(at[shift == 0])
            at = at + np.maximum(1, shift)
            on = at < until
            at, until = at[on], until[on]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def search(self, w: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts in w, and pattern numbers, of what occurs inside rows bounds[i]..bounds[i+1], by word hashes."""
        at = self.stops(w, bounds)
        bucket = A.mix(_sequence_hash(w, at + self.m - self.b, self.b) * PLACE[60] + _sequence_hash(w, at, self.b))
        lo, hi = np.searchsorted(self.buckets, bucket, "left"), np.searchsorted(self.buckets, bucket, "right")
        many = hi - lo
        start = np.repeat(at, many)
        pattern = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
        for j in range(self.m):
            same = w[start + j] == self.hashes[pattern, j]
            start, pattern = start[same], pattern[same]
        return start, pattern


def tables_of(items: list[tuple[str, str | None]], size: int) -> list[Tables]:
    by_length: dict[int, dict[tuple[bytes, ...], list[str]]] = {}
    for item, text in items:
        w = item_words(text)
        m = min(size, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            by_length.setdefault(m, {}).setdefault(tuple(w[i : i + m]), []).append(item)
    return [Tables(p, m) for m, p in sorted(by_length.items())]


def _blocks(items: DataFrame) -> Iterator[list[tuple[str, str | None]]]:
    part, size = [], 0
    for r in items.toLocalIterator():
        part.append((r[0], r[1]))
        size += len(r[1] or "")
        if size >= BLOCK_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for batch in batches:
            counts, runs, items = [], [], []
            for _, _, buf, offs in A.groups(*A.text_buffer(batch.column("text"))):
                low = A.LOWER[buf]
                start, end, row = A.words(low, offs, A.ALNUM)
                n = len(offs) - 1
                bounds = A.first_of_row(row, n)
                counts += np.diff(bounds).tolist()
                runs += [[] for _ in range(n)]
                items += [set() for _ in range(n)]
                if not len(start):
                    continue
                w = A.SpanHash(low)(start, end)
                here = slice(len(runs) - n, None)
                own_runs, own_items = runs[here], items[here]
                for t in tables:
                    for s, p in zip(*(x.tolist() for x in t.search(w, bounds)), strict=True):
                        if all(low[start[s + j] : end[s + j]].tobytes() == x for j, x in enumerate(t.words[p])):
                            r = int(row[s])
                            own_runs[r].append((s - int(bounds[r]), t.m))
                            own_items[r].update(t.items[p])
            keep = [c for c in batch.schema.names if c != "text"]
            flat = [[x for s, m in r for x in (s, s + m)] for r in runs]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(counts, pa.int64()), pa.array(flat, pa.list_(pa.int64())), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], [*keep, "n_words", "runs", "items"])

    return run


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits, n_items, digests = [], [], []
        for runs, items in zip(batch.column("runs").to_pylist(), batch.column("items").to_pylist(), strict=True):
            covered, upto = 0, 0
            for s, e in sorted(zip(runs[::2], runs[1::2], strict=True)):
                covered += max(0, e - max(s, upto))
                upto = max(upto, e)
            items = sorted(set(items))
            hits.append(covered)
            n_items.append(len(items))
            digests.append(hashlib.sha256(",".join(items).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(hits, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digests, pa.string()), pa.array([h > 0 for h in hits], pa.bool_())], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def find_items(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """(doc_id, n_words, runs, items) for every row of docs(doc_id, text): the word runs
    (start, end, start, end, ...) under occurrences of windows of items(item_id, text), and whose they are."""
    spark = docs.sparkSession
    arrow_rows(spark)
    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string")).orderBy("item_id", "text")
    found = "n_words long, runs array<long>, items array<string>"
    blocks = _blocks(items)
    part, more = next(blocks, []), next(blocks, None)
    if more is None:
        return text.mapInArrow(_search(spark.sparkContext.broadcast(tables_of(part, size))), f"doc_id long, {found}")
    rows = numbered(text)
    hits = None
    while part is not None:
        shared = spark.sparkContext.broadcast(tables_of(part, size))
        some = rows.select("row_id", "text").mapInArrow(_search(shared), f"row_id long, {found}")
        if hits is None:
            counts = some = cut(some)
            counts = counts.select("row_id", "n_words")
            some = some.where("size(runs) > 0")
        else:
            some = cut(some.where("size(runs) > 0"))
        shared.destroy()
        hits = some if hits is None else hits.union(some)
        part, more = more, next(blocks, None)
    hits = hits.groupBy("row_id").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    whole = rows.select("doc_id", "row_id").join(counts, "row_id").join(hits, "row_id", "left")
    return whole.select("doc_id", "n_words", *(F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("runs", "array<long>"), ("items", "array<string>"))))


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of docs(doc_id, text)."""
    return find_items(docs, items, size).mapInArrow(_summary, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
