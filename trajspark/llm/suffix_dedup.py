"""Suffix-array dedup: removes every byte under a string of 200 that starts elsewhere too.

A difference cover is a set of residues modulo PERIOD such that any two positions reach sampled
ones by one common offset below PERIOD.  Here PERIOD is 133 and the cover a perfect difference
set of 12 residues (every non-zero difference once), so 9 % of the positions are sampled, and two
equal strings of 200 bytes always have a sampled position in common, followed by GRAM = 68 equal
bytes at least.  Steps:

1. Sample, and name the sampled grams.  Names (64-bit hashes of the 68 bytes) are dealt over buckets;
   a suffix whose name occurs once is placed already and leaves.  So do names that only one
   residue has, unless it is the first one: strings that far apart share the first residue too.
2. Sort the rest to the depth that matters, 200 bytes to the right of a sample and PERIOD - 1 to the left:
   samples whose whole neighbourhood occurs again (128 bits of names) are settled with all their
   windows, and one of them stands for all; triples of 8-byte symbols of those that remain are sorted and named,
   triples of names again, until one name is a suffix's rank.
3. Merge the remaining suffixes: the one that starts l bytes before a sample is placed by
   the rank of the l bytes before it and the rank of the sample's suffix.
4. Compare adjacent prefixes: neighbours that agree on 200 bytes are repeats.

Only samples with equal grams can stand next to each other with 200 bytes in common, so steps 2 to 4 run in
parallel over gram names, in bounded chunks; a gram with more than HOT open neighbourhoods is dealt out
by its windows instead.  Within each task, neighbourhoods that repeat leave as one row.  The texts
are dealt by row once and read three times from there.

Null and empty texts have no bytes.  Texts under 200 bytes keep everything.  Repeated rows
are separate documents with their own positions.  Very long texts are sampled in slices.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _arrays as A
from ._tables import arrow_rows, numbered

U = np.uint64
SPAN = 200


def difference_cover(q: int) -> tuple[int, np.ndarray]:
    """A period and its perfect difference set, for a prime q: of q * q + q + 1 residues, the q + 1 at
    which a linear recurrence of order three modulo q is zero (a Singer set, where the recurrence has full period)."""
    period = q * q + q + 1
    for a, b, c in ((a, b, c) for a in range(q) for b in range(q) for c in range(1, q)):
        u = [0, 0, 1]
        while len(u) < period:
            u.append((a * u[-1] + b * u[-2] + c * u[-3]) % q)
        zeros = [i for i, x in enumerate(u) if not x]
        if len({(x - y) % period for x in zeros for y in zeros}) == period and len(zeros) == q + 1:
            return period, np.array(zeros)
    raise ValueError("q is not prime")


PERIOD, COVER = difference_cover(11)
REACH = PERIOD  # a sample lies at 0..REACH-1 in a window
GRAM = SPAN - PERIOD + 1
SLICE = 1 << 18
#: Text that is named before its names are dealt out, and samples that a bucket should hold.
UNIT, BUCKET = 1 << 23, 1_500_000
#: Open neighbourhoods of one gram up to which one task sorts them.
HOT = 20_000
CHUNK = 8_192
#: Flags of a sample, below its position.
OPEN, SETTLED, IS_HOT = 1, 2, 4


def sampled(n: int) -> np.ndarray:
    """The numbers of the samples of a text of n bytes that lie in a window."""
    if n < SPAN:
        return np.zeros(0, np.int64)
    k = np.arange(-(-n // PERIOD) * len(COVER))
    return k[position(k) + GRAM <= n]


def position(k: np.ndarray) -> np.ndarray:
    """Where in its text the sample of a number stands."""
    return k // len(COVER) * PERIOD + COVER[k % len(COVER)]


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int, int]]:
    """First and end row, bytes, offsets, and which positions are meant: rows of about SLICE bytes, all of
    their positions; a longer row in slices that overlap, so that a position's neighbourhood is whole."""
    buf, offs = A.text_buffer(batch.column("text"))
    for i, j, part, at in A.groups(buf, offs, SLICE):
        n = len(part)
        if n <= 2 * SLICE:
            yield i, j, part, at, 0, n
            continue
        for s in range(0, n, SLICE):  # a group over the limit is a single row
            lo = max(0, s - REACH)
            piece = part[lo : s + SLICE + SPAN]
            yield i, j, piece, np.array([-lo, n - lo]), s - lo, min(n, s + SLICE) - lo


def _alive(names: np.ndarray, residue: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of samples by name and residue, whether each name can lie in a repeat, and the group of each sample in that order."""
    order = np.lexsort((residue, names))
    sorted_ = names[order]
    new = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(names)) - 1
    least, most = residue[order[first]], residue[order[last]]
    return order, (last > first) & ((least != most) | (least == 0)), np.cumsum(new) - 1


REFS = "bucket int, size int, names binary, refs binary"


def _pack(rows: np.ndarray, numbers: np.ndarray) -> bytes:
    """Row ids and sample numbers, sorted by both."""
    raw = np.diff(rows, prepend=0).astype("<i8").tobytes() + np.diff(numbers, prepend=0).astype("<i8").tobytes()
    return pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(raw: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(pa.decompress(raw, decompressed_size=16 * size, codec="zstd", asbytes=True), "<i8")
    return np.cumsum(both[:size]), np.cumsum(both[size:])


def _name(buckets: int):
    """The names of all samples, dealt over buckets (32 bits go along, which tell nearly all names of a
    bucket apart; two that fall together only bring a sample to step 2 for nothing); what repeats within a unit of text is known to
    live, and goes without its name but for two samples that tell the others."""

    def emit(ids: list, numbers: list, names: list) -> Iterator[pa.RecordBatch]:
        row, number, name = (np.concatenate(x) for x in (ids, numbers, names))
        by = np.lexsort((number, row))
        row, number, name = row[by], number[by], name[by]
        order, alive, group = _alive(name, number % len(COVER))
        lives = alive[group]
        edge = np.ones(len(group), bool)
        edge[1:-1] = (group[1:-1] != group[:-2]) | (group[1:-1] != group[2:])
        sure = np.sort(order[lives])
        told = np.sort(order[~lives | edge])
        out = []
        if len(sure):
            out.append((int(row[sure[0]] % buckets), len(sure), b"", _pack(row[sure], number[sure])))
        bucket = (name[told] >> U(32)) % U(buckets)
        told = told[np.argsort(bucket, kind="stable")]
        bounds = np.searchsorted(np.sort(bucket), np.arange(buckets + 1).astype(U)) if buckets < len(told) else None
        parts = [told[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)] if bounds is not None else np.split(told, np.flatnonzero(np.diff(np.sort(bucket))) + 1)
        for part in parts:
            if len(part):
                low = name[part].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :4]
                out.append((int((name[part[0]] >> U(32)) % U(buckets)), len(part), low.tobytes(), _pack(row[part], number[part])))
        types = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["bucket", "size", "names", "refs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = ([], [], []), 0
        for batch in batches:
            ids = batch.column("row_id").to_numpy()
            for i, _, buf, offs, lo, hi in _pieces(batch):
                n = np.diff(offs)
                each = [sampled(int(x)) for x in n.tolist()]
                row = np.repeat(np.arange(len(n)), [len(x) for x in each])
                if not len(row):
                    continue
                number = np.concatenate(each)
                at = position(number) + offs[row]
                mine = (at >= lo) & (at < hi)
                row, number, at = row[mine], number[mine], at[mine]
                for x, y in zip(held, (ids[i + row], number, A.SpanHash(buf)(at, at + GRAM)), strict=True):
                    x.append(y)
                size += len(buf)
                if size >= UNIT:
                    yield from emit(*held)
                    held, size = ([], [], []), 0
        if any(map(len, held[0])):
            yield from emit(*held)

    return run


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row_id, number) of the samples that live; rows come sorted by bucket."""

    def judged(rows: list[tuple]) -> pa.RecordBatch:
        refs = [_unpack(r, n) for n, _, r in rows]
        row, number = (np.concatenate(x) for x in zip(*refs, strict=True))
        named = np.repeat([bool(x) for _, x, _ in rows], [n for n, _, _ in rows])
        name = np.frombuffer(b"".join(x for _, x, _ in rows), "<u4")
        keep = ~named
        if len(name):
            at = np.flatnonzero(named)
            order, alive, group = _alive(name, number[at] % len(COVER))
            keep[at[order[alive[group]]]] = True
        return pa.RecordBatch.from_arrays([pa.array(row[keep]), pa.array(number[keep])], ["row_id", "number"])

    held, now = [], None
    for batch in batches:
        for bucket, *rest in zip(*(batch.column(c).to_pylist() for c in ("bucket", "size", "names", "refs")), strict=True):
            if bucket != now and held:
                yield judged(held)
                held = []
            now = bucket
            held.append(tuple(rest))
    if held:
        yield judged(held)


def _collapse(frame: pd.DataFrame) -> pd.DataFrame:
    """Rows with the same (h, e) within one task: all are settled repeats; one stays to
    stand for them, the others get a group of their own."""
    same = frame.duplicated(["h", "e"], keep=False)
    later = frame.duplicated(["h", "e"])
    frame["times"] = np.where(same, 2, 1)
    own = A.signed(A.mix(frame["doc"].to_numpy(np.int64).view(U) * A.GOLD ^ frame["at"].to_numpy(np.int64).view(U)))
    frame["h"] = np.where(later, own, frame["h"])
    return frame


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each listed sample: its position and windows, the name of its gram, and that of its neighbourhood."""
    for batch in batches:
        ids = batch.column("row_id").to_numpy()
        listed = batch.column("numbers")
        bounds = listed.offsets.to_numpy()
        flat = listed.flatten().to_numpy()
        parts = []
        for i, j, buf, offs, lo, hi in _pieces(batch):
            a, b = bounds[i] - bounds[0], bounds[j] - bounds[0]
            row = np.repeat(np.arange(j - i), np.diff(bounds[i : j + 1]))
            at = position(flat[a:b]) + offs[row]
            mine = (at >= lo) & (at < hi)
            row, at = row[mine], at[mine]
            if not len(row):
                continue
            first, last = np.maximum(offs[row], at - REACH + 1), np.minimum(at, offs[row + 1] - SPAN)
            spans = A.SpanHash(buf)
            around = A.mix(spans(first, last + SPAN) ^ A.mix(((at - first) * 1000 + (last - first)).astype(U) * A.GOLD))
            # position, windows before the sample: first and last
            parts.append((ids[i + row], (at - offs[row]) << 16 | (at - first) << 8 | (at - last), A.signed(spans(at, at + GRAM)), A.signed(around)))
        if parts:
            doc, at, h, e = (np.concatenate(c) for c in zip(*parts, strict=True))
            yield pa.RecordBatch.from_pandas(_collapse(pd.DataFrame({"doc": doc, "at": at, "h": h, "e": e})), preserve_index=False)


AROUND = "doc long, at long, h long, around binary, e long, times long"


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each open sample its SPAN bytes from there on and the REACH - 1 before it, backwards; where its gram
    is hot, one row for each of its windows instead, by the hash of the window's bytes."""
    for batch in batches:
        buf, offs = A.text_buffer(batch.column("text"))
        listed = batch.column("marks")
        n = np.diff(listed.offsets.to_numpy())
        flat = listed.flatten()
        mark = flat.field("mark").to_numpy()
        wanted = mark & OPEN > 0
        if not wanted.any():
            continue
        at, h, hot = (mark >> 3)[wanted], flat.field("h").to_numpy()[wanted], (mark & IS_HOT > 0)[wanted]
        row = np.repeat(np.arange(len(n)), n)[wanted]
        doc = batch.column("row_id").to_numpy()[row]
        for s in range(0, len(at), CHUNK):
            here = slice(s, s + CHUNK)
            p, end, start = (at[here] >> 16) + offs[row[here]], offs[row[here] + 1], offs[row[here]]
            take = p[:, None] + np.arange(SPAN)
            right = np.where(take < end[:, None], buf[np.minimum(take, len(buf) - 1)], 0).astype(np.uint8)
            take = p[:, None] - 1 - np.arange(REACH - 1)
            left = np.where(take >= start[:, None], buf[np.maximum(take, 0)], 0).astype(np.uint8)
            both = np.hstack([right, left])
            cool = ~hot[here]
            if cool.any():
                texts = pa.FixedSizeBinaryArray.from_buffers(pa.binary(both.shape[1]), int(cool.sum()), [None, pa.py_buffer(both[cool].tobytes())])
                none = pa.nulls(int(cool.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(doc[here][cool]), pa.array(at[here][cool]), pa.array(h[here][cool]), texts.cast(pa.binary()), none, none], ["doc", "at", "h", "around", "e", "times"])
            if not cool.all():
                yield _windows(doc[here][~cool], at[here][~cool], both[~cool])


def names_of(symbols: np.ndarray) -> np.ndarray:
    """Ranks of the rows of a table of symbols: sorts triples, names them, and recurses on the names."""
    m, k = symbols.shape
    if k == 1:
        return np.unique(symbols[:, 0], return_inverse=True)[1]
    if k % 3:
        symbols = np.hstack([symbols, np.zeros((m, 3 - k % 3), symbols.dtype)])
    t = symbols.reshape(-1, 3)
    order = np.lexsort((t[:, 2], t[:, 1], t[:, 0]))
    sorted_ = t[order]
    rank = np.empty(len(t), np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], (sorted_[1:] != sorted_[:-1]).any(1))))
    return names_of(rank.reshape(m, -1))


def _classes(texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order of texts (rows of bytes) and the common prefix of each with the one before."""
    m, width = texts.shape
    padded = np.zeros((m, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = texts
    order = np.argsort(names_of(padded.view(">u8").astype(U)), kind="stable")
    s = texts[order]
    differ = s[1:] != s[:-1]
    common = np.where(differ.any(1), differ.argmax(1), width)
    return order, np.concatenate(([0], common))


def repeats(right: np.ndarray, left: np.ndarray, last: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, and first and last offset before its sample, of each run of repeated windows.

    right: SPAN bytes from each sample; left: bytes before it, backwards; the windows
    that start first..last bytes before the sample are its own."""
    m = len(right)
    ro, rc = _classes(right)
    lo, lc = _classes(left)
    found = np.zeros((m, REACH), bool)
    a, b = np.empty(m, np.int64), np.empty(m, np.int64)
    for l in range(REACH):
        own = np.flatnonzero((first <= l) & (l <= last))
        if len(own) < 2:
            continue
        a[ro] = np.cumsum(rc < SPAN - l)
        b[lo] = np.cumsum(lc < l)
        key = a[own] * (m + 1) + b[own]
        order = np.argsort(key, kind="stable")
        k = key[order]
        same = k[1:] == k[:-1]
        found[own[order], l] = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, begin = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1] - 1
    return row, begin, end


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by h; a chunk is closed between two values of h."""

    def flush(tables):
        t = pa.Table.from_batches(tables).combine_chunks()
        each = t["around"].is_null().to_numpy()
        doc, at = t["doc"].to_numpy(), t["at"].to_numpy()
        out = []
        if not each.all():
            around = np.frombuffer(b"".join(x for x in t["around"].to_pylist() if x is not None), np.uint8).reshape(int((~each).sum()), -1)
            mine, place = doc[~each], at[~each]
            row, begin, end = repeats(around[:, :SPAN], around[:, SPAN:], place >> 8 & 255, place & 255)
            out.append((mine[row], (place[row] >> 16) - end, (place[row] >> 16) - begin))
        if each.any():  # windows of hot grams: those that are there more than once
            frame = pd.DataFrame({c: t[c].to_numpy()[each] for c in ("h", "e", "times")})
            again = (frame.groupby(["h", "e"])["times"].transform("sum") > 1).to_numpy()
            out.append((doc[each][again], at[each][again], at[each][again]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["doc", "lo", "hi"])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        h = batch.column("h").to_numpy()
        cutoff = 0
        if size + len(h) >= CHUNK:
            change = np.flatnonzero(h[1:] != h[:-1]) + 1
            if held and held[-1].column("h")[-1].as_py() != h[0]:
                change = np.append(0, change)
            if len(change):
                cutoff = int(change[-1])
                if cutoff:
                    held.append(batch.slice(0, cutoff))
                yield flush(held)
                held, size = [], 0
        held.append(batch.slice(cutoff))
        size += len(h) - cutoff
    if size:
        yield flush(held)


def _windows(doc: np.ndarray, at: np.ndarray, around: np.ndarray) -> pa.RecordBatch:
    """One row for each window of a hot gram, by the hash of its bytes."""
    line = np.hstack([around[:, SPAN:][:, ::-1], around[:, :SPAN]])
    width = line.shape[1]
    spans = A.SpanHash(line.ravel())
    first, last = at & 255, at >> 8 & 255
    n = last - first + 1
    row = np.repeat(np.arange(len(at)), n)
    l = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[row]
    start = row * width + REACH - 1 - l
    h = spans(start, start + SPAN)
    second = A.mix(spans(start, start + SPAN // 2) * A.GOLD + spans(start + SPAN // 4, start + SPAN))
    frame = _collapse(pd.DataFrame({"doc": doc[row], "at": (at[row] >> 16) - l, "h": A.signed(h), "e": A.signed(second)}))
    none = pa.nulls(len(frame), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(frame["doc"].to_numpy()), pa.array(frame["at"].to_numpy()), pa.array(frame["h"].to_numpy()), none, pa.array(frame["e"].to_numpy()), pa.array(frame["times"].to_numpy(np.int64))], ["doc", "at", "h", "around", "e", "times"])


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Takes settled windows (marks) and repeats (runs) out of the texts."""
    for batch in batches:
        buf, offs = A.text_buffer(batch.column("text"))
        raw = memoryview(np.ascontiguousarray(buf))
        marks, runs = batch.column("marks"), batch.column("runs")
        flat = marks.flatten()
        mark = flat.field("mark").to_numpy()
        on, at = mark & SETTLED > 0, mark >> 3
        a, b = marks.offsets.to_numpy() - marks.offsets[0].as_py(), runs.offsets.to_numpy() - runs.offsets[0].as_py()
        row = np.concatenate([np.repeat(np.arange(batch.num_rows), np.diff(a))[on], np.repeat(np.arange(batch.num_rows), np.diff(b))])
        found = runs.flatten()
        lo_all = np.concatenate([((at >> 16) - (at >> 8 & 255))[on], found.field("lo").to_numpy()])
        hi_all = np.concatenate([((at >> 16) - (at & 255))[on], found.field("hi").to_numpy()])
        order = np.lexsort((lo_all, row))
        lo_all, hi_all = lo_all[order], hi_all[order]
        bounds = np.searchsorted(row[order], np.arange(batch.num_rows + 1))
        cols: tuple[list, ...] = ([], [], [], [])
        for k in range(batch.num_rows):
            text = raw[int(offs[k]) : int(offs[k + 1])]
            lo, hi = lo_all[bounds[k] : bounds[k + 1]], hi_all[bounds[k] : bounds[k + 1]]
            removed = spans = 0
            digest = hashlib.sha256()
            if len(lo):
                end = np.maximum.accumulate(hi + SPAN)
                new = np.flatnonzero(np.concatenate(([True], lo[1:] > end[:-1])))
                starts, ends = lo[new], end[np.append(new[1:], len(lo)) - 1]
                removed, spans, p = int((ends - starts).sum()), len(starts), 0
                for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                    digest.update(text[p:s])
                    p = e
                digest.update(text[p:])
            else:
                digest.update(text)
            for c, x in zip(cols, (len(text), removed, spans, digest.hexdigest()), strict=True):
                c.append(x)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def marks_of(text: DataFrame, buckets: int) -> DataFrame:
    """(doc, marks): by row_id, the samples of text(row_id, text, doc_id) that are settled or open, as (position and flags, gram)."""
    named = text.select("row_id", "text").mapInArrow(_name(buckets), REFS)
    lives = named.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_survivors, "row_id long, number long")
    numbers = lives.groupBy("row_id").agg(F.collect_set("number").alias("numbers")).withColumnRenamed("row_id", "doc").hint("merge")
    # a merge join gives rows in the order of their ids, so that tasks that run again see the same batches
    found = text.join(numbers, text.row_id == numbers.doc).select(*text.columns, "numbers").mapInArrow(_place, "doc long, at long, h long, e long, times long")
    by_gram = Window.partitionBy("h")
    each = Window.partitionBy("h", "e")
    found = found.repartition("h").withColumns({"least": F.min("e").over(by_gram), "most": F.max("e").over(by_gram), "near": F.count("*").over(by_gram), "times": F.sum("times").over(each), "nth": F.row_number().over(each.orderBy("doc", "at"))})
    found = found.withColumns({"open": F.expr("least <> most and nth = 1"), "settled": F.expr("times > 1")}).where("open or settled")
    mark = F.expr(f"shiftleft(at, 3) + if(open, {OPEN}, 0) + if(settled, {SETTLED}, 0) + if(near > {HOT}, {IS_HOT}, 0)")
    return found.groupBy("doc").agg(F.collect_list(F.struct(mark.alias("mark"), F.when(F.col("open"), F.col("h")).otherwise(0).alias("h"))).alias("marks"))


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs(doc_id, text).

    All joins take the same rows and columns of the texts, so that one exchange of them serves all."""
    arrow_rows(docs.sparkSession)
    rows = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    text = rows.select("row_id", "text", "doc_id").where("row_id is not null")
    marks = marks_of(text, max(16, size * len(COVER) // PERIOD // BUCKET)).hint("shuffle_hash")
    around = text.join(marks, text.row_id == marks.doc).select(*text.columns, "marks").mapInArrow(_open, AROUND)
    repeated = around.repartition("h").sortWithinPartitions("h").mapInArrow(_resolve, "doc long, lo long, hi long")
    runs = repeated.groupBy(F.col("doc").alias("of")).agg(F.collect_list(F.struct("lo", "hi")).alias("runs")).hint("shuffle_hash")
    joined = text.join(marks, text.row_id == marks.doc, "left").join(runs, text.row_id == runs.of, "left")
    none = {c: F.array().cast(df.schema[c].dataType) for c, df in (("marks", marks), ("runs", runs))}
    joined = joined.select(*text.columns, *(F.coalesce(c, x).alias(c) for c, x in none.items()))
    return joined.mapInArrow(_strip, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
