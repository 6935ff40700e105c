"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling.

A repeated run is a sequence of whole lines that holds at least `min_words` words and
occurs more than once; all copies but the first, by (doc_id, line), are deleted.

1. Every line gets an ID (128 bits of hashes of its bytes); each position also gets m, the least
   number of lines from there that hold min_words words (an empty line counts as one).
   Lines that occur once lie in no repeated run and leave at once.
2. Prefix doubling from PACKED lines on: suffixes are sorted by their first PACKED line IDs, later by
   pairs of ranks at half the depth, until no suffix is tied, however many lines a repeat has.  A
   rank is the number of suffixes that sort before.  What is alone with its rank, or equal to the
   others of it to its end, has its final place and leaves.  The end of a text sorts first, then
   lines that occur once, by place, then the others, by ID.
3. The suffix array has these places; suffixes equal to their ends follow each other by (doc, line).
   The LCP array has the lines that each suffix shares with the one before it: from the IDs in
   the first sort; where a later one told two apart, down the levels of step 2, whose lines are
   shared where the ranks at that depth are equal, and by the IDs of what remains.
4. LCP intervals: where suffixes follow each other with a common prefix of at least m, they all
   begin with the same m lines.  The maximal repeated runs are the unions of these.  In each
   interval all but the first position give up their m lines; where a copy overlaps the first
   one, only what goes beyond.

Hot lines and pairs: counts and ranks are taken with map-side combining and joined back, those of
keys with more than a thousandth of the rows by broadcast (at most 1000 keys), so that no task
gets all rows of one.  Sorts end with (doc, line), so that no large group is one task's; places in
them are counted by its tasks, and the driver sees a sum, or the first and last row, of each.
`min_words` is the operator's limit: shorter repeats stay by contract.

Null texts stay null and empty ones empty; neither has lines.  A line is what stands between
line feeds.  Repeated rows are copies like others, the first in doc_id order is kept; rows
with the same doc_id are told apart by a number.  An empty table gives an empty result.
`line_dedup` carries all other columns, whatever their names, but for ones called n_lines or
n_removed in any case, which it replaces; texts are whole, however long.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import takewhile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from . import _arrays as A
from ._tables import arrow_rows, cut, drop, numbered, spread_join

U = np.uint64
FEED = np.ones(256, dtype=bool)
FEED[10] = False
#: Lines that the first sort looks at, and the bytes of a line's ID.
PACKED, SYMBOL = 16, 16
#: What follows the lines looked at: the end of the text, a line that occurs once, or others.
END, ONCE, MORE = 0, 1, 2


def lines_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of all lines of all non-empty rows, empty lines included."""
    feeds = np.flatnonzero(buf == 10)
    full = np.flatnonzero(np.diff(offs))
    start = np.sort(np.concatenate([offs[full], feeds + 1]))
    end = np.sort(np.concatenate([offs[full + 1], feeds]))
    # a feed at a row's very end starts a last, empty line there: its row is the feed's
    row = np.sort(np.concatenate([full, np.searchsorted(offs, feeds, "right") - 1]))
    return start, end, row


def _lines(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("row_id").to_numpy()
            for i, _, buf, offs in A.groups(*A.text_buffer(batch.column("text"))):
                if not len(buf):
                    continue
                start, end, row = lines_of(buf, offs)
                h, h2 = A.SpanHash(buf)(start, end), A.SpanHash(buf, A.OTHER)(start, end)
                word = A.words(buf, offs, A.SPACED)[0]
                words = np.maximum(1, np.searchsorted(word, end) - np.searchsorted(word, start))
                sums = np.concatenate(([0], np.cumsum(words)))
                last = np.searchsorted(sums, sums[:-1] + min_words)  # lines before `last` hold enough
                bounds = A.first_of_row(row, len(offs) - 1)
                here = np.arange(len(row))
                m = np.where(last <= bounds[row + 1], last - here, 0)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i + row]), pa.array(here - bounds[row]), pa.array(A.signed(h)), pa.array(A.signed(h2)), pa.array(m), pa.array(bounds[row + 1] - here)], ["doc", "line", "id", "id2", "m", "tail"])

    return run


def lines_table(docs: DataFrame, min_words: int) -> DataFrame:
    """All lines of docs(row_id, text): doc, line, id, id2, m, and tail, the lines from there to the end."""
    return cut(docs.select("row_id", "text").mapInArrow(_lines(min_words), "doc long, line long, id long, id2 long, m long, tail long"))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column("n").to_numpy()
        before = total + np.cumsum(n) - n
        total += int(n.sum())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(before)], [*batch.schema.names, "part", "before"])


def placed(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with `before`: the sum of n over all rows ahead in the order of keys, which are unique."""
    schema = StructType([*rows.schema.fields, StructField("part", IntegerType()), StructField("before", LongType())])
    rows = cut(rows.orderBy(*keys).mapInArrow(_sums, schema))
    shifts, total = [], 0
    for part, n in sorted(rows.groupBy("part").agg(F.sum("n")).collect()):
        shifts.append((part, total))
        total += n
    shifts = rows.sparkSession.createDataFrame(shifts, "part int, shift long")
    return rows.join(F.broadcast(shifts), "part").withColumn("before", F.expr("before + shift")).drop("part", "shift")


def _keys(packed: int):
    """Of lines that occur again, by (doc, line): up to `packed` line IDs from each, and what follows them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (batches := list(batches)):
            return
        table = pa.Table.from_batches(batches)
        doc, line, m, tail, *ids = (table[c].to_numpy() for c in ("doc", "line", "m", "tail", "id", "id2"))
        symbols = np.stack(ids, 1).astype(">i8")
        n = len(doc)
        # lines up to one that occurs once, or to the end
        last = np.flatnonzero(np.append((doc[1:] != doc[:-1]) | (line[1:] != line[:-1] + 1), True))
        length = last[np.searchsorted(last, np.arange(n))] + 1 - np.arange(n)
        kind = np.where(length > packed, MORE, np.where(length == tail, END, ONCE)).astype(np.int32)
        length = np.minimum(length, packed)
        for i in range(0, n, 1 << 14):
            own = slice(i, i + (1 << 14))
            offs = np.concatenate(([0], np.cumsum(length[own])))
            at = np.repeat(np.arange(i, i + len(offs) - 1) - offs[:-1], length[own]) + np.arange(offs[-1])
            key = pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer((offs * SYMBOL).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(symbols[at]))])
            yield pa.RecordBatch.from_arrays([*(pa.array(x[own]) for x in (doc, line, m, tail, kind)), key], ["doc", "line", "m", "tail", "kind", "key"])

    return run


def _shared(keys: pa.Array, at: np.ndarray) -> np.ndarray:
    """Leading line IDs that the keys at these places share with those before them."""
    _, offsets, data = keys.buffers()
    offs = np.frombuffer(offsets, np.int32)[keys.offset : keys.offset + len(keys) + 1].astype(np.int64)
    symbols = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]].view(np.uint64).reshape(-1, 2)
    offs = (offs - offs[0]) // SYMBOL
    most = np.minimum(offs[at] - offs[at - 1], offs[at + 1] - offs[at])
    out, left = np.zeros(len(at), np.int64), np.arange(len(at))
    while len(left := left[most[left] > out[left]]):
        left = left[(symbols[offs[at[left]] + out[left]] == symbols[offs[at[left] - 1] + out[left]]).all(1)]
        out[left] += 1
    return out


PAIR = ["doc1", "line1", "doc2", "line2"]
SORTED = ["doc", "line", "m", "tail", "rank", "lcp", *PAIR, "kind", "key"]
FOUND = "part int, idx long, old long, new long, tied boolean, edge int"


def _split(depth: int):
    """Rows sorted by (rank, kind, key, doc, line), with what a partition knows of their groups: the places in
    it where those of their rank (old) and of their rank, kind and key (new) begin, -1 if before it; whether
    neighbours are in one group; and the lcp, or the pair to find it by, of the group and the one before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (batches := list(batches)):
            return
        table = pa.Table.from_batches(batches).combine_chunks()
        part, n = TaskContext.get().partitionId(), table.num_rows
        doc, line, rank, lcp, kind = (table[c].to_numpy() for c in ("doc", "line", "rank", "lcp", "kind"))
        key = table["key"].chunk(0)
        other = np.zeros(n, bool)
        other[1:] = rank[1:] != rank[:-1]
        begins = other.copy()
        begins[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == ONCE) | pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
        here = np.arange(n)
        old, new = (np.maximum.accumulate(np.where(x, here, -1)) for x in (other, begins))
        same = ~begins
        same[0] = False
        tied = (kind == MORE) & (same | np.append(same[1:], False))
        # new groups within old ones
        cut_at = np.flatnonzero(begins & ~other)
        lcp = lcp.copy()
        lcp[cut_at] = depth if depth else _shared(key, cut_at)
        pairs = [table[c].chunk(0) for c in PAIR]
        if depth:
            both = (kind[cut_at] == MORE) & (kind[cut_at - 1] == MORE)
            hit = np.zeros(n, bool)
            hit[cut_at] = True
            known = np.zeros(n, bool)
            known[cut_at[~both]] = True
            ahead = np.maximum(here - 1, 0)
            pairs = [pc.if_else(pa.array(hit), pa.array(x, mask=known), p) for x, p in zip((doc, line, doc[ahead], line[ahead]), pairs, strict=True)]
        first = np.where(new < 0, here, new)
        edge = np.zeros(n, np.int32)
        edge[0], edge[-1] = 1, edge[-1] | 2
        if n == 1:
            edge[0] = 3
        columns = {c: table[c].chunk(0) for c in SORTED} | {"lcp": pa.array(lcp[first])} | {c: p.take(pa.array(first)) for c, p in zip(PAIR, pairs, strict=True)}
        columns |= {"part": pa.array(np.full(n, part, np.int32)), "idx": pa.array(here), "old": pa.array(old), "new": pa.array(new), "tied": pa.array(tied), "edge": pa.array(edge)}
        yield from pa.Table.from_pydict(columns).to_batches(max_chunksize=1 << 14)

    return run


def _seams(rows: list, depth: int) -> pa.Table:
    """What each partition has to add to what it knows, from the first and last rows of all."""
    by_part = defaultdict(dict)
    for r in rows:
        by_part[r.part] |= {x: r for x in (1, 2) if r.edge & x}
    out, base, last = [], 0, None
    for part, ends in sorted(by_part.items()):
        f, e = ends[1], ends[2]
        old = bool(last) and f.rank == last.rank
        new = old and f.kind == last.kind != ONCE and f.key == last.key
        seam = {"part": part, "base": base, "first_old": last_old if old else base, "first_new": last_new if new else base, "before": new, "after": False}
        if new:
            found = last_found
        elif not old:
            found = (f.lcp, *(f[c] for c in PAIR))
        elif not depth:
            both = zip(*([x[i : i + SYMBOL] for i in range(0, len(x), SYMBOL)] for x in (f.key, last.key)), strict=False)
            found = (sum(1 for _ in takewhile(lambda x: x[0] == x[1], both)), *[None] * 4)
        else:
            found = (depth, *((f.doc, f.line, last.doc, last.line) if f.kind == last.kind == MORE else [None] * 4))
        if new:
            out[-1]["after"] = True
        out.append(seam | dict(zip(("first_lcp", *(f"first_{c}" for c in PAIR)), found, strict=True)))
        last_old = seam["first_old"] if e.old < 0 else base + e.old
        last_new = seam["first_new"] if e.new < 0 else base + e.new
        last_found = found if e.new < 0 else (e.lcp, *(e[c] for c in PAIR))
        last, base = e, base + e.idx + 1
    longs = ["base", "first_old", "first_new", "first_lcp", *(f"first_{c}" for c in PAIR)]
    return pa.Table.from_pylist(out, pa.schema([("part", pa.int32()), *((c, pa.int64()) for c in longs), ("before", pa.bool_()), ("after", pa.bool_())]))


def split(rows: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """(all, tied) of rows SORTED, where suffixes of one rank share `depth` lines and differ by (key, kind).

    Those not open have their places `at`, and lcp with the place before (or what is known of it, and the
    pair of suffixes that has the same).  The open ones, tied, share a new rank; lcp is their first place's."""
    kinds = StructType([*rows.select(*SORTED).schema.fields, *StructType.fromDDL(FOUND).fields])
    found = cut(rows.select(*SORTED).orderBy("rank", "key", "kind", "doc", "line").mapInArrow(_split(depth), kinds))
    ends = found.where("edge > 0").select("part", "edge", "idx", "old", "new", "doc", "line", "rank", "kind", "key", "lcp", *PAIR).collect()
    seams = rows.sparkSession.createDataFrame(_seams(ends, depth))
    found = found.join(F.broadcast(seams), "part").selectExpr(
        "doc", "line", "m", "tail", "key", "rank", "base + idx place", "if(old < 0, first_old, base + old) o", "if(new < 0, first_new, base + new) n",
        f"kind = {MORE} and (tied or edge % 2 = 1 and before or edge > 1 and after) open", *(f"if(new < 0, first_{c}, {c}) {c}" for c in ("lcp", *PAIR)),
    )
    # what follows the first of its group without being open is equal to it to the end
    rest = (f"if(place > n and not open, null, {c}) {c}" for c in PAIR)
    found = found.selectExpr("doc", "line", "m", "tail", "rank + n - o rank", "rank + place - o at", "if(place > n and not open, tail, lcp) lcp", *rest, "open", "key")
    return found, cut(found.where("open").select("doc", "line", "m", "tail", "rank", "lcp", *PAIR))


def suffix_array(lines: DataFrame) -> DataFrame:
    """(at, doc, line, m, lcp): the suffixes that begin with a line that occurs again, their places, and
    how many lines each shares with the one before it; of a cut lines_table, which is dropped."""
    often = lines.groupBy("id", "id2").agg(F.count("*").alias("n")).where("n > 1")
    again = spread_join(lines, often, ["id", "id2"], "n").select("doc", "line", "m", "tail", "id", "id2")
    keys = again.repartition("doc").sortWithinPartitions("doc", "line").mapInArrow(_keys(PACKED), "doc long, line long, m long, tail long, kind int, key binary")
    found, tied = split(keys.selectExpr("*", "0L rank", "0L lcp", *(f"cast(null as long) {c}" for c in PAIR)), 0)
    drop(again)
    out = ["at", "doc", "line", "m", "lcp"]
    array, depth, levels = found.where("not open").select(*out), PACKED, [tied]
    if not tied.limit(1).count():
        return array
    # doubling needs no other texts than those with tied suffixes; some columns of a file may look
    # small enough to be broadcast when they are not, and so are merged
    known = cut(found.join(tied.select("doc").distinct(), "doc", "left_semi").select("doc", "line", "rank", "open", "key"))
    ranks, pairs = known.where("not open").select("doc", "line", "rank"), []
    while tied.limit(1).count():
        ahead = ranks.union(tied.select("doc", "line", "rank")).selectExpr("doc", f"line - {depth} line", "rank upper")
        rows = tied.join(ahead.hint("merge"), ["doc", "line"], "left").withColumn("kind", F.expr(f"case when tail <= {depth} then {END} when upper is null then {ONCE} else {MORE} end"))
        found, tied = split(rows.withColumn("key", F.expr(f"if(kind = {MORE}, upper, kind - {MORE})")), depth)
        settled = found.where("not open")
        array = array.union(settled.where("doc1 is null").select(*out))
        pairs.append(settled.where("doc1 is not null").select(*out, *PAIR))
        ranks = ranks.union(settled.select("doc", "line", "rank"))
        levels.append(tied)
        depth *= 2
    # pairs differ within what the last step looked at, so that each level below adds its lines at most once
    more = reduce(DataFrame.union, pairs)
    for k, level in reversed(list(enumerate(levels[:-2]))):
        sides = (level.selectExpr(f"doc doc{i}", f"line next{i}", f"rank rank{i}").hint("merge") for i in (1, 2))
        more = reduce(lambda x, y: x.join(y, [c for c in y.columns if c[:4] != "rank"], "left"), sides, more.selectExpr("*", "line1 + lcp next1", "line2 + lcp next2"))
        more = more.selectExpr("at", "doc", "line", "m", f"if(rank1 = rank2, lcp + {PACKED << k}, lcp) lcp", *PAIR)
    sides = (known.selectExpr(f"doc doc{i}", f"line next{i}", f"key key{i}").hint("merge") for i in (1, 2))
    more = reduce(lambda x, y: x.join(y, [c for c in y.columns if c[:3] != "key"], "left"), sides, more.selectExpr("*", "line1 + lcp next1", "line2 + lcp next2"))
    more = more.withColumn("most", F.expr(f"coalesce(least(length(key1), length(key2)) div {SYMBOL}, 0)").cast("int"))
    part = "substring({}, %d * (k - 1) + 1, %d)" % (SYMBOL, SYMBOL)
    differ = f"get(filter(sequence(1, most), k -> {part.format('key1')} <> {part.format('key2')}), 0)"
    more = cut(more.selectExpr("at", "doc", "line", "m", f"lcp + if(key1 is null or key2 is null or most = 0, 0, coalesce({differ} - 1, most)) lcp"))
    drop(reduce(DataFrame.union, [x.select("doc") for x in (known, *levels)]))
    return array.union(more)


def later_copies(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc, start, stop): line ranges to delete, by row_id, of docs(row_id, text)."""
    array = suffix_array(lines_table(docs, min_words))
    # an interval begins where fewer than m lines are shared; whatever stands within one has its m
    runs = placed(array.where("m > 0").selectExpr("at", "doc", "line", "m", "if(lcp < m, 1L, 0L) n"), "at").selectExpr("before + n interval", "doc", "line", "m")
    drop(array)
    first = runs.groupBy("interval").agg(F.min(F.struct("doc", "line")).alias("first"), F.count("*").alias("n")).where("n > 1")
    found = spread_join(runs, first, ["interval"], "n").where("doc <> first.doc or line <> first.line").selectExpr("doc", "if(doc = first.doc, greatest(line, first.line + m), line) start", "line + m stop")
    found = cut(found.where("start < stop"))
    drop(runs)
    return found


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, starts, stops = (batch.column(c).to_pylist() for c in ("text", "starts", "stops"))
        gone, total = [], []
        for i, (text, lo, hi) in enumerate(zip(texts, starts, stops, strict=True)):
            lines = text.split("\n") if text else []
            total.append(len(lines))
            if not lo:
                gone.append(0)
                continue
            keep = np.ones(len(lines), bool)
            for a, b in zip(lo, hi, strict=True):
                keep[a:b] = False
            texts[i] = "\n".join([x for x, k in zip(lines, keep.tolist(), strict=True) if k])
            gone.append(int(len(lines) - keep.sum()))
        yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], ["rest", "text", "n_lines", "n_removed"])


def line_dedup(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """docs with later copies cut out of text, and n_lines, n_removed long (lines before, lines deleted)."""
    arrow_rows(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    # all other columns go through as one, so that their names meet none of the operator's
    others = [c for c in kept if c != "text"]
    rest = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)))
    rows = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), rest.alias("rest")))
    gone = later_copies(rows, min_words).groupBy("doc").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops")).hint("shuffle_hash")
    rows = rows.join(gone, rows.row_id == gone.doc, "left").select("rest", "text", "starts", "stops")
    schema = rows.select("rest", "text").schema.add("n_lines", "long").add("n_removed", "long")
    out = rows.mapInArrow(_apply, schema)
    named = {c: F.col(f"rest.c{i}") for i, c in enumerate(others)} | {"text": F.col("text")}
    return out.select(*(named[c].alias(c) for c in kept), "n_lines", "n_removed")
