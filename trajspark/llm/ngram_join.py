"""N-gram Jaccard join: size-banded tiles with bitmap signatures, exact to the last link.

A document's set holds the distinct n-word shingles of its whole text (64-bit hashes).
Two sets link when `den * intersection >= num * union`.  Steps:

1. Equal sets share one node; very common shingles are counted over all rows.
2. Candidates, without loss: linked sets of a size tile differ in at most d shingles.
   The hash range is cut into more than d segments, so one segment at least is equal
   in both; sets meet at the hash of an equal segment.  Common shingles are left out
   where enough others remain (leaving out the same ones on both sides can only lower
   the difference), so that frequent passages bring no strangers together.
3. Pairs that met are sifted by the bit counts of hashed bitmaps, which bound the overlap
   from above (at keys where very many met, each is tied to one of them instead, unsifted).
   Sets that stay tied, directly or through others, form a cluster.  Clusters are cut by
   size band and by blocks of bounded size into tiles.  In a first pass the tiles hold
   signatures only: what bit counts can't part stays together in smaller clusters.  In a
   second, bit counts of wider bitmaps bound each overlap and sorted arrays settle the
   rest.  Pairs that a tile has already connected are skipped in both.
4. Components of the links.

Skew: equal sets collapse first; a key where many meet inside one task leaves that task
as one row and ties of its own; hot clusters are dealt over many tiles.

Nulls and empty texts have no shingles and link with nothing; a text of fewer than n
words is one shingle; repeated doc_ids count as one node's rows and are returned as
often as given.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _arrays as A
from ._tables import arrow_rows, components, cut, drop

U = np.uint64
PLACE = A.mix(np.arange(101, 165, dtype=np.uint64) * A.GOLD) | U(1)
#: Shares of all rows from which a shingle counts as common; the list has at most
#: (mean set size / COMMON) entries, whatever the number of rows.
COMMON = 0.0005
#: A tile's side holds about so many sets and shingles at most (one set may be larger).
BLOCK_SETS, BLOCK_SHINGLES = 512, 1 << 19
#: The same for tiles of signatures, which take 1 to 2 bits a shingle instead of 64.
SIGN_SETS, SIGN_SHINGLES = 2048, 1 << 23
#: Sets at one key up to which every pair is looked at; of more, each is tied to one of them.
FEW = 48
#: Places of sets in tiles (about 40 bytes each) up to which they are broadcast; beyond, texts are joined by shuffle.
BROADCAST_PLACES = 500_000


def shingle_sets(buf: np.ndarray, offs: np.ndarray, n_words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    rows = len(offs) - 1
    low = A.LOWER[buf]
    start, end, row = A.words(low, offs, A.SPACED)
    if not len(start):
        return [np.zeros(0, U)] * rows
    w = A.SpanHash(low)(start, end)
    first = A.first_of_row(row, rows)
    m = max(0, len(w) - n_words + 1)
    v = np.zeros(m, U)
    for j in range(n_words):
        v += w[j : m + j] * PLACE[j]
    v = A.mix(v)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n_words:
            s = np.sort(v[a : b - n_words + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            s = A.mix((w[a:b] * PLACE[: b - a]).sum(dtype=U, keepdims=True) + np.array([b - a], U) * A.GOLD)
        else:
            s = np.zeros(0, U)
        out.append(s)
    return out


def _sets(batch: pa.RecordBatch, n_words: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    ids = batch.column("doc_id").to_pylist()
    for i, j, buf, offs in A.groups(*A.text_buffer(batch.column("text"))):
        yield ids[i:j], shingle_sets(buf, offs, n_words)


@lru_cache(maxsize=None)
def _edges(ratio: float, upto: int) -> list[int]:
    out = [1]
    while out[-1] <= upto:
        out.append(max(out[-1] + 1, int(out[-1] * ratio)))
    return out


@lru_cache(maxsize=65536)
def tiles(n: int, num: int, den: int, ratio: float) -> tuple[tuple[int, int, int, int], ...]:
    """The tiles of a set of n shingles: number, d, segments beyond d, segments."""
    edges = _edges(ratio, 1 << max(4, n.bit_length()))
    own = next(i for i in range(len(edges)) if edges[i + 1] > n) if n < 64 else int(np.searchsorted(edges, n, "right")) - 1
    out = []
    for t in range(own, -1, -1):
        a = edges[t + 1] - 1
        b = a * den // num
        if n > b:
            break
        if d := (a + b) * (den - num) // (den + num):
            k, more = d + 1, 0
            for _ in range(30):
                empty = k * math.exp(-2)
                more = math.ceil(empty + 4 * math.sqrt(empty))
                k = d + 1 + more
            out.append((t, d, more, k))
    return tuple(out)


@lru_cache(maxsize=4096)
def _bounds(k: int) -> np.ndarray:
    return np.array([(j << 64) // k for j in range(k)], dtype=U)


def meeting_keys(s: np.ndarray, common: np.ndarray, num: int, den: int, ratio: float) -> np.ndarray:
    """Keys of which linked, unequal sets share at least one."""
    out, rare = [], None
    for tile, d, more, k in tiles(len(s), num, den, ratio):
        if rare is None:
            if len(common):
                at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                rare = s[common[at] != s]
            else:
                rare = s
        least = 2 * k
        for kind, x in (("rare", rare), ("all", s)):
            if len(x) < least if kind == "rare" else len(rare) >= least + d:
                continue
            at = np.append(np.searchsorted(x, _bounds(k)), len(x))
            sums = np.zeros(len(x) + 1, U)
            np.cumsum(A.mix(x ^ A.GOLD), out=sums[1:])
            there = at[1:] > at[:-1]
            place = np.arange(k, dtype=U) * PLACE[0] + np.array([2 * tile + (kind == "all")], U) * PLACE[1]
            out.append(A.mix(sums[at[1:]] - sums[at[:-1]] + place)[there])
            gaps = np.flatnonzero(~there)
            if len(gaps) > more:  # then the least of the equal segments may be an empty one
                out.append(A.mix(place[gaps[: len(gaps) - more]] ^ PLACE[2]))
    return np.concatenate(out) if out else np.zeros(0, U)


def signature(s: np.ndarray) -> np.ndarray:
    """A hashed bitmap of 1 to 2 bits for each shingle; folding its halves gives the one of half as many bits."""
    bits = 32 << max(1, (max(1, len(s)) - 1).bit_length() - 5)
    out = np.zeros(bits, bool)
    out[(s & U(bits - 1)).astype(np.int64)] = True
    return np.packbits(out).view(U)


def may_link(a: np.ndarray, b: np.ndarray, n: int, m: int, num: int, den: int) -> bool:
    """Whether the bit counts of two signatures leave room for enough overlap of sets of n and m."""
    while len(a) > len(b):
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    most = min(n - int(np.bitwise_count(a & ~b).sum()), m - int(np.bitwise_count(b & ~a).sum()))
    return den * most >= num * (n + m - most)


def _sift(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, n, m, a, b = (batch.column(c).to_pylist() for c in ("u", "v", "n", "m", "a", "b"))
            keep = [may_link(np.frombuffer(a[i], U), np.frombuffer(b[i], U), n[i], m[i], num, den) for i in range(len(u))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()).filter(pa.array(keep, pa.bool_())) for c in (u, v)], ["u", "v"])

    return run


def _survey(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: dict[str, list] = {"doc_id": [], "n": [], "k1": [], "k2": []}
            seen, signs = [], []
            for ids, sets in _sets(batch, n_words):
                cols["doc_id"] += ids
                cols["n"] += [len(s) for s in sets]
                m = [A.mix(s ^ PLACE[3]) for s in sets]
                cols["k1"].append(np.array([x.sum(dtype=U) + U(len(x)) for x in m], U))
                cols["k2"].append(np.array([A.mix(x ^ PLACE[4]).sum(dtype=U) for x in m], U))
                signs += [signature(x).tobytes() for x in sets]
                seen += sets
            n = len(cols["doc_id"])
            yield pa.RecordBatch.from_arrays([pa.array(cols["doc_id"], pa.int64()), pa.array(cols["n"], pa.int64()), *(pa.array(A.signed(A.mix(np.concatenate(cols[k]))) if n else [], pa.int64()) for k in ("k1", "k2")), pa.nulls(n, pa.int64()), pa.array(signs, pa.binary())], ["doc_id", "n", "k1", "k2", "times", "signature"])
            value, times = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, U), np.zeros(0, int))
            value, times = value[times > 2], times[times > 2]
            if len(value):
                none = pa.nulls(len(value), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.array(A.signed(value)), none, pa.array(times, pa.int64()), pa.nulls(len(value), pa.binary())], ["doc_id", "n", "k1", "k2", "times", "signature"])

    return run


def _meet(n_words: int, num: int, den: int, ratio: float, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.frombuffer(shared.value, U)
        for batch in batches:
            keys, nodes, had = [], [], set()
            for _, sets in _sets(batch, n_words):
                for s in sets:
                    node = int(A.mix((A.mix(s ^ PLACE[3]).sum(dtype=U, keepdims=True) + U(len(s))))[0])
                    if len(s) and node not in had:
                        had.add(node)
                        keys.append(k := meeting_keys(s, common, num, den, ratio))
                        nodes.append(np.full(len(k), node, U).view(np.int64))
            if not keys:
                continue
            key, node = np.concatenate(keys), np.concatenate(nodes)
            order = np.lexsort((node, key))
            key, node = key[order], node[order]
            head = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
            group = np.cumsum(head) - 1
            hot = np.bincount(group, minlength=1)[group] > FEW if len(key) else head
            centre = node[np.flatnonzero(head)][group] if len(key) else node
            met = hot & ~head & (node != centre)
            pairs = np.unique(np.stack([centre[met], node[met]]), axis=1) if met.any() else np.zeros((2, 0), np.int64)
            own = A.signed(A.mix(pairs[0].view(U) * PLACE[5] + pairs[1].view(U) * PLACE[6]))
            out = np.flatnonzero(head | ~hot)
            out = out[np.argsort(node[out], kind="stable")]  # a node's rows together: they compress
            flags = np.concatenate([hot[out], np.ones(2 * len(own), bool)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([A.signed(key[out]), own, own])), pa.array(np.concatenate([node[out], pairs[0], pairs[1]])), pa.array(flags)], ["key", "node", "hot"])

    return run


def _arrays_of(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for _, group in _sets(batch, n_words) for s in group]
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sets, pa.binary())], [*keep, "shingles"])

    return run


def _sides(pdf):
    """The two sides of a tile, and whether they are one."""
    t = pdf.iloc[0]
    sides = [pdf[(pdf["band"] == t[f"band{x}"]) & (pdf["sub"] == t[f"sub{x}"])] for x in "12"]
    return sides, (t.band1, t.sub1) == (t.band2, t.sub2)


class _Forest:
    """Which ids a tile has connected so far."""

    def __init__(self, ids):
        self.parent = {x: x for x in ids}

    def root(self, x):
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x


def _by_width(side):
    """Signatures of one side as matrices, by their own width: {words: (ids, sizes, matrix)}."""
    words = (side.signature.map(len) // 8).to_numpy()
    out = {}
    for w in sorted(set(words.tolist())):
        part = side[words == w]
        out[w] = part.doc_id.tolist(), part.n.to_numpy(np.int64), np.frombuffer(b"".join(part.signature), U).reshape(len(part), w)
    return out


def _folded(m: np.ndarray, words: int) -> np.ndarray:
    while m.shape[1] > words:
        m = m[:, : m.shape[1] // 2] | m[:, m.shape[1] // 2 :]
    return m


def _sign_tile(num: int, den: int):
    """Connects what bit counts of signatures can't part, as a forest of links."""

    def run(pdf):
        import pandas as pd

        sides, same = _sides(pdf)
        left = _by_width(sides[0])
        right = left if same else _by_width(sides[1])
        forest, links = _Forest(pdf.doc_id.tolist()), []
        for w, (ids_a, n_a, a) in left.items():
            for v, (ids_b, n_b, b) in right.items():
                if same and v < w:
                    continue
                x, y = _folded(a, min(w, v)), _folded(b, min(w, v))
                for i in range(len(ids_a)):
                    lo = i + 1 if same and v == w else 0
                    only_a = np.bitwise_count(x[i] & ~y[lo:]).sum(1).astype(np.int64)
                    only_b = np.bitwise_count(y[lo:] & ~x[i]).sum(1).astype(np.int64)
                    most = np.minimum(n_a[i] - only_a, n_b[lo:] - only_b)
                    for j in (np.flatnonzero(den * most >= num * (n_a[i] + n_b[lo:] - most)) + lo).tolist():
                        p, q = forest.root(ids_a[i]), forest.root(ids_b[j])
                        if p != q:
                            forest.parent[max(p, q)] = min(p, q)
                            links.append((ids_a[i], ids_b[j]))
        return pd.DataFrame(links, columns=["u", "v"], dtype="int64")

    return run


def _tile(num: int, den: int):
    def run(pdf):
        import pandas as pd

        sides, same = _sides(pdf)
        (ids_a, a), (ids_b, b) = (([int(x) for x in s.doc_id], [np.frombuffer(x, U) for x in s.shingles]) for s in sides)
        bits = 256
        while bits < 4 * max([1, *map(len, a), *map(len, b)]) and bits < 1 << 14:
            bits *= 2

        def signatures(sets):
            out = np.zeros((len(sets), bits), bool)
            for i, s in enumerate(sets):
                out[i, (s & U(bits - 1)).astype(np.int64)] = True
            return np.packbits(out, axis=1).view(U)

        sa, nb = signatures(a), np.array([len(s) for s in b], np.int64)
        sb = sa if same else signatures(b)
        forest, links = _Forest((*ids_a, *ids_b)), []
        for i, s in enumerate(a):
            lo = i + 1 if same else 0
            if lo >= len(b):
                break
            only_a = np.bitwise_count(sa[i] & ~sb[lo:]).sum(1).astype(np.int64)
            only_b = np.bitwise_count(sb[lo:] & ~sa[i]).sum(1).astype(np.int64)
            most = np.minimum(len(s) - only_a, nb[lo:] - only_b)
            for j in (np.flatnonzero(den * most >= num * (len(s) + nb[lo:] - most)) + lo).tolist():
                x, y = forest.root(ids_a[i]), forest.root(ids_b[j])
                if x == y:
                    continue
                o = b[j]
                both = int((o[np.minimum(np.searchsorted(o, s), len(o) - 1)] == s).sum())
                if den * both >= num * (len(s) + len(o) - both):
                    forest.parent[max(x, y)] = min(x, y)
                    links.append((ids_a[i], ids_b[j]))
        return pd.DataFrame(links, columns=["u", "v"], dtype="int64")

    return run


TILE_KEY = ("cluster", "band1", "sub1", "band2", "sub2")


def _dealt(member: DataFrame, sets: int, shingles: int) -> DataFrame:
    """member(doc_id, n, cluster, band) with the tiles in which each row takes part, as array t.

    A cluster's band has as many blocks as keep each within the bounds; a row meets every
    block of its own band and of the bands next to it, each pair of blocks in one tile."""
    size = cut(member.groupBy("cluster", "band").agg(F.greatest(F.ceil(F.count("*") / sets), F.ceil(F.sum("n") / shingles)).cast("int").alias("blocks")))
    near = size.join(size.selectExpr("cluster", "band - 1 band", "blocks above"), ["cluster", "band"], "left").join(size.selectExpr("cluster", "band + 1 band", "blocks below"), ["cluster", "band"], "left")
    tile = "struct(cast({} as int) band1, cast({} as int) sub1, cast({} as int) band2, cast({} as int) sub2)"
    own = f"transform(sequence(0, blocks - 1), t -> {tile.format('band', 'least(t, sub)', 'band', 'greatest(t, sub)')})"
    up = f"if(above is null, array(), transform(sequence(0, above - 1), t -> {tile.format('band', 'sub', 'band + 1', 't')}))"
    down = f"if(below is null, array(), transform(sequence(0, below - 1), t -> {tile.format('band - 1', 't', 'band', 'sub')}))"
    rows = member.join(near, ["cluster", "band"]).withColumn("sub", F.expr("cast(pmod(xxhash64(doc_id), blocks) as int)"))
    return rows.withColumn("t", F.expr(f"concat({own}, {up}, {down})")).drop("blocks", "above", "below")


def _by_tile(rows: DataFrame) -> DataFrame:
    """rows dealt over as many tasks as the session's shuffles have: a tile's cost is its pairs, not its
    bytes, so that tasks must not be put together by size."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *TILE_KEY).groupBy(*TILE_KEY)


def ngram_jaccard(docs: DataFrame, n_words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, rep_id) for every row of docs(doc_id, text).

    component_id is the least doc_id reachable by links, rep_id the least doc_id with an
    equal set.  A row with a null doc_id has null ids.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    ratio = 1.5
    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    survey = cut(text.mapInArrow(_survey(n_words), "doc_id long, n long, k1 long, k2 long, times long, signature binary"))
    rows = survey.where("times is null").select("doc_id", "n", "k1", "k2")
    total = rows.count()
    often = max(20, math.ceil(COMMON * total))
    listed = survey.where("times is not null").groupBy("k1").agg(F.sum("times").alias("t")).where(F.col("t") >= often).select("k1").toPandas()
    common = spark.sparkContext.broadcast(np.sort(listed["k1"].to_numpy(np.int64).view(U)).tobytes())

    met = text.mapInArrow(_meet(n_words, num, den, ratio, common), "key long, node long, hot boolean")
    at_key = Window.partitionBy("key")
    met = met.withColumns({"centre": F.min("node").over(at_key), "last": F.max("node").over(at_key), "many": F.count("*").over(at_key), "hot": F.max("hot").over(at_key)}).where("centre < last")
    met = cut(met.select("key", "node", "centre", F.expr(f"hot or many > {FEW}").alias("hot")))
    # a node meets many centres: it is tied to the least of them, and that to the others
    hooked = met.where("hot").select("node", "centre", F.min("centre").over(Window.partitionBy("node")).alias("u"))
    tied = hooked.selectExpr("u", "node v").distinct().union(hooked.selectExpr("u", "centre v").distinct())
    sets = survey.where("times is null and n > 0").groupBy("k1").agg(F.first("n").alias("n"), F.first("signature").alias("s"))
    sized = met.where("not hot").select("key", "node").join(sets.selectExpr("k1 node", "n"), "node")
    pairs = sized.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("n", "node"))).alias("x"))
    pairs = pairs.select(F.posexplode("x").alias("i", "a"), "x").select("a", F.explode(F.expr(f"filter(slice(x, i + 2, size(x)), b -> {den} * a.n >= {num} * b.n)")).alias("b"))
    pairs = pairs.selectExpr("a.node u", "b.node v", "a.n n", "b.n m").distinct()
    pairs = pairs.join(sets.selectExpr("k1 u", "s a"), "u").join(sets.selectExpr("k1 v", "s b"), "v")
    sifted = pairs.select("u", "v", "n", "m", "a", "b").mapInArrow(_sift(num, den), "u long, v long")
    clusters = components(tied.union(sifted))

    drop(met)

    reps = rows.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    width = math.log(den / num) * 1.01
    band = F.floor(F.log("n") / width).cast("int").alias("band")
    signed = sets.join(clusters.withColumnRenamed("node", "k1"), "k1").selectExpr("k1", "s signature", "comp cluster")
    member = cut(reps.join(signed, "k1").where("doc_id is not null").select("doc_id", "n", "cluster", band, "signature"))
    signs = _dealt(member, SIGN_SETS, SIGN_SHINGLES).select("doc_id", "n", "cluster", "band", "sub", "signature", F.explode("t").alias("t")).select("doc_id", "n", "cluster", "band", "sub", "signature", "t.*")
    clusters = components(_by_tile(signs).applyInPandas(_sign_tile(num, den), "u long, v long"))

    member = cut(member.select("doc_id", "n", "band").join(clusters.selectExpr("node doc_id", "comp cluster"), "doc_id"))
    dealt = cut(_dealt(member, BLOCK_SETS, BLOCK_SHINGLES).select("doc_id", "cluster", "band", "sub", "t"))
    few = (dealt.agg(F.sum(F.size("t") + 1)).first()[0] or 0) <= BROADCAST_PLACES
    tile = "array<struct<band1: int, sub1: int, band2: int, sub2: int>>"
    found = text.join(F.broadcast(dealt) if few else dealt.hint("shuffle_hash"), "doc_id").mapInArrow(_arrays_of(n_words), f"doc_id long, cluster long, band int, sub int, t {tile}, shingles binary")
    links = found.select("doc_id", "cluster", "band", "sub", "shingles", F.explode("t").alias("t")).select("doc_id", "cluster", "band", "sub", "shingles", "t.*")
    links = _by_tile(links).applyInPandas(_tile(num, den), "u long, v long")
    comp = components(links)

    named = reps.select("k1", "k2", F.col("doc_id").alias("rep_id")).join(comp.selectExpr("node rep_id", "comp"), "rep_id", "left")
    out = rows.join(named, ["k1", "k2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", F.when(F.col("n") > 0, F.col("rep_id")), "doc_id").alias("component_id"), F.coalesce(F.when(F.col("n") > 0, F.col("rep_id")), "doc_id").alias("rep_id"))
