"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The pieces and their scores are read from a public model file whose path is a parameter;
the driver builds the trie once and broadcasts it (its size is bounded by the vocabulary).
A unigram model's scores are log probabilities and serve as they are.  A BPE model's are minus
the ranks of its merges; log probabilities follow from these without any text (`log_scores`),
for tokenizers are not trained here.
Whitespace: a marker stands for each space and for the start of a non-empty text; decoding
turns markers back and drops the first.  A marker in the input counts as a space, as in the
model's own normalisation.  A character that no piece covers costs the least score less 10
and becomes its UTF-8 bytes' pieces.  The best path has the highest sum of scores; of equal
ones, the path whose last pieces are longest.

No piece has a marker after another character, so the best path of a text is the
concatenation of the best paths of its space-led chunks; those are solved together, one trie
step at a time for all, and remembered in a bounded cache.

Null and empty texts have no tokens and decode to ''.  Texts are whole whatever their length.
Repeated rows are encoded each; an empty table gives an empty result; other columns are
carried by `encode`, but for ones named like its results (in any case), and left out by `token_digests`.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ._tables import arrow_rows

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
CACHE = 100_000
WIDE, TOGETHER = 48, 16_384
_cache: dict[str, dict[str, bytes]] = {}


#: Offset of the Zipf-Mandelbrot law of merges, and the least share of a piece's count that later merges leave.
OFFSET, LEFT = 20, 0.05


def log_scores(ranks: dict[str, float]) -> dict[str, float]:
    """Log probabilities of BPE pieces, from the ranks of their merges alone.

    The merge of rank k is taken to join 1 / (k + OFFSET) pairs (Zipf-Mandelbrot).  Each later
    merge takes its two parts from their counts; what stays, LEFT of the count at least, is how
    often a piece stands by itself.  A single character occurs as often as merges use it, and a little more."""
    order = sorted((p for p in ranks if len(p) > 1), key=lambda p: (ranks[p], p))
    place = {p: k for k, p in enumerate(order)}
    merged = {p: 1 / (k + 1 + OFFSET) for p, k in place.items()}
    used: dict[str, float] = dict.fromkeys(ranks, 0.0)
    for p in order:
        # the parts that were there first
        parts = [(max(place.get(x, -1) for x in (p[:k], p[k:])), k) for k in range(1, len(p)) if p[:k] in ranks and p[k:] in ranks]
        if parts and (best := min(parts))[0] < place[p]:
            used[p[: best[1]]] += merged[p]
            used[p[best[1] :]] += merged[p]
    rare = 1 / (len(order) + 1 + OFFSET)
    count = {p: merged[p] if p in merged else used[p] * (1 + LEFT) + rare for p in ranks}
    left = {p: max(n - used[p], n * LEFT) for p, n in count.items()}
    total = sum(left.values())
    return {p: math.log(n / total) for p, n in left.items()}


class DoubleArray:
    """A trie over bytes: from node s by byte c to base[s] + c, if check there is s."""

    def __init__(self, entries: dict[bytes, int]):
        keys = sorted(entries)
        size = 1 << 12
        self.base, self.check, self.value = (np.full(size, x, np.int64) for x in (0, -1, -1))
        self.check[0] = 0
        free, todo = 1, [(0, 0, len(keys), 0)] if keys else []
        while todo:
            node, lo, hi, depth = todo.pop()
            if len(keys[lo]) == depth:
                self.value[node] = entries[keys[lo]]
                lo += 1
            if lo == hi:
                continue
            starts = [lo] + [i for i in range(lo + 1, hi) if keys[i][depth] != keys[i - 1][depth]]
            codes = np.array([keys[i][depth] for i in starts])
            at = free
            while True:
                self._room(at + 1024)
                places = np.flatnonzero(self.check[at : at + 512] < 0) + at
                if at == free and len(places) < 40:  # nearly full: left behind for good
                    free += 512
                b = places - codes[0]
                b = b[b > 0]
                fits = (self.check[b[:, None] + codes] < 0).all(1)
                if fits.any():
                    b = int(b[fits.argmax()])
                    break
                at += 512
            self.base[node] = b
            self.check[b + codes] = node
            todo += [(b + int(c), i, j, depth + 1) for c, i, j in zip(codes, starts, [*starts[1:], hi], strict=True)]

    def _room(self, n: int) -> None:
        while n >= len(self.check):
            for name, x in (("base", 0), ("check", -1), ("value", -1)):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.full(len(old), x, np.int64)]))


class Codec:
    """Pieces, scores and trie of one model."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], special: set[int]):
        """byte_ids: the pieces of bytes 0..255, empty if the model has none; special: never matched in text."""
        plain = {p.encode(): i for i, p in enumerate(pieces) if i not in special and i not in set(byte_ids) and p}
        self.trie = DoubleArray(plain)
        self.scores = np.array(scores, float)
        self.unknown = min((scores[i] for i in plain.values()), default=0.0) - 10
        self.bytes_of = np.array(byte_ids, np.int64)
        self.text_of = [b"" if i in special else p.encode() for i, p in enumerate(pieces)]
        for b, i in enumerate(byte_ids):
            self.text_of[i] = bytes([b])
        self.unk = 0
        inner = any(MARK in p.lstrip(MARK) for p in pieces)
        line = any("\n" in p for p in pieces)
        self.chunks = re.compile(r"(?s).+") if inner else re.compile(f"{MARK}*[^{MARK}]+|{MARK}+") if line else re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
        self.key = hashlib.sha256(repr((pieces, scores, byte_ids)).encode()).hexdigest()

    @staticmethod
    def load(path: str = MODEL) -> Codec:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        by_byte = sorted(((int(sp.id_to_piece(i)[1:-1], 16), i) for i in ids if sp.is_byte(i)))
        special = {i for i in ids if sp.is_unknown(i) or sp.is_control(i)}
        pieces, scores = [sp.id_to_piece(i) for i in ids], [sp.get_score(i) for i in ids]
        plain = [i for i in ids if i not in special and not sp.is_byte(i)]
        if all(scores[i] == int(scores[i]) for i in plain):  # ranks
            log = log_scores({pieces[i]: -scores[i] for i in plain})
            scores = [log.get(p, 0.0) if i not in special else 0.0 for i, p in enumerate(pieces)]
        return Codec(pieces, scores, [i for _, i in by_byte], special)

    def _spell(self, raw: bytes) -> list[int]:
        return self.bytes_of[list(raw)].tolist() if len(self.bytes_of) else [self.unk]

    def best(self, raw: bytes) -> list[int]:
        """The best path of one chunk, character by character."""
        n = len(raw)
        score, came, by = [0.0] + [-np.inf] * n, [0] * (n + 1), [-1] * (n + 1)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for i in range(n):
            if score[i] == -np.inf:
                continue
            width = _char_width(raw[i])
            node, single = 0, False
            for j in range(i, n):
                to = int(base[node]) + raw[j]
                if check[to] != node or not to:
                    break
                node = to
                if (v := int(value[node])) >= 0:
                    single |= j + 1 - i == width
                    if (s := score[i] + self.scores[v]) > score[j + 1]:
                        score[j + 1], came[j + 1], by[j + 1] = s, i, v
            j = min(n, i + width)
            if not single and (s := score[i] + self.unknown) > score[j]:
                score[j], came[j], by[j] = s, i, -1
        out, j = [], n
        while j:
            out += [by[j]] if by[j] >= 0 else self._spell(raw[came[j] : j])[::-1]
            j = came[j]
        return out[::-1]

    def best_of_all(self, raws: list[bytes]) -> list[list[int]]:
        """The same for many short chunks, one trie step at a time for all of them."""
        m, width = len(raws), max(map(len, raws))
        length = np.array([len(r) for r in raws])
        text = np.zeros((m, width + 1), np.int64)
        text[np.arange(width + 1) < length[:, None]] = np.frombuffer(b"".join(raws), np.uint8)
        score = np.full((m, width + 5), -np.inf)
        score[:, 0] = 0
        came, by = np.zeros((m, width + 5), np.int32), np.full((m, width + 5), -1, np.int32)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for i in range(width):
            row = np.flatnonzero((score[:, i] > -np.inf) & (length > i))
            if not len(row):
                continue
            start = score[row, i]
            chars = WIDTHS[text[row, i]]
            single = np.zeros(len(row), bool)
            live, node = np.arange(len(row)), np.zeros(len(row), np.int64)
            for j in range(i, width):
                c = text[row[live], j]
                to = base[node] + c
                good = (check[to] == node) & (to > 0) & (length[row[live]] > j)
                live, node = live[good], to[good]
                if not len(live):
                    break
                v = value[node]
                ends = v >= 0
                if ends.any():
                    k, v = live[ends], v[ends]
                    single[k[chars[k] == j + 1 - i]] = True
                    s = start[k] + self.scores[v]
                    better = s > score[row[k], j + 1]
                    r = row[k[better]]
                    score[r, j + 1], came[r, j + 1], by[r, j + 1] = s[better], i, v[better]
            k = np.flatnonzero(~single)
            j = np.minimum(length[row[k]], i + chars[k])
            s = start[k] + self.unknown
            better = s > score[row[k], j]
            r, j = row[k[better]], j[better]
            score[r, j], came[r, j], by[r, j] = s[better], i, -1
        out: list[list[int]] = [[] for _ in raws]
        row, at = np.arange(m), length.copy()
        while len(row):
            frm, piece = came[row, at], by[row, at]
            for r, a, b, p in zip(row.tolist(), frm.tolist(), at.tolist(), piece.tolist(), strict=True):
                if p >= 0:
                    out[r].append(p)
                else:
                    out[r] += self._spell(raws[r][a:b])[::-1]
            more = frm > 0
            row, at = row[more], frm[more]
        for ids in out:
            ids.reverse()
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text, as little-endian 32-bit integers."""
        cache = _cache.setdefault(self.key, {})
        split = [self.chunks.findall(normal(t)) if t else [] for t in texts]
        used = set().union(*split)
        new = used.difference(cache)
        if len(cache) + len(new) > CACHE:  # what these texts use stays
            stay = {c: cache[c] for c in used if c in cache}
            cache.clear()
            cache.update(stay)
        short = []
        for c in new:
            raw = c.encode("utf-8", "surrogatepass")
            if len(raw) > WIDE:
                cache[c] = np.array(self.best(raw), "<i4").tobytes()
            else:
                short.append((len(raw), raw, c))
        short.sort()
        for k in range(0, len(short), TOGETHER):
            part = short[k : k + TOGETHER]
            for (_, _, c), ids in zip(part, self.best_of_all([r for _, r, _ in part]), strict=True):
                cache[c] = np.array(ids, "<i4").tobytes()
        return [b"".join([cache[c] for c in s]) for s in split]

    def decode(self, ids: list[int]) -> str:
        raw = b"".join([self.text_of[i] for i in ids]).replace(MARK.encode(), b" ")
        return raw.decode("utf-8", "replace")[1:] if raw[:1] == b" " else raw.decode("utf-8", "replace")


def _char_width(lead: int) -> int:
    return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


WIDTHS = np.array([_char_width(b) for b in range(256)])


def normal(text: str) -> str:
    return MARK + text.replace(" ", MARK)


def _texts(batch: pa.RecordBatch, limit: int = 1 << 20) -> Iterator[list[str]]:
    part, size = [], 0
    for t in batch.column("text").to_pylist():
        part.append(t or "")
        size += len(part[-1])
        if size >= limit:
            yield part
            part, size = [], 0
    yield part


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """docs with token_ids array<int> and decoded string, what decoding these gives back."""
    arrow_rows(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Codec.load(model))
    keep = [c for c in docs.columns if c.lower() not in ("token_ids", "decoded")]
    schema = docs.select(*keep).schema.add("token_ids", ArrayType(IntegerType())).add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        for batch in batches:
            raw = [x for part in _texts(batch) for x in codec.encode_all(part)]
            at = np.cumsum([0, *(len(x) // 4 for x in raw)], dtype=np.int32)
            ids = np.frombuffer(b"".join(raw), "<i4")
            back = [codec.decode(ids[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(at), pa.array(ids)), pa.array(back, pa.string())], [*batch.schema.names, "token_ids", "decoded"])
        _cache.clear()  # the worker may go on to other work

    return docs.select(*keep).mapInArrow(run, schema)


def token_digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, n_byte_pieces, ids_sha256, decoded_sha256, round_trip) for every row."""
    arrow_rows(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Codec.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        is_byte = np.zeros(len(codec.text_of), bool)
        is_byte[codec.bytes_of] = True
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            for part in _texts(batch):
                for text, raw in zip(part, codec.encode_all(part), strict=True):
                    ids = np.frombuffer(raw, "<i4")
                    back = codec.decode(ids.tolist())
                    for c, x in zip(cols, (len(ids), int(is_byte[ids].sum()), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == text.replace(MARK, " ")), strict=True):
                        c.append(x)
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, cols, types)], ["doc_id", "n_tokens", "n_byte_pieces", "ids_sha256", "decoded_sha256", "round_trip"])
        _cache.clear()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, n_byte_pieces long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
