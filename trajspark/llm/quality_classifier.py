"""Quality classifier: weak labels, expectation-maximisation, and a hashed linear scorer.

1. Overlapping heuristics vote on every document: 1 bad, 0 good, or no vote.
2. How often each pattern of votes occurs over all documents is all that EM needs (a
   two-class model with independent votes); its table has at most 3**len(LABELLERS) rows.
   EM estimates how often each heuristic gives each vote in either class, and with that a
   posterior for each pattern.
3. The posteriors of a bounded sample (SAMPLE documents, those with the least hash of
   doc_id and text) train a logistic scorer on hashed word features; it scores every document.

Features count whole words of whole texts.  Null and empty texts have no votes and no
features: they get the prior's side, which keeps them while most documents are good.
Repeated rows are scored each; an empty table gives an empty result.  `classify` carries
other columns along, renaming none; its own columns replace ones of the same name in any case.
`labellers` reports what EM estimated of the heuristics.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _arrays as A
from ._tables import arrow_rows

U = np.uint64
#: Most documents whose features are brought to the driver for training.
SAMPLE = 4000
BITS = 13
ROUNDS, STEPS = 60, 250
#: Words a document must have before a heuristic on shares of words votes.
LEAST_WORDS = 8

#: Name, statistic, bad from, good up to: between the two it does not vote; -1: never good.
LABELLERS = (
    ("symbols", "symbol", 0.12, -1),
    ("capitals", "upper", 0.50, -1),
    ("separators", "lone", 0.15, -1),
    ("stutter", "stutter", 0.30, 0.10),
    ("monotony", "same", 0.80, 0.65),
    ("letters", "other", 0.22, 0.07),
    ("endings", "marked", 0.45, -1),
    ("sentences", "stretch", 60.0, 14.0),
    ("cells", "bars", 0.15, -1),
)

# byte classes: 1 lower-case or beyond ASCII, 2 upper case, 3 digit, 4 sentence mark, 5 other, 0 space
KIND = np.full(256, 5, np.int64)
KIND[[32, *range(9, 14)]] = 0
KIND[97:123] = KIND[128:] = 1
KIND[65:91] = 2
KIND[48:58] = 3
KIND[[ord(c) for c in ".,;:?'\"-()"]] = 4


def _read(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """Words of a group of texts: bounds, rows, hashes, and word-wise facts."""
    start, end, row = A.words(buf, offs, A.SPACED)
    h = A.SpanHash(buf)(start, end)
    before = np.zeros(len(h), U)
    before[1:] = h[:-1]
    first = np.ones(len(h), bool)
    first[1:] = row[1:] != row[:-1]
    return {"start": start, "end": end, "row": row, "h": h, "repeat": ~first & (before == h), "kind": KIND[buf] if len(buf) else np.zeros(0, np.int64)}


def _shares(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    n = len(offs) - 1
    w = _read(buf, offs)
    words = np.bincount(w["row"], minlength=n)
    kind = w["kind"]
    per_kind = []
    for k in range(6):
        sums = np.concatenate(([0], np.cumsum(kind == k)))
        per_kind.append(sums[offs[1:]] - sums[offs[:-1]])
    solid = np.maximum(1, sum(per_kind[1:]))
    of_words = lambda mask: np.bincount(w["row"][mask], minlength=n) / np.maximum(1, words)
    last, lead = kind[w["end"] - 1] if len(words) else kind, kind[w["start"]]
    lone = (w["end"] - w["start"] == 1) & (last >= 4)
    order = np.lexsort((w["h"], w["row"]))
    row, h = w["row"][order], w["h"][order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    distinct = np.bincount(row[new], minlength=n)
    def bytes_in(marks: list[int]) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(np.isin(buf, marks))))
        return sums[offs[1:]] - sums[offs[:-1]]

    stretch = words / np.maximum(1, bytes_in([ord(c) for c in ".!?"]))
    return words, {
        "symbol": per_kind[5] / solid,
        "upper": per_kind[2] / np.maximum(1, per_kind[1] + per_kind[2]),
        "lone": of_words(lone),
        "stutter": of_words(w["repeat"]),
        "same": 1 - distinct / np.maximum(1, words),
        "other": (per_kind[4] + per_kind[5]) / solid,
        "marked": of_words((last == 5) & (lead != 5)),
        "stretch": np.where(words >= 20, stretch, 30.0),
        "bars": bytes_in([9, ord("|")]) / np.maximum(1, words),
    }


def votes(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The vote pattern of each text: one base-3 digit for each heuristic (0 none, 1 good, 2 bad)."""
    words, share = _shares(buf, offs)
    out = np.zeros(len(words), np.int64)
    for k, (_, name, bad, good) in enumerate(LABELLERS):
        x = share[name]
        vote = np.where(x >= bad, 2, np.where(x <= good, 1, 0))
        out += np.where(words >= LEAST_WORDS, vote, 0) * 3**k
    return out


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hashed feature of each word's shape, repetition and spelling."""
    w = _read(buf, offs)
    if not len(w["h"]):
        return w["row"], w["row"]
    kind, start, end = w["kind"], w["start"], w["end"]
    shape = kind[start] * 216 + kind[end - 1] * 36 + kind[np.maximum(start, end - 2)] * 6 + kind[np.maximum(start, end - 3)]
    shape = (shape * 2 + w["repeat"]) * 16 + np.minimum(15, end - start)
    shape = A.mix(shape.astype(U) * A.GOLD + U(7)) & U((1 << BITS - 1) - 1)
    word = (w["h"] & U((1 << BITS - 1) - 1)) + U(1 << BITS - 1)
    return np.concatenate([w["row"], w["row"]]), np.concatenate([shape, word]).astype(np.int64)


def estimate(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over the vote patterns: P(bad | pattern), P(vote | class) and P(bad)."""
    digits = np.stack([patterns // 3**k % 3 for k in range(len(LABELLERS))], axis=1) if len(patterns) else np.zeros((0, len(LABELLERS)), np.int64)
    bad = np.clip(((digits == 2).any(1)) * 0.8 + 0.1, 0.05, 0.95)
    table, prior = np.zeros((2, len(LABELLERS), 3)), 0.1
    for _ in range(ROUNDS):
        weight = np.stack([(1 - bad) * counts, bad * counts])
        for k in range(len(LABELLERS)):
            for v in range(3):
                table[:, k, v] = weight[:, digits[:, k] == v].sum(1) + 0.5
        table /= table.sum(2, keepdims=True)
        prior = float((weight[1].sum() + 0.5) / (weight.sum() + 1))
        logs = (np.log(table)[:, np.arange(len(LABELLERS))[None, :], digits] * (digits > 0)).sum(2)  # no vote, no evidence
        odds = np.log(prior / (1 - prior)) + logs[1] - logs[0]
        bad = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return bad, table, prior


def fit(rows: list[tuple[np.ndarray, np.ndarray]], bad: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic scorer, by Adam over the whole sample."""
    weights, bias = np.zeros(1 << BITS), float(np.log(prior / (1 - prior)))
    if not rows:
        return weights, bias
    at = np.concatenate([np.full(len(f), i) for i, (f, _) in enumerate(rows)])
    feature, value = (np.concatenate(x) for x in zip(*rows, strict=True))
    m, v = np.zeros(len(weights)), np.zeros(len(weights))
    for step in range(1, STEPS + 1):
        z = np.bincount(at, weights[feature] * value, minlength=len(rows)) + bias
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - bad
        g = np.bincount(feature, error[at] * value, minlength=len(weights)) / len(rows) + 1e-6 * weights
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        weights -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return weights, bias


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [votes(b, o) for _, _, b, o in A.groups(*A.text_buffer(batch.column("text")))]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts) if parts else [], pa.int64())], ["pattern"])


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pattern, cols = [], ([], [])
        for _, _, buf, offs in A.groups(*A.text_buffer(batch.column("text"))):
            pattern += votes(buf, offs).tolist()
            row, feature = features(buf, offs)
            for k in range(len(offs) - 1):
                f, c = np.unique(feature[row == k], return_counts=True)
                cols[0].append(f.astype("<i4").tobytes())
                cols[1].append((c / max(1, c.sum() / 2)).astype("<f8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(pattern, pa.int64()), *(pa.array(c, pa.binary()) for c in cols)], ["pattern", "feature", "value"])


def counted(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The vote patterns of all documents, and how many have each."""
    arrow_rows(docs.sparkSession)
    text = docs.select(F.col("text").cast("string"))
    found = text.mapInArrow(_vote, "pattern long").groupBy("pattern").count().orderBy("pattern").toPandas()
    return found["pattern"].to_numpy(np.int64), found["count"].to_numpy(float)


def train(docs: DataFrame) -> tuple[dict[int, float], np.ndarray, float]:
    """Posteriors by vote pattern, and the scorer's weights and bias."""
    patterns, counts = counted(docs)
    bad, _, prior = estimate(patterns, counts)
    posterior = dict(zip(patterns.tolist(), bad.tolist(), strict=True))
    total = int(counts.sum())
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order, share, rows = F.xxhash64("doc_id", "text"), 1.2 * SAMPLE / max(1, total), []
    while len(rows) < min(SAMPLE, total):
        # hashes under a bound that lets about 1.2 * SAMPLE rows pass, and the least of these; where
        # many rows are alike and too few pass, a wider bound
        some = text.where(order < int(-(2**63) + share * (2**64 - 1))) if share < 1 else text
        rows = some.orderBy(order, "doc_id").limit(SAMPLE).mapInArrow(_featurise, "pattern long, feature binary, value binary").collect()
        if share >= 1:
            break
        share *= 8
    rows.sort(key=lambda r: (r.pattern, r.feature, r.value))
    weights, bias = fit([(np.frombuffer(r.feature, "<i4"), np.frombuffer(r.value, "<f8")) for r in rows], np.array([posterior[r.pattern] for r in rows]), prior)
    return posterior, weights, bias


def labellers(docs: DataFrame) -> DataFrame:
    """(labeller, right_on_bad, right_on_good, votes_bad, votes_good): of the votes that each heuristic
    gives in a class by EM, the share that names the class (null: it gives none), and the share of documents on which it votes."""
    patterns, counts = counted(docs)
    _, table, _ = estimate(patterns, counts)
    rows = []
    for k, (name, *_) in enumerate(LABELLERS):
        said = table[:, k, 1:].sum(1)
        rows.append((name, float(table[1, k, 2] / said[1]) if said[1] else None, float(table[0, k, 1] / said[0]) if said[0] else None, float(said[1]), float(said[0])))
    return docs.sparkSession.createDataFrame(rows, "labeller string, right_on_bad double, right_on_good double, votes_bad double, votes_good double")


def classify(docs: DataFrame) -> DataFrame:
    """docs with votes string (g, b or - for each heuristic), posterior and score double (both P(good)) and keep boolean."""
    posterior, weights, bias = train(docs)
    shared = docs.sparkSession.sparkContext.broadcast((posterior, weights, bias))
    own = ["votes", "posterior", "score", "keep"]
    kept = [c for c in docs.columns if c.lower() not in own]
    schema = docs.select(*kept).schema.add("votes", "string").add("posterior", "double").add("score", "double").add("keep", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posterior, weights, bias = shared.value
        for batch in batches:
            pattern, z = [], []
            for _, _, buf, offs in A.groups(*A.text_buffer(batch.column("text"))):
                pattern += votes(buf, offs).tolist()
                n = len(offs) - 1
                row, feature = features(buf, offs)
                z.append(bias + np.bincount(row, weights[feature], minlength=n) / np.maximum(1, np.bincount(row, minlength=n) / 2))
            score = 1 / (1 + np.exp(np.clip(np.concatenate(z) if z else np.zeros(0), -30, 30)))
            said = ["".join("-gb"[p // 3**k % 3] for k in range(len(LABELLERS))) for p in pattern]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.string()), pa.array([round(1 - posterior[p], 6) for p in pattern], pa.float64()), pa.array(np.round(score, 6)), pa.array(score >= 0.5)], [*batch.schema.names, *own])

    return docs.select(*kept).mapInArrow(run, schema)
