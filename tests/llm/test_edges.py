"""Repeated and null ids, clashing names, hot keys and hostile inputs."""

import itertools
import random
import re
import time

import numpy as np
import pytest

import corpus_pipeline
from trajspark.llm import _arrays, _tables, decontamination, html_extract, line_dedup, media_avi, ngram_join, quality_classifier, sentencepiece_codec, suffix_dedup, url_filter

rng = random.Random(9)
WORDS = ["".join(rng.choices("abcdeé", k=rng.randrange(2, 7))) for _ in range(200)]


def prose(n, r=rng):
    return " ".join(r.choices(WORDS, k=n))


# ---- benchmark decontamination


def patterns_of(n, m, r):
    return {tuple(x.encode() for x in r.choices(WORDS[:12], k=m)): [str(k)] for k in range(n)}


@pytest.mark.parametrize("m", [1, 2, 3, 10])
def test_wu_manber_tables(m):
    r = random.Random(m)
    found = patterns_of(20, m, r)
    t = decontamination.Tables(found, m)
    words = [x.encode() for x in r.choices(WORDS[:14], k=4000)]
    for p in list(found)[:5]:
        at = r.randrange(3000)
        words[at : at + m] = p
    w = decontamination._word_hashes(words)
    # the shift of a block is the least distance from it to a pattern's end, by definition
    for block in {tuple(words[i : i + t.b]) for i in range(300)}:
        ends = [m - t.b - j for p in found for j in range(m - t.b + 1) if p[j : j + t.b] == block]
        h = decontamination._sequence_hash(decontamination._word_hashes(list(block)), np.array([0]), t.b)
        assert t.shifts(h)[0] == min(ends, default=m - t.b + 1)
    bounds = np.array([0, 5, 5, 1700, 4000])
    start, pattern = t.search(w, bounds)
    want = {(i, p) for a, b in itertools.pairwise(bounds.tolist()) for i in range(a, b - m + 1) if (p := tuple(words[i : i + m])) in found}
    assert {(s, t.words[k]) for s, k in zip(start.tolist(), pattern.tolist(), strict=True)} == want


def test_wu_manber_skips(monkeypatch):
    m, looked = 10, []
    t = decontamination.Tables(patterns_of(20, m, rng), m)
    assert len(set(t.shift.tolist())) > 2
    words = [x.encode() for x in random.Random(1).choices(WORDS[12:], k=9000)]
    plain = t.shifts
    monkeypatch.setattr(t, "shifts", lambda block: (looked.append(len(block)), plain(block))[1])
    t.search(decontamination._word_hashes(words), np.array([0, 9000]))
    assert sum(looked) < 9000 / 6


def test_benchmark_blocks_keep_rows_apart(spark, monkeypatch):
    rows = [(1, "alpha beta gamma"), (1, "never seen words"), (None, "alpha beta gamma"), (None, None), (2, "x delta y"), (1, "alpha beta gamma")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([("a", "beta gamma"), (None, "delta"), ("b", "alpha beta"), ("a", "gamma")], "item_id string, text string")
    out = []
    for block in (8 << 20, 5, 11):
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
        out.append(sorted(map(repr, decontamination.decontaminate(docs, items).collect())))
    assert out[0] == out[1] == out[2]
    hits = sorted((r.doc_id or 0, r.n_hit, r.n_items) for r in decontamination.decontaminate(docs, items).collect())
    assert hits == [(0, 0, 0), (0, 3, 2), (1, 0, 0), (1, 3, 2), (1, 3, 2), (2, 1, 1)]


# ---- quality classifier


def test_classifier_trains_without_ids(spark, monkeypatch):
    monkeypatch.setattr(quality_classifier, "SAMPLE", 50)
    texts = [prose(30) + "." if k % 3 else "|" + " ".join(rng.choices("@#|~^*&", k=40)) for k in range(400)]
    for ids in (range(400), [None] * 400, [7] * 400):
        docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
        _, weights, _ = quality_classifier.train(docs)
        assert (weights != 0).sum() > 20
        assert {(r.text[0] == "|", r.keep) for r in quality_classifier.classify(docs).collect()} == {(True, False), (False, True)}
    same = spark.createDataFrame([(1, texts[1])] * 300, "doc_id long, text string")
    assert quality_classifier.classify(same).where("keep").count() == 300


def test_em_raises_the_likelihood():
    """EM against the likelihood itself: no table near the estimate explains the votes better."""
    g = np.random.default_rng(3)
    k = len(quality_classifier.LABELLERS)
    bad = g.random(3000) < 0.3
    right = np.linspace(0.75, 0.95, k)
    said = np.where(g.random((3000, k)) < 0.7, np.where(g.random((3000, k)) < right, bad[:, None], ~bad[:, None]) + 1, 0)
    patterns, counts = np.unique((said * 3 ** np.arange(k)).sum(1), return_counts=True)
    posterior, table, prior = quality_classifier.estimate(patterns, counts.astype(float))
    digits = np.stack([patterns // 3**j % 3 for j in range(k)], 1)

    def likelihood(table, prior):
        p = table[:, :, 1:] / table[:, :, 1:].sum(2, keepdims=True)
        each = np.ones((2, len(digits)))
        for c in range(2):
            for j in range(k):
                each[c] *= np.where(digits[:, j] == 0, 1, p[c, j, np.maximum(digits[:, j] - 1, 0)])
        return (counts * np.log((1 - prior) * each[0] + prior * each[1])).sum()

    assert abs(prior - bad.mean()) < 0.05
    named = dict(zip(patterns.tolist(), posterior.tolist(), strict=True))
    guess = np.array([named[x] for x in (said * 3 ** np.arange(k)).sum(1).tolist()])
    assert ((guess > 0.5) == bad).mean() > 0.97
    best = likelihood(table, prior)
    for _ in range(100):
        other = np.clip(table + g.normal(0, 0.05, table.shape), 0.01, 1)
        other /= other.sum(2, keepdims=True)
        assert likelihood(other, np.clip(prior + g.normal(0, 0.05), 0.01, 0.99)) < best + 1


def test_labellers_report(spark):
    docs = spark.createDataFrame([(k, prose(30) + ".") for k in range(50)] + [(k, "| @ # | ~ ^ | * & |" * 9) for k in range(50, 70)], "doc_id long, text string")
    got = {r.labeller: r for r in quality_classifier.labellers(docs).collect()}
    assert len(got) == len(quality_classifier.LABELLERS) and got["symbols"].votes_bad > 0.9 > 0.1 > got["symbols"].votes_good


# ---- SentencePiece


def test_log_scores_are_probabilities():
    codec = sentencepiece_codec.Codec.load()
    used = [i for i, t in enumerate(codec.text_of) if codec.scores[i] < 0]
    assert abs(np.exp(codec.scores[used]).sum() - 1) < 1e-6 and len(used) > 30_000
    said = lambda t: [codec.text_of[i].decode() for i in np.frombuffer(codec.encode_all([t])[0], "<i4")]
    assert said("The quick brown") == ["▁The", "▁quick", "▁brown"]
    ranks = {"a": 4, "b": 5, "c": 6, "ab": 1, "abc": 2, "cc": 3}
    got = sentencepiece_codec.log_scores(ranks)
    o, left = sentencepiece_codec.OFFSET, sentencepiece_codec.LEFT
    # ab loses what abc takes, of which c takes part too
    count = {"ab": max(1 / (1 + o) - 1 / (2 + o), left / (1 + o)), "abc": 1 / (2 + o), "cc": 1 / (3 + o)}
    for p, q in itertools.combinations(count, 2):
        assert got[p] - got[q] == pytest.approx(np.log(count[p] / count[q]))


def test_wide_and_narrow_ways_segment_best():
    """best_of_all, best and a plain recursion over all segmentations agree on the sum of scores."""
    r = random.Random(4)
    pieces = ["<unk>", *sorted({"".join(r.choices("abé▁", k=r.randrange(1, 5))).replace("▁", "") or "b" for _ in range(25)}), "▁", "▁a"]
    scores = [0.0, *(-r.random() * 9 - 0.5 for _ in pieces[1:])]
    codec = sentencepiece_codec.Codec(pieces, scores, [], {0})
    index = {p: i for i, p in enumerate(pieces) if i}
    texts = ["▁" + "".join(r.choices("abéz", k=n)) for n in range(1, 9) for _ in range(12)]

    def total(ids, text):
        return sum(codec.scores[i] if i else codec.unknown for i in ids)

    def best(rest):
        if not rest:
            return 0.0
        ends = [scores[index[rest[:n]]] + best(rest[n:]) for n in range(1, len(rest) + 1) if rest[:n] in index]
        return max([*ends, *([] if rest[0] in index else [codec.unknown + best(rest[1:])])])

    for text, ids in zip(texts, codec.best_of_all([t.encode() for t in texts]), strict=True):
        assert ids == codec.best(text.encode())
        assert total(ids, text) == pytest.approx(best(text))


# ---- names of other columns


NAMES = ["doc", "rest", "raw", "row_id", "starts", "stops", "wrapper", "Votes", "Decoded", "Keep", "Score", "id", "n", "host_", "__rest"]


def test_columns_of_any_name_are_carried(spark):
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in NAMES)
    docs = spark.createDataFrame([(k, f"text {k}\nof {prose(60)}", *(f"{c}{k}" for c in NAMES)) for k in range(3)], schema)
    replaced = {line_dedup.line_dedup: [], quality_classifier.classify: ["Votes", "Keep", "Score"], sentencepiece_codec.encode: ["Decoded"]}
    for f, lost in replaced.items():
        for r in f(docs).collect():
            d = r.asDict()
            assert all(d[c] == f"{c}{r.doc_id}" for c in NAMES if c not in lost), f
    for stage in (corpus_pipeline.keep_good, corpus_pipeline.cut_repeated_lines):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and set(map(tuple, out.collect())) <= set(map(tuple, docs.collect()))
    assert corpus_pipeline.cut_repeated_lines(spark, docs, "").count() == 3
    pages = docs.select(F_expr("doc_id page_id"), F_expr("concat('http://h.com/', doc_id) url"), F_expr("concat('<p>', doc_id, '</p>') html"), *(f"`{c}`" for c in NAMES))
    for out in (url_filter.filter_urls(pages), html_extract.extract(pages)):
        for r in out.collect():
            d = r.asDict()
            assert all(d[c] == f"{c}{r.page_id}" for c in NAMES)


def F_expr(x):
    from pyspark.sql import functions as F

    return F.expr(x)


def test_null_and_repeated_ids(spark):
    """Rows that share an id, or have none, count each by itself: results are those of unique ids."""
    texts = [prose(80), prose(90), None, "", prose(70)]
    texts += [texts[0], texts[1] + " more", "one"]
    unique = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for ids in ([None] * len(texts), [None, 1, 1, 2, 2, None, 3, 3]):
        same = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
        for f, drop in ((suffix_dedup.suffix_dedup, "doc_id"), (sentencepiece_codec.token_digests, "doc_id"), (media_avi.pack, "doc_id")):
            assert sorted(map(repr, f(same).drop(drop).collect())) == sorted(map(repr, f(unique).drop(drop).collect()))
    assert sorted(r.n_shingles for r in ngram_join.ngram_jaccard(same, 3, 90).collect()) == sorted(r.n_shingles for r in ngram_join.ngram_jaccard(unique, 3, 90).collect())


# ---- hot keys


def test_spread_join(spark):
    left = spark.range(5000).selectExpr("id", "if(id % 3 = 0, 7, id % 2000) k", "if(id % 5 = 0, null, 1) j")
    right = left.where("j is not null").groupBy("k", "j").count().selectExpr("k", "j", "count n", "k * 2 v")
    got = _tables.spread_join(left, right, ["k", "j"], "n").select("id", "v").orderBy("id").collect()
    assert [(r.id, r.v) for r in got] == [(r.id, r.v) for r in left.join(right, ["k", "j"]).select("id", "v").orderBy("id").collect()]


def test_hot_urls_and_rows_without(spark):
    urls = ["http://x.net/es/a"] * 3000 + [None] * 1500 + [f"http://h{k}.example.com/en/{k}?://x#y" for k in range(800)] + ["http://a\nb/c\nd"]
    got = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).groupBy("rule", "verdict").count().collect()
    assert {(r.rule, r.verdict): r["count"] for r in got} == {("net/es/", "block"): 3000, (None, "allow"): 1501, ("example.com/en/", "block"): 800}


# ---- HTML


def test_hostile_pages_end_soon():
    began = time.time()
    deep = html_extract.main_text("<div>a" * 10_000 + "text" + "</div>" * 9_990)
    assert deep.endswith("text") and deep.count("a") == 10_000
    assert html_extract.main_text("<p>" + "<a " * 350_000).startswith("<a <a")
    assert html_extract.main_text("<p>x</p>" + "<a \"" * 200_001 + "><p>y</p>").startswith("x")
    assert html_extract.main_text("<p>x" + "</div>" * 100_000 + "y").split() == ["xy"]
    assert html_extract.main_text("<p title=\"a>b\">x</p><p title='>y</p>").split("\n")[0] == "x"
    assert html_extract.main_text("<script>" * 50_000) == ""
    kids = "".join(f"<{random.Random(k).choice(['p', 'h2', 'ul', 'table'])} class=c{k % 7}>t{k}</p>" for k in range(4_000))
    a = html_extract.shape(html_extract.parse(kids))
    assert len(html_extract.merge(a, html_extract.shape(html_extract.parse(kids[::-1] + kids)))[3]) <= html_extract.MOST
    assert html_extract.main_text(kids, a).count("t") >= 4_000
    assert time.time() - began < 30


def test_deep_elements_keep_their_order():
    page = "".join(f"<div>a{k}" for k in range(300)) + "".join(f"b{k}</div>" for k in reversed(range(300)))
    assert html_extract.main_text(page).split() == [f"a{k}" for k in range(299)] + ["a299b299"] + [f"b{k}" for k in reversed(range(299))]


def test_names_of_paragraphs():
    page = '<article><p class="share">We share the results.</p><section class="related-work"><p>Others did too.</p></section><div class="share">Post it</div><p class="ad">Buy</p></article>'
    assert html_extract.main_text(page) == "We share the results.\nOthers did too."


def test_generated_sites(spark):
    """Sites whose names say nothing: what is the same on all pages of a host goes, the rest stays."""
    r = random.Random(6)
    rows, want = [], {}
    for h in range(6):
        names = [f"x{r.randrange(1000)}z" for _ in range(4)]
        fixed = [prose(8, r) for _ in range(3)]
        for k in range(8):
            own = [prose(12, r) for _ in range(r.randrange(1, 4))]
            body = f'<div class="{names[0]}"><div>{fixed[0]}</div><div>{fixed[1]}</div></div><div class="{names[1]}">' + "".join(f"<p>{t}</p>" for t in own) + f'</div><div class="{names[2]}">{fixed[2]}</div>'
            rows.append((len(rows), f"http://h{h}.org/{k}", f"<html><body>{body}</body></html>"))
            want[len(rows) - 1] = "\n".join(own)
    got = {x.page_id: x.text for x in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
    # the wrappers decide: without them the fixed texts stay
    assert all(html_extract.main_text(h) != want[i] for i, _, h in rows)


def test_large_wrappers_join_by_host(spark, monkeypatch):
    rows = [(k, f"http://h{k % 3}/{k}", f"<body><div>menu of all</div><p>page {k} {prose(3)}</p></body>") for k in range(24)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(tuple, html_extract.extract(pages).collect()))
    monkeypatch.setattr(html_extract, "BROADCAST_CHARS", 10)
    assert sorted(map(tuple, html_extract.extract(pages).collect())) == want


# ---- media


def test_broken_media(spark):
    whole = media_avi.pack_bytes(bytes(range(256)) * 64)
    broken = [None, b"", b"RIFF", whole[:40], whole[: len(whole) // 2], whole.replace(b"\xff\xd8", b"\0\0", 1), b"x" * 200]
    media = spark.createDataFrame([(k, 0, m) for k, m in enumerate([*broken, whole])], "doc_id long, n_bytes long, media binary")
    assert {r.doc_id for r in media_avi.clips_of(media).collect()} == {len(broken)}
    rows = {r.doc_id: r for r in media_avi.media_digests(media).collect()}
    assert rows[len(broken)].payload_bytes == 16384 and all(rows[k].payload_sha256 is None for k in range(len(broken)))
    assert rows[0].media_bytes is None and rows[1].media_bytes == 0
    for m in broken[1:]:
        with pytest.raises(ValueError):
            media_avi.read_media(m)


def test_media_digest_fields(spark):
    """crc, sizes and feature against an independent count."""
    import hashlib
    import zlib

    text = "Zeile ß " * 900
    row = media_avi.media_digests(media_avi.pack(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    raw = text.encode()
    payload = raw + bytes(-len(raw) % 64)
    stored = media_avi.pack_bytes(payload)
    assert (row.n_bytes, row.payload_bytes, row.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
    assert (row.tail_crc32, row.media_bytes, row.media_sha256) == (zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest())
    size, cuts, light = row.feature.split(";")
    frames = -(-len(payload) // 4096)
    assert re.fullmatch(f"{frames}x[0-9]+x[0-9]+", size) and cuts.startswith("shots=0-") and sum(map(int, light[5:].split(","))) == frames * 64 * 64


def test_second_hash_is_another():
    buf = np.frombuffer(b"some line another line", np.uint8)
    a, b = (_arrays.SpanHash(buf, v)(np.array([0]), np.array([9])) for v in (_arrays.BYTE, _arrays.OTHER))
    assert a != b
