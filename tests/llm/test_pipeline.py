import random
import re

import corpus_pipeline
from trajspark.llm import sentencepiece_codec


def test_stages_accept_odd_rows(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, clash string"
    rows = [(1, None, "en", None, None, "a"), (None, "", "en", "s", 0, "b"), (3, "x " * 300, "en", "s", 600, "c"), (4, "One two three. Four five.", None, "s", 25, None), (4, "One two three. Four five.", None, "s", 25, None)]
    for df in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, sf_dir)
            assert out.columns == df.columns, name
            out.count()
        assert corpus_pipeline.STAGES[-1][1](spark, df, sf_dir).count() == df.count()


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert 0.5 * docs < out.count() < docs and out.where("not round_trip").count() == 0


def test_rows_are_dropped_one_by_one(spark, sf_dir):
    words = [f"word{k} of{k} story{k}" for k in range(60)]
    copy, other, third = (" ".join(words[k : k + 20]) for k in (0, 20, 40))
    leak = next(r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if r.text and len(r.text.split()) > 12)
    rows = [(7, copy), (3, copy), (7, other), (None, copy), (None, third), (None, third), (7, leak), (None, leak + " x"), (9, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = lambda stage: sorted(((r.doc_id or -1, r.text or "") for r in stage(spark, docs, sf_dir).collect()))
    near = kept(corpus_pipeline.keep_one_of_near_copies)
    assert [x for x in near if not x[1].startswith(leak)] == sorted([(3, copy), (7, other), (-1, third), (9, ""), (9, "")])
    assert kept(corpus_pipeline.drop_leaks) == sorted((i or -1, t or "") for i, t in rows if leak not in (t or ""))


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_force(rows, items, good):
    """The four stages after the classifier on (doc_id, text) in the order of doc_id: (doc_id, text) of what stays."""
    rows = [r for r in rows if r[0] in good]
    # line runs of 50 words: all copies but the first go
    lines, runs = [t.split("\n") if t else [] for _, t in rows], {}
    for i, x in enumerate(lines):
        for j in range(len(x)):
            n, k = 0, j
            while k < len(x) and n < 50:
                n, k = n + max(1, len(words_of(x[k]))), k + 1
            if n >= 50:
                runs.setdefault(tuple(x[j:k]), []).append((i, j))
    gone = [set() for _ in lines]
    for run, at in runs.items():
        (a, b), *_ = sorted(at)
        for i, j in at:
            if (i, j) != (a, b):
                gone[i].update(range(max(j, b + len(run)) if i == a else j, j + len(run)))
    rows = [(d, "\n".join(x for j, x in enumerate(lines[i]) if j not in gone[i]) if lines[i] else t) for i, (d, t) in enumerate(rows) if not lines[i] or len(gone[i]) < len(lines[i])]
    # near copies: five words, 0.8
    sets = []
    for _, t in rows:
        w = words_of(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    first = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    first[i] = first[j] = min(first[i], first[j])
    rows = [r for i, r in enumerate(rows) if first[i] == i]
    # benchmark windows
    windows = set()
    for t in items:
        w = plain_words(t)
        m = min(10, len(w))
        windows |= {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set()
    hit = lambda w: any(tuple(w[i : i + len(x)]) == x for x in windows for i in range(len(w) - len(x) + 1))
    return [(d, t) for d, t in rows if not hit(plain_words(t))]


def test_pipeline_against_brute_force(spark, tmp_path):
    r = random.Random(12)
    vocabulary = ["".join(r.choices("abcdeklmnorst", k=r.randrange(2, 8))) for _ in range(400)]
    say = lambda n: " ".join(" ".join(r.choices(vocabulary, k=min(9, n - k))).capitalize() + "." for k in range(0, n, 9))
    shared, leak = "\n".join(say(20) for _ in range(4)), say(25)
    texts = [say(r.randrange(12, 160)) for _ in range(40)]
    texts += [texts[3], texts[4] + " More.", texts[5].replace(".", "!", 1), f"{say(15)}\n{shared}\n{say(15)}", f"{shared}\n{say(30)}", shared, f"{say(30)} {leak} {say(9)}", leak.upper(), None, "", "x", "x"]
    texts += ["| @ # | ~ ^ | * & | " * r.randrange(6, 20) for _ in range(6)] + [" ".join(r.choices("#@~^*|&", k=60)) for _ in range(4)]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    folder = str(tmp_path)
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    items = [leak, None, "qq zz"]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = {x.doc_id for x in corpus_pipeline.keep_good(spark, docs, folder).collect()}
    junk = {d for d, t in rows if t and t[0] in "|#@~^*&"}
    assert junk.isdisjoint(good) and len(good) >= len(rows) - len(junk) - 2
    want = brute_force(rows, items, good)
    got = {x.doc_id: (x.token_ids, x.n_tokens, x.round_trip, x.n_chars) for x in corpus_pipeline.run(spark, folder).collect()}
    codec = sentencepiece_codec.Codec.load()
    # a text that was cut has its length counted anew
    assert {d: (codec.best(sentencepiece_codec.normal(t).encode()) if t else []) for d, t in want} == {d: x[0] for d, x in got.items()}
    assert all(x[1] == len(x[0]) and x[2] and x[3] == len(dict(want)[d] or "") for d, x in got.items())
    assert 30 < len(want) < len(good)


def test_line_dedup_stage_starts_few_jobs(spark, sf_dir):
    """Rounds over all partitions for texts with short repeats only added up in the executors' memory."""
    lines = [f"word of line {k} " * 9 for k in range(11)]
    docs = spark.createDataFrame([(i, "\n".join(lines[i % 3 : 9 + i % 3])) for i in range(30)], "doc_id long, text string")
    spark.sparkContext.setJobGroup("few in stage", "line dedup")
    try:
        # later copies go whole; of the second and third text their last line stays
        kept = corpus_pipeline.cut_repeated_lines(spark, docs, sf_dir).collect()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few in stage"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.sparkContext.setLocalProperty("spark.job.description", None)
    assert sorted(lines) == sorted(x for r in kept for x in r.text.split("\n"))
    assert jobs <= 55
