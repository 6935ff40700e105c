"""Secret scans in DataFrame functions only.

Base kinds are three patterns (assign, access, hex).  The method adds `entropy` spans: in
each candidate string, or each part of it outside base spans, a window of WINDOW characters slides on; counts of its characters are
kept by adding the one that enters and taking off the one that leaves, and with them the sum
of c * log2(c), from which the window's Shannon entropy follows.  Runs of windows over the
threshold of the candidate's character class are spans.  Each class of two sorts or more
(hex; digits with lower letters, with upper letters, with both; lower with upper letters) has its
threshold.  A window of one sort only (words, numbers) does not count, nor does one that the
allow-list knows: it starts with a repeated short unit, or says that it is an example.  UUIDs are
cut out.  What stands beside a base span, a UUID or an example is judged by itself.

Matches are read with split and regexp_extract_all, which see the same matches; a match
starts after all pieces and matches before it.  All positions count code points, ends are
exclusive.  Null and empty texts have no spans.  Repeated rows are scanned each; an empty
table gives an empty result; other columns are ignored.  No row meets another: there is no
shuffle, and a hot source or a long text stays within its own row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed patterns of the base kinds.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Public identifiers, which are cut out of candidates as base spans are.
UUID = r"(?<![0-9a-fA-F])[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?![0-9a-fA-F])"
#: Base kinds in order of listing; the least length of the group that counts (0: always).
BASE = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))
WINDOW = 20
#: Bits from which a window counts, by character class of the candidate: every class of two sorts or more has its own.
BITS = {"hex": 3.0, "mixed": 3.9, "lower_digit": 3.7, "upper_digit": 3.7, "letters": 3.9}
#: Windows of one sort (words, numbers) in a candidate of two do not count.
TWO_SORTS = "[0-9].*[A-Za-z]|[A-Za-z].*[0-9]|[a-z].*[A-Z]|[A-Z].*[a-z]"


def _matches(kind: str, pattern: str, group: int, least: int) -> str:
    """SQL for the array of (start, kind number, stop, kind name) of one pattern's matches in `text`."""
    quoted = "r'" + pattern.replace("'", "\\x27") + "'"
    number = [k for k, *_ in BASE].index(kind) if kind in {k for k, *_ in BASE} else 9
    keep = f"filter(zipped, x -> length(x.part) >= {least})"
    return f"""case when text rlike {quoted} then {_located(quoted, group, keep, number, kind)} else cast(array() as array<struct<start:int,rank:int,stop:int,kind:string,hit:string>>) end"""


def _located(quoted: str, group: int, keep: str, number: int, kind: str) -> str:
    zipped = f"""transform(array(struct(regexp_extract_all(text, {quoted}, 0) as hits, regexp_extract_all(text, {quoted}, {group}) as parts, transform(split(text, {quoted}, -1), p -> length(p)) as gaps)), m ->
      transform(m.hits, (h, i) -> struct(
        aggregate(slice(m.gaps, 1, i + 1), 0, (a, x) -> a + x) + aggregate(slice(m.hits, 1, i), 0, (a, x) -> a + length(x)) as start, h as hit, m.parts[i] as part)))[0]"""
    return f"transform({keep.replace('zipped', zipped)}, x -> struct(cast(x.start as int) as start, {number} as rank, cast(x.start + length(x.hit) as int) as stop, '{kind}' as kind, x.hit as hit))"


def _entropy() -> str:
    """SQL for the spans of high entropy in candidate struct `c` (start, hit)."""
    has = lambda chars: f"c.hit rlike '[{chars}]'"
    limit = " ".join(f"when {test} then {WINDOW} * (log2({WINDOW}) - {BITS[name]})" for name, test in (("hex", f"c.hit rlike '^[0-9a-fA-F]+$' and {has('0-9')} and {has('a-fA-F')}"), ("mixed", f"{has('0-9')} and {has('a-z')} and {has('A-Z')}"), ("lower_digit", f"{has('0-9')} and {has('a-z')}"), ("upper_digit", f"{has('0-9')} and {has('A-Z')}"), ("letters", f"{has('a-z')} and {has('A-Z')}")))
    # the state: counts by character, sum of c * log2(c), the open span, and the closed ones
    f = lambda n: f"element_at(array({', '.join(f'{i * __import__("math").log2(i) if i else 0.0}D' for i in range(WINDOW + 2))}), cast({n} as int) + 1)"
    code = lambda at: f"(ascii(substring(c.hit, {at}, 1)) - 31)"
    counts = f"i >= {WINDOW} and t <= c.most + 1e-9D and substring(c.hit, i - {WINDOW - 1}, {WINDOW}) rlike '{TWO_SORTS}' and not {_allowed(f'substring(c.hit, i - {WINDOW - 1}, {WINDOW})')}"
    step = f"""transform(array(struct({code('i')} as x, if(i > {WINDOW}, {code(f'i - {WINDOW}')}, 0) as y)), q ->
      transform(array(if(q.x = q.y, s.total, s.total + {f('s.counts[q.x] + 1')} - {f('s.counts[q.x]')} + if(q.y = 0, 0D, {f('s.counts[q.y] - 1')} - {f('s.counts[q.y]')}))), t ->
        transform(array({counts}), ok ->
          struct(transform(s.counts, (n, k) -> n + if(k = q.x, 1, 0) - if(k = q.y and q.y > 0, 1, 0)) as counts, t as total,
            if(ok, if(s.lo is null or i - {WINDOW} > s.hi, i - {WINDOW}, s.lo), s.lo) as lo,
            if(ok, i, s.hi) as hi,
            if(ok and s.lo is not null and i - {WINDOW} > s.hi, concat(s.done, array(struct(s.lo as lo, s.hi as hi))), s.done) as done))[0])[0])[0]"""
    empty = "cast(array() as array<struct<lo:int,hi:int>>)"
    spans = f"""aggregate(sequence(1, length(c.hit)), struct(array_repeat(0, 97) as counts, 0D as total, cast(null as int) as lo, cast(null as int) as hi, {empty} as done), (s, i) -> {step}, s -> if(s.lo is null, s.done, concat(s.done, array(struct(s.lo as lo, s.hi as hi)))))"""
    classed = f"transform(array(c), c -> struct(c.start as start, c.hit as hit, case {limit} end as most))[0]"
    return f"transform(filter(array({classed}), c -> c.most is not null), c -> transform({spans}, w -> struct(c.start + w.lo as start, {len(BASE)} as rank, c.start + w.hi as stop, 'entropy' as kind, '' as hit)))"


def _allowed(window: str) -> str:
    """What is suppressed: windows that start with repeated units, hold sequences, or say that they are examples."""
    return f"(lower({window}) rlike 'example|sample|placeholder|changeme|xxxx|0123456789|abcdefgh|00000000' or {window} rlike '^(.{{1,6}}?)\\\\1{{2,}}')"


def _pieces() -> str:
    """SQL for the parts of candidate `c` outside the spans in `cuts`, which are sorted, as candidates."""
    piece = f"if({{stop}} - s.at >= {WINDOW}, concat(s.done, array(struct(s.at as start, substring(c.hit, s.at - c.start + 1, {{stop}} - s.at) as hit))), s.done)"
    empty = "cast(array() as array<struct<start:int,hit:string>>)"
    return f"""aggregate(filter(cuts, b -> b.start < c.stop and c.start < b.stop), struct(c.start as at, {empty} as done), (s, b) -> struct(greatest(s.at, b.stop) as at, {piece.format(stop="b.start")} as done), s -> {piece.format(stop="c.stop")})"""


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, base, added): arrays of (start, rank, stop, kind, hit), base kinds and entropy spans."""
    text = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = text.select("doc_id", *(F.expr(_matches(*b)).alias(b[0]) for b in BASE), *(F.expr(_matches(k, p, 0, 0)).alias(k) for k, p in (("candidate", CANDIDATE), ("uuid", UUID))))
    found = found.select("doc_id", F.expr("array_sort(concat(assign, access, hex))").alias("base"), "candidate", "uuid")
    found = found.withColumn("cuts", F.expr("array_sort(concat(base, uuid))"))
    added = f"if(size(candidate) = 0, cast(array() as array<struct<start:int,rank:int,stop:int,kind:string,hit:string>>), flatten(flatten(transform(flatten(transform(candidate, c -> {_pieces()})), c -> {_entropy()}))))"
    return found.select("doc_id", "base", F.expr(added).alias("added"))


def _line(spans: str) -> str:
    return f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.stop)), ',')"


def secret_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row of docs(doc_id, text)."""
    found = find_secrets(docs)
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k, *_ in BASE]
    return found.select("doc_id", *counts, F.sha2(F.expr(_line("base")), 256).alias("base_sha256"), F.expr(_line("array_sort(concat(base, added))")).alias("spans"))
