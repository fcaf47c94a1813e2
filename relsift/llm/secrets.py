"""Secret scans: fixed patterns, and strings that character Markov models find random.

Two Markov models of the first order over the characters of tokens, one of random strings and
one of ordinary identifiers, are counted from labelled samples with add-one smoothing. A token
is suspicious if its log-likelihood ratio, summed over its character pairs, reaches a threshold.
Ratios are kept as whole thousandths of a nat, so sums don't depend on their order.

All is done with DataFrame functions: regular expressions, higher-order functions, and one
lookup array of (number of signs + 1) squared weights, which the driver makes from as many counts.

Kinds, in this order: assign, access, hex (fixed patterns), markov (tokens of TOKEN characters and
more that overlap none of the others). Spans are code points, end exclusive.

Defined results: null text is empty and has no spans. Repeated rows are scanned each by itself.
Without samples no ratio differs from zero and the method adds nothing. Columns other than doc_id and
text are neither read nor returned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The kinds' patterns, and the group and length that a match must have.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))
KINDS = ("assign", "access", "hex", "markov")

SIGNS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
TOKEN = 20
TOKENS = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}+" % TOKEN
#: Thousandths of a nat: prior odds of about one in a thousand million, and half a nat for each of 20 pairs.
THRESHOLD = 30_000
#: Labelled samples: so many random strings and numbers. Words are those of all documents.
RANDOM_ROWS = 3_000

SPAN = "array<struct<start:int,rank:int,end:int,text:string>>"
#: Signs for private use, which no pattern matches: one set around matches, and one in its place where a text has it.
MARK, OTHER = "\ue000", "\ue001"
#: Steps of prefix sums: an array has 2**31 elements at most.
STEPS = [1 << k for k in range(31)]
#: Characters of a token that are looked at together.
PIECE = 4096


def let(value: Column, use) -> Column:
    """use(value), the value being computed once, however often it is used or in whatever loop."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(a: Column) -> Column:
    """Running sums of an array of integers, in as many passes as its length has binary digits."""
    add = lambda acc, step: F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - step), F.lit(0)))
    return let(a, lambda v: F.aggregate(F.filter(F.array(*map(F.lit, STEPS)), lambda step: step < F.size(v)), v, add))


def _spans(text: Column, rank: int, pattern: str, group: int, least: int) -> Column:
    """All matches of the pattern, leftmost and not overlapping, whose group has the least length.

    Most texts have none, which is asked first. One pass sets marks around the matches; split there, the text is gap, match, gap and so on, and the parts'
    lengths add up to the matches' places."""
    marked = F.regexp_replace(F.translate(text, MARK, OTHER), F.lit(pattern), F.lit(MARK + "$0" + MARK))
    value = lambda part: F.regexp_extract(part, pattern, group) if group else part

    def of(parts: Column) -> Column:
        ends = running(F.transform(parts, lambda x: F.length(x)))
        every = F.transform(F.arrays_zip(parts.alias("part"), ends.alias("end")), lambda x, i: F.struct((x["end"] - F.length(x["part"])).alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), x["part"].alias("text"), i.alias("i")))
        kept = F.filter(every, lambda x: (x["i"] % 2 == 1) & (F.length(value(x["text"])) >= least))
        return F.transform(kept, lambda x: F.struct(*(x[c].alias(c) for c in ("start", "rank", "end", "text")))).cast(SPAN)

    return F.when(text.rlike(pattern), let(F.split(marked, MARK, -1), of)).otherwise(F.array().cast(SPAN))


def _apart(tokens: Column, base: Column) -> Column:
    """The tokens, sorted and not overlapping, that overlap no base span: as many spans end at or before such a token's
    start as start before its end. Both numbers are places in sorted arrays, less those of the tokens before."""

    def places(ends: Column) -> Column:
        where = F.transform(F.array_sort(ends), lambda e, i: F.struct(e["token"].alias("token"), i.alias("i")))
        return F.transform(F.filter(where, lambda e: e["token"]), lambda e: e["i"])

    def end(at: Column, order: int, token: bool) -> Column:
        return F.struct(at.alias("at"), F.lit(order).alias("order"), F.lit(token).alias("token"))

    opened = places(F.concat(F.transform(base, lambda b: end(b["start"], 1, False)), F.transform(tokens, lambda t: end(t["end"], 0, True))))
    closed = places(F.concat(F.transform(base, lambda b: end(b["end"], 0, False)), F.transform(tokens, lambda t: end(t["start"], 1, True))))
    told = F.arrays_zip(tokens.alias("span"), opened.alias("opened"), closed.alias("closed"))
    return F.transform(F.filter(told, lambda x: x["opened"] == x["closed"]), lambda x: x["span"])


def samples(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Labelled samples (text, secret): digests in several alphabets are secrets; numbers, and the distinct
    words of all documents, alone and joined, are not. They depend on the documents alone, not on the session."""
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 512)
    made = spark.range(RANDOM_ROWS).select(digest.alias("hex"), F.base64(F.unhex(digest)).alias("b64"))
    url = F.translate("b64", "+/=", "-_")
    random = made.select(F.explode(F.array(F.substring("hex", 1, 40), F.substring("b64", 1, 44), F.substring(url, 1, 40), F.substring(F.upper(F.translate("b64", "+/=", "")), 1, 24), F.regexp_replace("b64", "[^A-Za-z0-9]", ""))).alias("text")).select("text", F.lit(1).alias("secret"))
    numbers = spark.range(RANDOM_ROWS).select(F.regexp_replace(F.abs(F.xxhash64("id")).cast("string"), "^-", "").alias("text"), F.lit(0).alias("secret"))
    words = documents.select(F.explode(F.array_distinct(F.regexp_extract_all(F.col("text").cast("string"), F.lit(r"(?<![A-Za-z0-9])[A-Za-z]{3,19}(?![A-Za-z0-9])"), F.lit(0)))).alias("text")).distinct()
    joined = words.select(F.explode(F.array(F.col("text"), F.concat("text", F.lit("_"), F.lower("text"), F.lit("_id")), F.concat(F.lower("text"), F.initcap("text")), F.concat(F.upper("text"), F.lit("_"), F.upper("text")), F.concat(F.lit("/"), F.col("text"), F.lit("-"), F.lower("text"), F.lit("/")))).alias("text"), F.lit(0).alias("secret"))
    return random.unionByName(numbers).unionByName(joined)


def fit(labelled: DataFrame) -> list[int]:
    """Weights by pair, (size + 1)**2 of them: thousandths of the log-likelihood ratio of random to ordinary."""
    pairs = labelled.where("length(text) > 1").select("secret", F.explode(F.transform(F.sequence(F.lit(1), F.length("text") - 1), lambda i: F.substring(F.col("text"), i, F.lit(2)))).alias("pair"))
    sign = lambda at: F.instr(F.lit(SIGNS), F.substring("pair", at, 1))
    counted = pairs.groupBy("secret", sign(1).alias("a"), sign(2).alias("b")).agg(F.count("*").alias("n")).collect()  # two tables of the signs at most
    size = len(SIGNS) + 1
    count = {0: {}, 1: {}}
    total = {0: [0] * size, 1: [0] * size}
    for r in counted:
        count[r.secret][r.a, r.b] = r.n
        total[r.secret][r.a] += r.n
    if not any(total[0]) or not any(total[1]):
        return [0] * size * size
    p = lambda k, a, b: (count[k].get((a, b), 0) + 1) / (total[k][a] + size)
    return [round(1000 * math.log(p(1, a, b) / p(0, a, b))) for a in range(size) for b in range(size)]


def ratio(token: Column, weights: list[int]) -> Column:
    """Log-likelihood ratio of a token of SIGNS, in thousandths of a nat: long ones piece by piece, each
    with the next one's first character, so that time is in proportion to length and memory bounded."""
    size = len(SIGNS) + 1
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")  # a constant, folded once

    def of(piece: Column) -> Column:
        signs = F.transform(F.split(piece, "", -1), lambda c: F.instr(F.lit(SIGNS), c))
        add = lambda acc, b: F.struct(b.alias("a"), (acc["sum"] + F.when(acc["a"] < 0, 0).otherwise(F.element_at(table, acc["a"] * size + b + 1))).alias("sum"))
        return F.aggregate(signs, F.struct(F.lit(-1).alias("a"), F.lit(0).cast("long").alias("sum")), add, lambda acc: acc["sum"])

    def pieces(raw: Column) -> Column:  # of bytes, where a piece is found at once
        starts = F.sequence(F.lit(1), F.greatest(F.octet_length(raw) - 1, F.lit(1)), F.lit(PIECE))
        return F.transform(starts, lambda at: F.substring(raw, at, F.lit(PIECE + 1)).cast("string"))

    return F.aggregate(let(token.cast("binary"), pieces), F.lit(0).cast("long"), lambda acc, x: acc + of(x))


def scan(documents: DataFrame, weights: list[int], threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, found): the spans of each document, sorted by start and kind, as structs of start, rank of kind, end, text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = F.concat(*[_spans(text, k, p, g, n) for k, (_, p, g, n) in enumerate(BASE)])
    random = lambda t: F.filter(t, lambda x: ratio(x["text"], weights) >= threshold)
    added = lambda b: let(random(_spans(text, 3, TOKENS, 0, TOKEN)), lambda t: F.when(F.size(b) == 0, t).otherwise(_apart(t, b)))
    return documents.select("doc_id", let(base, lambda b: F.array_sort(F.concat(b, added(b)))).alias("found"))


def listed(found: Column, *kinds: str) -> Column:
    """kind:start:end of the spans of the given kinds, comma-joined."""
    ranks = [KINDS.index(k) for k in kinds]
    names = F.array(*map(F.lit, KINDS))
    chosen = F.filter(found, lambda s: s["rank"].isin(ranks))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(documents: DataFrame, weights: list[int]) -> DataFrame:
    """(doc_id, secrets): the texts of the spans, for a quarantine table."""
    return scan(documents, weights).select("doc_id", F.transform("found", lambda s: s["text"]).alias("secrets"))
