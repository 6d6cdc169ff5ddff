"""Pure column functions: intervals, claims, confidence, scores, ids, saturating arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LONG = 2**63 - 1
MIN_LONG = -(2**63)

#: Ranks of the ways a claim was come by; a higher rank wins.
METHOD_RANKS = {"Direct": 5, "Human": 4, "Rule": 3, "Statistical": 2, "Imported": 1, "LanguageModel": 0}
#: Trust classes from the most to the least trusted; combining takes the greatest.
TRUST_CLASSES = ("VerifiedSystem", "Human", "ThirdParty", "Untrusted")
STALE_FACTOR = 0.25


# ---- intervals: half open, an unknown bound does not constrain -----------------------------------


def interval(start: Column | None, end: Column | None) -> Column:
    null = F.lit(None).cast("long")
    return F.struct((null if start is None else start).alias("start"), (null if end is None else end).alias("end"))


def contains(start: Column, end: Column, at: Column) -> Column:
    return (start.isNull() | (at >= start)) & (end.isNull() | (at < end))


def overlaps(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    return F.coalesce(start_a < end_b, F.lit(True)) & F.coalesce(start_b < end_a, F.lit(True))


def closed_at(start: Column, at: Column) -> Column:
    return interval(start, at)


def millis(timestamp: Column) -> Column:
    """Epoch milliseconds of a timestamp, read as UTC if it has no zone."""
    return F.unix_millis(timestamp.cast("timestamp"))


# ---- claims and records --------------------------------------------------------------------------


def clamp(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def method_rank(method: Column) -> Column:
    return reduce(lambda out, x: out.when(method == x[0], F.lit(x[1])), list(METHOD_RANKS.items())[1:], F.when(method == "Direct", F.lit(5)))


def method_name(rank: Column) -> Column:
    names = [k for k, _ in sorted(METHOD_RANKS.items(), key=lambda x: x[1])]
    return F.element_at(F.array(*[F.lit(n) for n in names]), (rank + 1).cast("int"))


def trust_name(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in TRUST_CLASSES]), (level + 1).cast("int"))


def trust_level(name: Column) -> Column:
    return reduce(lambda out, x: out.when(name == x[1], F.lit(x[0])), list(enumerate(TRUST_CLASSES))[1:], F.when(name == TRUST_CLASSES[0], F.lit(0)))


def eligible(evidence: Column, status: Column) -> Column:
    """Whether a claim may justify an action: it has evidence and stands asserted."""
    return (F.size(evidence) > 0) & (status == "Asserted")


def ineligibility(evidence: Column, status: Column) -> Column:
    return (
        F.when(F.size(evidence) == 0, F.lit("claim has no evidence"))
        .when(status == "Stale", F.lit("claim is stale: a source it rests on is in doubt"))
        .when(status != "Asserted", F.format_string("claim is %s, not Asserted", status))
    )


def comparable(method_a: Column, calibration_a: Column, method_b: Column, calibration_b: Column) -> Column:
    return (method_a == method_b) & calibration_a.eqNullSafe(calibration_b)


def tiebreak(rank: Column, confidence: Column) -> Column:
    """What decides between two claims of one key: the method's rank, then confidence in millionths."""
    return F.struct(rank.cast("int").alias("rank"), F.floor(clamp(confidence) * 1_000_000).cast("long").alias("millionths"))


def additive(kind: Column) -> Column:
    return kind.isin("counter", "set")


def citations(kind: Column, source: Column, evidence: Column) -> Column:
    """An observation cites its own source, a claim its evidence, a plain value nothing."""
    return F.when(kind == "observation", F.array(source)).when(kind == "claim", evidence).otherwise(F.array().cast("array<string>"))


# ---- saturating arithmetic -----------------------------------------------------------------------


def saturating_add(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_add(a, b), F.when(b > 0, F.lit(MAX_LONG)).otherwise(F.lit(MIN_LONG)))


def saturating_subtract(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_subtract(a, b), F.when(b < 0, F.lit(MAX_LONG)).otherwise(F.lit(MIN_LONG)))


def merge_counters(base: Column, source: Column, target: Column) -> Column:
    """base + (source - base) + (target - base), saturating; a missing base counts zero."""
    b = F.coalesce(base, F.lit(0).cast("long"))
    return saturating_add(saturating_add(b, saturating_subtract(source, b)), saturating_subtract(target, b))


def merge_sets(source: Column, target: Column) -> Column:
    return F.array_sort(F.array_union(source, target))


# ---- text and vectors ----------------------------------------------------------------------------


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def token_cost(text: Column) -> Column:
    """Estimated tokens: a quarter of the characters, rounded up, and one."""
    return (F.ceil(F.length(text) / 4) + 1).cast("long")


def text_score(text: Column, words: list[str]) -> Column:
    """Share of the query's terms that the lower-cased text contains, repeats counted."""
    if not words:
        return F.lit(0.0)
    low = F.lower(text)
    return sum((F.when(F.contains(low, F.lit(w)), 1.0).otherwise(0.0) for w in words), F.lit(0.0)) / float(len(words))


def dot(a: Column, b: Column) -> Column:
    """Sum of products in doubles, from the left; null if the lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null for different lengths, empty vectors, and zero vectors."""
    scale = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (scale > 0), dot(a, b) / F.nullif(scale, F.lit(0.0)))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def blend(similarity: Column, text: Column, stale: Column) -> Column:
    """(cosine + 1) / 2 where there is one, and the text score; a quarter of it for stale entries."""
    base = F.coalesce((similarity + 1) / 2, F.lit(0.0)) + text
    return F.when(stale, base * STALE_FACTOR).otherwise(base)


# ---- ids and displays ----------------------------------------------------------------------------


def source_display(system: Column, record: Column) -> Column:
    return F.concat(system, F.lit(":"), record)


def content_id(*parts: Column) -> Column:
    """SHA-256 over length-prefixed parts, so that no two lists of parts run together alike."""
    framed = [F.concat(F.length(p.cast("string")).cast("string"), F.lit("|"), p.cast("string")) for p in parts]
    return F.sha2(F.concat(*framed), 256)


def action_id(idempotency_key: Column) -> Column:
    return F.concat(F.lit("act-"), F.left(F.sha2(idempotency_key, 256), F.lit(16)))


def escalation(action_type: Column, target: Column, compensation: Column) -> Column:
    verb = F.element_at(F.split(action_type, "\\."), -1)
    return F.when(compensation.isNotNull(), F.format_string("%s on %s can't be undone; compensate with %s", verb, target, compensation)).otherwise(
        F.format_string("%s on %s can't be undone; a human must decide", verb, target)
    )


def graph_level(key: Column) -> Column:
    """Level of a key in a layered neighbour graph: floor(-ln(u) / ln 16), u in (0, 1) from the key's SHA-256, so that
    it is the same whenever the graph is built."""
    drawn = F.conv(F.left(F.sha2(key, 256), F.lit(13)), 16, 10).cast("long")
    return F.floor(-F.ln((drawn + 0.5) / float(1 << 52)) / F.ln(F.lit(16.0))).cast("int")


# ---- descriptions for people ---------------------------------------------------------------------

SHOWN_CHARS = 60


def shortened(text: Column) -> Column:
    n = F.length(text)
    return F.when(n <= SHOWN_CHARS, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(F.concat(F.lit('"'), F.left(text, F.lit(SHOWN_CHARS)), F.lit('..." ('), n.cast("string"), F.lit(" characters)")))


def describe_value(kind: Column, size: Column, counter: Column, members: Column, flag: Column, body: Column, number: Column) -> Column:
    """One line about a plain value; size: bytes of a blob."""
    return (
        F.when(kind == "blob", F.concat(size.cast("string"), F.lit(" bytes of data")))
        .when(kind == "counter", F.concat(F.lit("counter "), counter.cast("string")))
        .when(kind == "set", F.concat(F.lit("set of "), F.size(members).cast("string")))
        .when(kind == "flag", flag.cast("string"))
        .when(kind == "text", shortened(body))
        .when(kind == "number", number.cast("string"))
    )


def describe_claim(subject: Column, predicate: Column, value: Column, method: Column, confidence: Column, evidence: Column, status: Column) -> Column:
    """One line about a claim; evidence: how many items."""
    sure = F.concat(F.floor(confidence * 100).cast("long").cast("string"), F.lit("%"))
    return F.concat(subject, F.lit(" "), predicate, F.lit(" = "), value, F.lit(" ("), method, F.lit(", "), sure, F.lit(", evidence "), evidence.cast("string"), F.lit(", "), status, F.lit(")"))


def describe_observation(source: Column, trust: Column) -> Column:
    return F.concat(F.lit("observed from "), source, F.lit(" ("), trust_name(trust), F.lit(")"))


def describe_node(actor: Column, key: Column, intent: Column) -> Column:
    return F.concat(actor, F.lit(" wrote "), key, F.lit(": "), shortened(intent))


def describe_key(key: Column) -> Column:
    """A binary key as text, or its size where it isn't UTF-8."""
    text = F.try_validate_utf8(key.cast("string")) if hasattr(F, "try_validate_utf8") else key.cast("string")
    return F.coalesce(text, F.concat(F.lit("<"), F.octet_length(key).cast("string"), F.lit(" bytes>")))
