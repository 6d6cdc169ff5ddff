"""Quality rules with host-level verdicts, in DataFrame operations only.

Each document gets the base features below, and is held against each of RULES. The failures of
each rule are counted by host, the hosts' failure rates of the rule are shrunk towards the corpus
by a beta prior fitted to the hosts themselves (method of moments), and a host whose shrunk rate
of some rule is too high is refused with all its documents. Too high is what lies over both

* MIN_HOST_RATE: at least as many of its documents fail the rule as pass it, and
* the upper PRIOR_Z quantile of the rule's prior (its mean and PRIOR_Z standard deviations), but
  at most MAX_HOST_RATE, so that hosts that are nearly all bad go however many there are.

Where hosts are alike, or none is bad, none is refused.

Defined cases: a null text has no words and fails the base rules; texts of any length are looked
at whole, in one row; a null host is a host of its own; an empty table gives an empty result;
equal rows are judged alike, one row each, and so are rows that repeat an id, each by its own
text; ties (a rate that equals the limit) stay; columns other than the id, the text and the host
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WHITE, WHITE_CLASS, cut, let, rows_of, tag_of, text_or_empty

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Limits of a host's shrunk rate of failures: see the module's text.
MIN_HOST_RATE = 0.5
MAX_HOST_RATE = 0.9
PRIOR_Z = 1.645
#: The prior's strength where hosts are alike: so many documents must speak against it.
ALIKE = 1e6


def rules() -> dict[str, Column]:
    """What a document fails, by rule: few words, repeated words, symbols for every tenth word, repeated lines, and words
    of under 1.5 characters on average (letters spaced out). There is no upper bound, for scripts without spaces."""
    words = F.col("n_words")
    return {
        "few": words < MIN_WORDS,
        "repeats": F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * words,
        "symbols": F.lit(10) * F.col("n_symbols") > words,
        "lines": F.lit(10) * F.col("n_dup_lines") > F.lit(3) * F.col("n_lines"),
        "letters": F.lit(2) * F.col("word_chars") < F.lit(3) * words,
    }


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, WHITE_CLASS + "+"), lambda w: w != "")


def _repeated(words: Column) -> Column:
    """How many words lie in a five-word window that occurs twice or more in the text."""
    windows = F.transform(
        F.sequence(F.lit(1), F.size(words) - 4), lambda i: F.xxhash64(F.slice(words, i, 5))
    )

    def count(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

        def places(pairs: Column) -> Column:
            def twin(pair: Column, i: Column) -> Column:
                return F.coalesce(F.get(pairs, i - 1)["h"] == pair["h"], F.lit(False)) | F.coalesce(
                    F.get(pairs, i + 1)["h"] == pair["h"], F.lit(False)
                )

            return F.array_sort(F.transform(F.filter(pairs, twin), lambda pair: pair["p"]))

        def covered(at: Column) -> Column:
            steps = F.transform(at, lambda p, i: F.least(F.lit(5), F.coalesce(F.get(at, i + 1) - p, F.lit(5))))
            return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            let(let(pairs, places), covered)
        )

    return F.when(F.size(words) < 6, F.lit(0)).otherwise(let(windows, count))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    text = text_or_empty(text_col)
    counts = let(
        _words(text), lambda w: F.struct(F.size(w).alias("n"), _repeated(w).alias("repeated"))
    )
    lines = F.filter(F.split(text, "\n"), lambda line: _without(line, WHITE) != "")
    of_lines = let(lines, lambda a: F.struct(F.size(a).alias("n"), (F.size(a) - F.size(F.array_distinct(a))).alias("twice")))
    return (
        docs.select(F.col(id_col), F.col(host_col).alias("host"), text.alias("text"))
        .select(
            id_col,
            "host",
            counts.alias("counts"),
            F.length(_without(text, WHITE)).cast("long").alias("word_chars"),
            (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
            of_lines.alias("of_lines"),
        )
        .select(
            id_col,
            "host",
            F.col("counts.n").cast("long").alias("n_words"),
            "word_chars",
            "n_symbols",
            F.col("of_lines.twice").cast("long").alias("n_dup_lines"),
            F.col("counts.repeated").cast("long").alias("n_repeat_words"),
            F.col("of_lines.n").cast("long").alias("n_lines"),
        )
        .withColumn("base_failed", rules()["few"] | rules()["repeats"])
    )


def host_rates(featured: DataFrame) -> DataFrame:
    """Per host: documents, and of each rule the failure rate shrunk by the beta prior fitted to all hosts, and the limit
    (rate_RULE, limit_RULE).

    A prior's mean m is the mean of the hosts' rates, and its strength m(1-m)/v - 1, where v is what their variance has
    over that of drawing as many documents from hosts that are alike. Where it has nothing over it (one host, equal
    rates, hosts of one document), hosts count as alike: the strength is ALIKE.
    """
    names = list(rules())
    hosts = featured.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *[F.sum(rule.cast("long")).alias(f"failed_{name}") for name, rule in rules().items()])
    rate = lambda name: F.col(f"failed_{name}") / F.col("n_docs")
    moments = hosts.agg(*[F.avg(rate(name)).alias(f"m_{name}") for name in names], *[F.var_pop(rate(name)).alias(f"v_{name}") for name in names], F.avg(1 / F.col("n_docs")).alias("w"))
    priors = []
    for name in names:
        m, w = F.col(f"m_{name}"), F.col("w")
        v = F.when(w < 1, F.greatest((F.col(f"v_{name}") - m * (1 - m) * w) / (1 - w), F.lit(0.0))).otherwise(F.lit(0.0))
        strength = F.when(v > 0, F.greatest(m * (1 - m) / v - 1, F.lit(1e-6))).otherwise(F.lit(ALIKE))
        limit = F.greatest(F.lit(MIN_HOST_RATE), F.least(m + F.lit(PRIOR_Z) * F.sqrt(v), F.lit(MAX_HOST_RATE)))
        priors += [(m * strength).alias(f"a_{name}"), strength.alias(f"s_{name}"), limit.alias(f"limit_{name}")]
    found = hosts.withColumn("prior", moments.select(F.struct(*priors)).scalar())
    shrunk = [((F.col(f"failed_{name}") + F.col(f"prior.a_{name}")) / (F.col("n_docs") + F.col(f"prior.s_{name}"))).alias(f"rate_{name}") for name in names]
    return found.select("host", "n_docs", *shrunk, *[F.col(f"prior.limit_{name}") for name in names])


def passing(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    own = docs.select("doc_id", "text", "source").withColumn("kept_tag", tag_of())
    judged = judge(own.select(F.struct("doc_id", "kept_tag", F.col("source").alias("kept_host")).alias("doc_id"), "text", "source"))
    return rows_of(docs, judged.where("kept").select(F.col("doc_id.doc_id").alias("kept_id"), "doc_id.kept_tag", "doc_id.kept_host"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: the features, base_failed, and kept after the verdict on its host."""
    featured = cut(features(docs, id_col, text_col, host_col))
    bad = F.lit(False)
    for name in rules():
        bad = bad | (F.col(f"rate_{name}") > F.col(f"limit_{name}"))
    # Only refused hosts are joined back: the side that grows with the corpus stays out of the join.
    refused = host_rates(featured).where(bad).select(F.col("host").alias("refused_host"), F.lit(True).alias("host_refused"))
    return (
        featured.join(refused, F.col("host").eqNullSafe(F.col("refused_host")), "left")
        .withColumn("host_refused", F.coalesce("host_refused", F.lit(False)))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_refused"))
        .drop("host", "refused_host", "n_lines")
    )
