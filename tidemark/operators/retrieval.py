"""Retrieval: policy filter before scoring, blended scores, and greedy packing under a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators import policy


def tokenize(text: str) -> list[str]:
    """Terms of a query: lower-cased runs of letters and digits, repeats kept."""
    out, word = [], ""
    for c in text.lower() + " ":
        if c.isalnum():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def may_pack(entries: DataFrame, rules: DataFrame, actor: str, purpose: str) -> DataFrame:
    """Only entries whose label the policy lets into a context; stands below scoring in the plan."""
    labels = entries.select("label").distinct().select(F.lit(actor).alias("actor"), "label", F.lit(purpose).alias("purpose"), F.lit("pack_into_context").alias("action"))
    allowed = policy.decide(labels, rules).where(F.col("decision") == "Allow").select("label")
    return entries.join(allowed, "label", "left_semi")


def scored(entries: DataFrame, query: str, embedding: list[float] | None = None, where: Column | None = None) -> DataFrame:
    """Adds score, rounded so that ties are ties on any engine, and cost."""
    rows = entries if where is None else entries.where(where)
    similarity = F.lit(None).cast("double") if embedding is None else X.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in embedding]))
    score = X.blend(similarity, X.text_score(F.col("text"), tokenize(query)), F.col("stale"))
    return rows.withColumn("score", F.round(score, 9)).withColumn("cost", X.token_cost(F.col("text")))


def pack(candidates: DataFrame, budget: int, group: list[str] | None = None) -> DataFrame:
    """Adds packed and pack_rank: whole items in order of (score desc, key), skipping what does not fit.

    What is used never shrinks, so once an item of some cost is skipped, all later ones of that
    cost are: those packed are the first of their cost, at most budget / cost. Only these, a
    number that the budget bounds (about budget * ln(budget)) whatever the corpus, are folded.
    """
    group = group or []
    of_cost = Window.partitionBy(*group, "cost").orderBy(F.desc("score"), "key")
    fits = candidates.select(*group, "key", "score", "cost").where((F.col("cost") <= budget) & (F.col("cost") > 0)).withColumn("n", F.row_number().over(of_cost))
    fits = fits.where((F.col("n") <= max(budget, 1)) & (F.col("n") * F.col("cost") <= budget))
    item = F.struct((-F.col("score")).alias("s"), F.col("key").alias("key"), F.col("cost").alias("cost"))
    queue = fits.groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("queue"))
    empty = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<key:string,rank:int>>").alias("keys"))

    def step(state: Column, x: Column) -> Column:
        taken = F.struct((state["used"] + x["cost"]).alias("used"), F.concat(state["keys"], F.array(F.struct(x["key"].alias("key"), (F.size(state["keys"]) + 1).alias("rank")))).alias("keys"))
        return F.when(state["used"] + x["cost"] <= budget, taken).otherwise(state)

    packed = queue.select(*group, F.explode(F.aggregate("queue", empty, step)["keys"]).alias("p")).select(*group, F.col("p.key").alias("key"), F.col("p.rank").alias("pack_rank"))
    return candidates.join(packed, [*group, "key"], "left").withColumn("packed", F.col("pack_rank").isNotNull())


def totals(packed: DataFrame) -> DataFrame:
    return packed.agg(
        F.count(F.lit(1)).alias("considered"),
        F.count(F.when(F.col("packed"), 1)).alias("n_packed"),
        F.coalesce(F.sum(F.when(F.col("packed"), F.col("cost"))), F.lit(0)).cast("long").alias("used"),
        F.count(F.when(~F.col("packed"), 1)).alias("dropped"),
        F.coalesce(F.bool_or(F.col("packed") & F.col("stale")), F.lit(False)).alias("contains_stale"),
    )


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
