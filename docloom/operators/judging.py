"""What is recorded beside results: judgements of retrieval, explanations of scores, token usage of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .trust import WEIGHTS

KEY = ("query", "source_type", "source_id")


def recorded(judgements: DataFrame, new: DataFrame) -> DataFrame:
    """judgements (query, source_type, source_id, relevant, seq) with new ones: of those on one result the last (seq) stands, a tie goes to relevant."""
    both = judgements.unionByName(new)
    return both.groupBy(*KEY).agg(F.max(F.struct("seq", "relevant")).alias("_j")).select(*KEY, "_j.relevant", "_j.seq")


def metrics(results: DataFrame, judgements: DataFrame, k: int) -> DataFrame:
    """query, hits, recall and precision at k of results (query, source_type, source_id, rank).

    Precision divides by what was returned, at most k; recall by the results judged relevant. Queries without a relevant judgement have neither."""
    whole = F.lit(True)
    for c in KEY:  # a null equals nothing
        whole = whole & F.col(c).isNotNull()
    side = lambda df, n, w: df.select(*KEY, F.lit(n).alias("_n"), F.lit(w).alias("_w"))
    both = side(results.where(F.col("rank") <= k), 1, 0).unionByName(side(judgements.where("relevant").where(whole), 0, 1))
    per = both.groupBy(*KEY).agg(F.sum("_n").alias("_n"), F.max("_w").alias("_w"))
    hit = F.when((F.col("_n") > 0) & (F.col("_w") > 0), 1).otherwise(0)
    j = per.groupBy("query").agg(F.sum("_n").alias("returned"), F.sum("_w").alias("wanted"), F.sum(hit).alias("hits")).where("returned > 0")
    n = F.when(F.col("wanted") > 0, F.col("hits"))
    return j.select("query", n.alias("hits"), (n / F.col("wanted")).alias("recall"), (n / F.col("returned")).alias("precision"))


def _explanation(findings: Column) -> Column:
    weights = F.struct(*[F.lit(w).alias(k) for k, w in WEIGHTS.items()])
    parts = F.struct(*[F.col(k) for k in WEIGHTS])
    none = F.array().cast("array<struct<rule_id:string,severity:string,passed:boolean>>")
    return F.to_json(F.struct(weights.alias("weights"), parts.alias("components"), F.coalesce(findings, none).alias("validation_findings")))


def explained(scores: DataFrame, findings: DataFrame) -> DataFrame:
    """scores (entity_id, components, overall) with explanation, as JSON: the weights, the components and the findings (rule_id, severity, passed), by rule."""
    said = F.sort_array(F.collect_list(F.struct("rule_id", "severity", "passed")))  # at most a row a rule
    f = findings.where("entity_id is not null").groupBy("entity_id").agg(said.alias("_f"))
    return scores.join(f, "entity_id", "left").withColumn("explanation", _explanation(F.col("_f"))).drop("_f")


def explained_of(scores: DataFrame) -> DataFrame:
    """The same for scores of trust.scored(), whose findings are in their rows."""
    said = F.transform("findings", lambda x: F.struct(x["rule_id"].alias("rule_id"), x["severity"].alias("severity"), x["passed"].alias("passed")))
    return scores.withColumn("explanation", _explanation(F.sort_array(said)))


def usage(runs: DataFrame, by: list[str]) -> DataFrame:
    """Sums of input_tokens, output_tokens and total_tokens of runs by some columns; nulls count 0, a total that is not given is the sum of both."""
    i, o = F.coalesce("input_tokens", F.lit(0)), F.coalesce("output_tokens", F.lit(0))
    total: Column = F.coalesce("total_tokens", i + o)
    return runs.groupBy(*by).agg(F.sum(i).cast("long").alias("input_tokens"), F.sum(o).cast("long").alias("output_tokens"), F.sum(total).cast("long").alias("total_tokens"))
