"""Small data operators of the services: uploads, quotas, permissions, tokens, costs, retries, sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension, strip

#: Extensions that may be uploaded, with their types; fixed values.
TYPES = {".pdf": "application/pdf", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".tiff": "image/tiff"}
MAX_BYTES = 50 * 2**20


def upload_reasons(name: Column, mime: Column, size: Column, most: int = MAX_BYTES) -> Column:
    """Why an upload is rejected, in order of the checks; empty if it is accepted."""
    ext = extension(name)
    kinds = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    checks = [(F.coalesce(strip(name), F.lit("")) == "", "blank name"), (~ext.isin(*TYPES), "extension"), (ext.isin(*TYPES) & ~F.coalesce(F.try_element_at(kinds, ext) == F.lower(mime), F.lit(False)), "type"), (F.coalesce(size, F.lit(0)) <= 0, "empty"), (size > most, "too large")]
    return F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(why)) for bad, why in checks)))


def over_quota(docs: DataFrame, owner: str, most: int | None) -> DataFrame:
    """Owners with at least so many documents; none without a quota."""
    n = docs.groupBy(owner).agg(F.count("*").alias("n"))
    return n.where(F.lit(False)) if most is None else n.where(F.col("n") >= most)


def permitted(granted: Column, wanted: Column) -> Column:
    """Whether a list of permissions holds the wanted one, its resource's star, or the star."""
    return F.array_contains(granted, wanted) | F.array_contains(granted, F.concat(F.element_at(F.split(wanted, ":"), 1), F.lit(":*"))) | F.array_contains(granted, F.lit("*"))


def token_state(revoked_at: Column, expires_at: Column, now: Column) -> Column:
    return F.when(revoked_at.isNotNull(), "revoked").when(expires_at <= now, "expired").otherwise("valid")


def cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage (provider, model, input_tokens, output_tokens) with cost_usd; null where there is no price a million tokens."""
    per = lambda n, p: F.col(n) * F.col(p) / 1e6
    return usage.join(prices, ["provider", "model"], "left").withColumn("cost_usd", per("input_tokens", "input_price") + per("output_tokens", "output_price")).drop("input_price", "output_price")


def backoff(base: float, factor: float, attempt: Column) -> Column:
    return F.lit(base) * F.pow(F.lit(factor), attempt - 1)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def replace_run(df: DataFrame, path: str, run: str = "run_id") -> None:
    """Rows of df in place of those of the same runs; other runs stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run).parquet(path)


def closed_at(state: Column, at: Column) -> Column:
    """When a review item was closed; null while it is open."""
    return F.when(state.isin("resolved", "dismissed"), at)


def registry(spark: SparkSession, path: str) -> DataFrame:
    """canonical_id, canonical_name, aliases, extra (the other keys, as a map of text) of a JSON list of entries."""
    rows = spark.read.json(path, multiLine=True)
    known = ("canonical_id", "canonical_name", "aliases")
    rest = [c for c in rows.columns if c not in known]
    extra = F.map_filter(F.map_from_arrays(F.array(*(F.lit(c) for c in rest)), F.array(*(F.col(c).cast("string") for c in rest))), lambda k, v: v.isNotNull()) if rest else F.create_map().cast("map<string,string>")
    return rows.select(*known, extra.alias("extra"))


def structured(answers: Column, schema: str) -> tuple[Column, Column]:
    """Answers read as JSON of a schema, and whether one must be asked for again."""
    read = F.from_json(answers, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    bad = read.isNull() | read["_corrupt"].isNotNull()
    return F.when(~bad, read), bad
