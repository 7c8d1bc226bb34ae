"""Usage, prices and receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tolerant(value: Column) -> Column:
    """A count from whatever a provider sent; what is no number is 0."""
    return F.coalesce(F.try_to_number(value, F.lit("999999999999")).cast("long"), F.lit(0))


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds both rates per million tokens: of the model, or of its name without the provider's prefix.

    The price list is a handful of rows; Catalyst broadcasts it by its size.
    """
    full = prices.select(F.col("model"), F.col("input_rate").alias("i1"), F.col("output_rate").alias("o1"))
    bare = prices.select(F.col("model").alias("bare"), F.col("input_rate").alias("i2"), F.col("output_rate").alias("o2"))
    joined = usage.withColumn("bare", F.regexp_replace("model", "^[^/]*/", "")).join(full, "model", "left").join(bare, "bare", "left")
    whole = F.col("i1").isNotNull() & F.col("o1").isNotNull()
    both = F.col("i2").isNotNull() & F.col("o2").isNotNull()
    rate = lambda a, b: F.when(whole, F.col(a)).when(both, F.col(b))
    return joined.withColumns({"input_rate": rate("i1", "i2"), "output_rate": rate("o1", "o2")}).drop("bare", "i1", "i2", "o1", "o2")


def receipts(calls: DataFrame, prices: DataFrame, *keys: str) -> DataFrame:
    """Calls, tokens and costs by the given keys and model; costs are null where a rate is unknown."""
    total = calls.groupBy(*keys, "model").agg(F.count("*").alias("api_calls"), F.sum(tolerant(F.col("input_tokens"))).alias("input_tokens"), F.sum(tolerant(F.col("output_tokens"))).alias("output_tokens"))
    out = priced(total, prices)
    cost = lambda n, r: F.round(F.col(n) * F.col(r) / 1e6, 9)
    out = out.withColumns({"input_cost": cost("input_tokens", "input_rate"), "output_cost": cost("output_tokens", "output_rate")})
    return out.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens")).withColumn("total_cost", F.round(F.col("input_cost") + F.col("output_cost"), 9))


def counted(value: object) -> int:
    """A count that a provider sent; what is no number (a flag is none) is 0."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value != value or abs(value) == float("inf"):
        return 0
    return int(value)


def rates(model: str, prices: dict[str, tuple[float | None, float | None]] | None) -> tuple[float | None, float | None]:
    """Prices per million tokens of a model, or of its name without the provider's prefix; both or neither."""
    for name in dict.fromkeys((model, model.partition("/")[2] or model)):
        found = (prices or {}).get(name)
        if found and all(isinstance(x, (int, float)) for x in found):
            return float(found[0]), float(found[1])
    return None, None


def receipt(model: str, used: dict, prices: dict[str, tuple[float | None, float | None]] | None = None, **about: object) -> dict:
    """One receipt; used has api_calls, input_tokens and output_tokens, about what it is for (paths, target_lang, seconds)."""
    rate = rates(model, prices)
    tokens = [used["input_tokens"], used["output_tokens"]]
    costs = [None if r is None else n * r / 1e6 for n, r in zip(tokens, rate)]
    return {
        "model": model,
        "target_lang": None,
        "source_path": None,
        "target_path": None,
        "catalog_path": None,
        "duration_seconds": 0.0,
        **about,
        "api_calls": used["api_calls"],
        "input_tokens": tokens[0],
        "output_tokens": tokens[1],
        "total_tokens": sum(tokens),
        "input_rate": rate[0],
        "output_rate": rate[1],
        "input_cost": costs[0],
        "output_cost": costs[1],
        "total_cost": None if None in costs else sum(costs),
    }


def rendered(receipt: dict, width: int = 60) -> str:
    """One receipt as text; what is unknown shows as a dash, paths that it lacks are left out."""

    def money(value: float | None, digits: int = 6) -> str:
        return "—" if value is None else f"${value:,.{digits}f}"

    def line(name: str, value: str) -> str:
        return f"{name:<16}{value:>{width - 16}}"

    head = [line("Model", receipt["model"])]
    head += [line(name, str(receipt[key])) for name, key in (("Language", "target_lang"), ("Source", "source_path"), ("Target", "target_path"), ("Catalog", "catalog_path")) if receipt.get(key)]
    body = [line("Calls", f"{receipt['api_calls']:,}")]
    for name, key in (("Input", "input"), ("Output", "output")):
        price = receipt.get(f"{key}_rate")
        body += [line(f"{name} tokens", f"{receipt[f'{key}_tokens']:,}  {money(receipt[f'{key}_cost'])}"), line(f"{name} price", money(price, 2) + ("" if price is None else " a million"))]
    body.append(line("Total", f"{receipt['total_tokens']:,}  {money(receipt['total_cost'])}"))
    body += [line("Seconds", f"{receipt['duration_seconds']:.2f}")] if receipt.get("duration_seconds") else []
    return "\n".join(["=" * width, *head, "-" * width, *body, "=" * width])


def directory_status(files: DataFrame) -> DataFrame:
    """Adds status to (failed, validation_failed, processed) rows of files."""
    return files.withColumn("status", F.when((F.col("failed") > 0) | (F.col("validation_failed") > 0), "failed").when(F.col("processed") == 0, "skipped").otherwise("processed"))
