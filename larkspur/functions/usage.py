"""Token usage and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The names under which providers report each figure, first come first.
ALIASES = {
    "input": ["input", "inputTokens", "input_tokens", "promptTokens", "prompt_tokens"],
    "output": ["output", "outputTokens", "output_tokens", "completionTokens", "completion_tokens"],
    "cache_read": ["cacheRead", "cache_read", "cache_read_input_tokens", "cached_tokens", "prompt_tokens_details.cached_tokens"],
    "cache_write": ["cacheWrite", "cache_write", "cache_creation_input_tokens"],
    "total": ["total", "totalTokens", "total_tokens"],
}


def normalised(df: DataFrame, raw: str) -> Column:
    """The struct column `raw` with whatever names it has, as input, output, cache_read, cache_write, total.

    Input below zero is zero, figures that are not finite are null, and without any figure the result is null.
    """
    names = df.schema[raw].dataType
    has = {f.name for f in names.fields} | {f"{f.name}.{g.name}" for f in names.fields if hasattr(f.dataType, "fields") for g in f.dataType.fields}

    def figure(aliases: list[str]) -> Column:
        value = F.coalesce(*[F.col(f"{raw}.{a}").cast("double") for a in aliases if a in has] or [F.lit(None).cast("double")])
        return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)

    got = {k: figure(a) for k, a in ALIASES.items()}
    got["input"] = F.when(got["input"] < 0, 0.0).otherwise(got["input"])
    return F.when(F.coalesce(*got.values()).isNotNull(), F.struct(*[v.alias(k) for k, v in got.items()]))


def prompt_tokens(usage: Column) -> Column:
    total = sum((F.coalesce(usage[k], F.lit(0.0)) for k in ("cache_read", "cache_write")), F.coalesce(usage["input"], F.lit(0.0)))
    return F.when(usage.isNotNull() & (total > 0), total)


def session_total(usage: Column, override: Column) -> Column:
    return F.when(override > 0, override).otherwise(prompt_tokens(usage))


def cost(tokens: dict[str, Column], rates: dict[str, Column]) -> Column:
    """Tokens by rates a million; null where a rate is."""
    return sum((F.coalesce(t, F.lit(0.0)) * rates[k] for k, t in tokens.items()), F.lit(0.0)) / 1_000_000


def fixed(x: Column, places: int) -> Column:
    """x, not negative, with so many decimals: the nearest number, of two as near the greater. Told from x as it is in
    binary, so 1.005, which is a little less, is 1.00.

    x * scale is the rounded product and what it lacks, which Dekker's split of x tells exactly.
    """
    scale = 10**places
    wide = x * 134217729.0
    high = wide - (wide - x)
    p = x * float(scale)
    lacks = (high * float(scale) - p) + (x - high) * float(scale)
    whole = F.floor(p)
    n = whole + F.when((p - whole) + lacks >= 0.5, 1).when((p - whole) + lacks < -0.5, -1).otherwise(0)
    if not places:
        return n.cast("string")
    return F.concat(F.floor(n / scale).cast("string"), F.lit("."), F.lpad(F.pmod(n, F.lit(scale)).cast("string"), places, "0"))


def format_tokens(n: Column) -> Column:
    safe = F.greatest(F.coalesce(n, F.lit(0)).cast("double"), F.lit(0.0))
    return (
        F.when(safe >= 1_000_000, F.concat(fixed(safe / 1_000_000, 1), F.lit("m"))).when(safe >= 10_000, F.concat(fixed(safe / 1000, 0), F.lit("k")))
        .when(safe >= 1_000, F.concat(fixed(safe / 1000, 1), F.lit("k"))).otherwise(F.floor(safe + 0.5).cast("string"))
    )


def format_usd(x: Column) -> Column:
    x = x.cast("double")
    digits = lambda places: F.concat(F.when(x < 0, F.lit("$-")).otherwise(F.lit("$")), fixed(F.abs(x), places))
    return F.when(x >= 0.01, digits(2)).when(x.isNotNull(), digits(4))


def context_percent(total: Column, context: Column) -> Column:
    return F.when(context > 0, F.least(F.lit(999).cast("long"), F.floor(total / context * 100 + 0.5)))


def context_guard(tokens: Column, hard: int = 16_000, warn: int = 32_000) -> Column:
    return F.struct(((tokens > 0) & (tokens < warn)).alias("should_warn"), ((tokens > 0) & (tokens < hard)).alias("should_block"))
