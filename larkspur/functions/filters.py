"""A small filter language: terms `word`, `key:value` and `"quoted"`, all of which must hold."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys of the language.
CONTAINS = {"agent": ["agentId"], "channel": ["channel"], "chat": ["chatType"], "provider": ["modelProvider", "providerOverride"], "model": ["model"], "label": ["label"]}
GLOB = {"key": "key", "session": "sessionId", "id": "sessionId"}
NUMBERS = {"mintokens": (">=", "totalTokens"), "maxtokens": ("<=", "totalTokens"), "mincost": (">=", "totalCost"), "maxcost": ("<=", "totalCost"), "minmessages": (">=", "messages"), "maxmessages": ("<=", "messages")}
HAS = ("tools", "errors", "context", "usage", "model", "provider")


def terms(query: str) -> list[tuple[str | None, str]]:
    """(key or None, value) of each term; a quoted term may hold spaces, its quotes go."""
    out = []
    for raw in re.findall(r'"[^"]*"|\S+', query):
        body = raw.strip('"')
        key, colon, value = body.partition(":")
        out.append((key.lower(), value) if colon and key else (None, body))
    return out


def number(text: str) -> float | None:
    """A number with $, thousands (k) or millions (m)."""
    m = re.fullmatch(r"\$?\s*(-?\d+(?:\.\d+)?)\s*([km]?)", text.strip().lower())
    return float(m[1]) * {"": 1, "k": 1e3, "m": 1e6}[m[2]] if m else None


def glob(pattern: str) -> str:
    """An anchored, case-insensitive regular expression of * and ?."""
    return "(?i)^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$"


@dataclass
class Parsed:
    condition: Column
    warnings: list[str] = field(default_factory=list)


def parsed(query: str, columns: list[str]) -> Parsed:
    """The condition of a query over a session table, and warnings; terms that cannot be read hold for every row."""
    have = lambda c: F.col(c) if c in columns else F.lit(None)
    held: list[Column] = []
    warnings: list[str] = []
    for key, value in terms(query):
        low = value.lower()
        if key is None:
            held.append(F.contains(F.lower(F.concat_ws(" ", *[have(c).cast("string") for c in ("label", "key", "sessionId")])), F.lit(low)))
        elif key in CONTAINS:
            text = F.concat_ws(" ", *[have(c) for c in CONTAINS[key]])
            listed = have("models") if key == "model" else have("providers") if key == "provider" else None
            if listed is not None and ("models" if key == "model" else "providers") in columns:
                text = F.concat_ws(" ", text, listed)
            held.append(F.contains(F.lower(text), F.lit(low)))
        elif key == "tool":
            held.append(F.coalesce(F.exists("tools", lambda t: F.contains(F.lower(t), F.lit(low))), F.lit(False)) if "tools" in columns else F.lit(False))
        elif key in GLOB:
            c = F.coalesce(have(GLOB[key]).cast("string"), F.lit(""))
            held.append(c.rlike(glob(value)) if re.search(r"[*?]", value) else F.contains(F.lower(c), F.lit(low)))
        elif key == "has" and low in HAS:
            held.append({
                "tools": F.coalesce(have("toolCalls").cast("double") > 0, F.lit(False)), "errors": F.coalesce(have("errors").cast("double") > 0, F.lit(False)),
                "context": have("contextTokens").isNotNull(), "usage": have("totalTokens").isNotNull(), "model": have("model").isNotNull(), "provider": have("modelProvider").isNotNull(),
            }[low])
        elif key in NUMBERS:
            n = number(value)
            if n is None:
                warnings.append(f"Invalid number for {key}: {value}")
                continue
            op, c = NUMBERS[key]
            x = F.coalesce(have(c).cast("double"), F.lit(0.0))
            held.append(x >= n if op == ">=" else x <= n)
        else:
            warnings.append(f"Unknown filter: {key}")
    condition = F.lit(True)
    for h in held:
        condition = condition & h
    return Parsed(condition, warnings)


def sessions(df: DataFrame, query: str) -> tuple[DataFrame, list[str]]:
    p = parsed(query, df.columns)
    return df.where(p.condition), p.warnings


def suggestions(df: DataFrame, facet: str, most: int = 6) -> DataFrame:
    """The first values of a facet in order of how many rows have them."""
    return df.where(F.col(facet).isNotNull()).groupBy(F.col(facet).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(most)


def first_rule(rules: list[tuple[dict[str, str], str]], default: str = "deny") -> Column:
    """The action of the first rule of (conditions, action) that fits; a condition on `prefix` is one on the key."""
    out = F.lit(default)
    for conditions, action in reversed(rules):
        fits = F.lit(True)
        for name, value in conditions.items():
            fits = fits & (F.col("key").startswith(value) if name == "prefix" else F.col(name) == value)
        out = F.when(fits, F.lit(action)).otherwise(out)
    return out


def logs(df: DataFrame, levels: list[str], needle: str) -> DataFrame:
    """Lines of the levels that hold the needle in message, subsystem or raw text, in any case."""
    text = F.lower(F.concat_ws(" ", "message", "subsystem", "raw"))
    return df.where(F.col("level").isin(levels) & F.contains(text, F.lit(needle.strip().lower())))


def tool_visible(tool: Column, allow: list[str], deny: list[str]) -> Column:
    """Whether a tool is to be seen: `*` stands for anything, case does not count, deny wins, no allow list lets all in."""
    fits = lambda names: F.lower(tool).rlike("^(?:" + "|".join(".*".join(re.escape(x) for x in n.strip().lower().split("*")) for n in names) + ")$")
    allowed = fits(allow) if allow else F.lit(True)
    return F.coalesce(allowed & ~fits(deny) if deny else allowed, F.lit(False))
