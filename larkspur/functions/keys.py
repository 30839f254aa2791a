"""Session keys: colon-separated, scoped to an agent as `agent:<id>:<rest>`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parts(key: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.trim(F.coalesce(key, F.lit("")))), ":"), "")


def _scoped(key: Column) -> Column:
    p = _parts(key)
    return (F.size(p) >= 3) & (F.get(p, F.lit(0)) == "agent")


def agent_id(key: Column) -> Column:
    return F.when(_scoped(key), F.get(_parts(key), F.lit(1)))


def rest(key: Column) -> Column:
    p = _parts(key)
    return F.when(_scoped(key), F.array_join(F.slice(p, F.lit(3), F.greatest(F.size(p), F.lit(1))), ":"))


def chat_type(key: Column) -> Column:
    scope = F.coalesce(rest(key), F.lower(F.trim(F.coalesce(key, F.lit("")))))
    p = F.split(scope, ":")
    has = lambda word: F.array_contains(p, word)
    legacy = scope.rlike("^discord:(?:[^:]+:)?guild-[^:]+:channel-[^:]+$")
    return F.when(has("group"), "group").when(has("channel"), "channel").when(has("direct") | has("dm"), "direct").when(legacy, "channel").otherwise("unknown")


def is_cron(key: Column) -> Column:
    return F.coalesce(rest(key).startswith("cron:"), F.lit(False))


def is_cron_run(key: Column) -> Column:
    return F.coalesce(rest(key).rlike("^cron:[^:]+:run:[^:]+$"), F.lit(False))


def _has_prefix(key: Column, prefix: str) -> Column:
    raw = F.lower(F.trim(F.coalesce(key, F.lit(""))))
    return raw.startswith(prefix) | F.coalesce(rest(key).startswith(prefix), F.lit(False))


def is_subagent(key: Column) -> Column:
    return _has_prefix(key, "subagent:")


def is_acp(key: Column) -> Column:
    return _has_prefix(key, "acp:")


def subagent_depth(key: Column) -> Column:
    return F.size(F.split(F.lower(F.trim(F.coalesce(key, F.lit("")))), ":subagent:")) - 1


def thread_parent(key: Column) -> Column:
    """What stands before the last thread or topic marker; null without one or with nothing before it."""
    found = F.regexp_extract(F.trim(key), r"(?i)^(.+):(?:thread|topic):(?!.*:(?:thread|topic):).*$", 1)
    return F.when(F.trim(found) != "", F.trim(found))
