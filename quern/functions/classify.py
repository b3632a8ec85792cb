"""Rule-based classification as generated ``when`` chains."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Model family by substring, first match wins.
FAMILIES = (
    ("claude", "anthropic"),
    ("gemini", "google"),
    ("deepseek", "deepseek"),
    ("glm", "zhipu"),
    ("gpt", "openai"),
    ("grok", "xai"),
    ("hy3", "tencent"),
    ("kimi", "moonshot"),
    ("mimo", "xiaomi"),
    ("minimax", "minimax"),
    ("nemotron", "nvidia"),
    ("qwen", "qwen"),
)


#: Rules that a table may have: it is written by hand, and every request is tried against all of it.
RULES = 10_000
#: Models that are free by name, names that stand for the model they were resolved to, models that are left out of statistics.
FREE = ("gpt-5-nano", "grok-code", "big-pickle")
RETIRED = ("big-pickle",)
EXCLUDED = ("alpha-gpt-next",)


def first_match(x: Column, rules, default: Column | None = None) -> Column:
    """The label of the first substring found in ``x``, whatever its case."""
    out, low = default if default is not None else F.lit(None).cast("string"), F.lower(x)
    for needle, label in reversed(list(rules)):
        out = F.when(low.contains(needle), label).otherwise(out)
    return out


def strip_suffixes(x: Column) -> Column:
    """Without trailing ``-free`` and ``:global``; ``unknown`` if nothing is left."""
    bare = F.regexp_replace(x, r"(-free|:global)+$", "")
    return F.when(F.coalesce(bare, F.lit("")) == "", "unknown").otherwise(bare)


def model_name(model: Column, resolved: Column, retired: tuple[str, ...] = RETIRED) -> Column:
    """The bare model name; a retired alias, in any case and with any suffix, stands for what it was resolved to."""
    bare = strip_suffixes(model)
    return F.when(F.lower(bare).isin(*retired), strip_suffixes(F.coalesce(resolved, F.lit("")))).otherwise(bare)


def excluded(model: Column, resolved: Column) -> Column:
    """Is the row left out of statistics?"""
    return F.lower(model_name(model, resolved)).isin(*EXCLUDED)


def provider_name(model: Column, resolved: Column, provider: Column, retired: tuple[str, ...] = ()) -> Column:
    """The author by the resolved model, then the bare model, then the given provider unless ``retired`` names it (in lower case), else ``unknown``."""
    known = F.coalesce(F.nullif(provider, F.lit("")), F.lit("unknown"))
    known = F.when(F.lower(known).isin(*retired), "unknown").otherwise(known) if retired else known
    return F.coalesce(first_match(F.coalesce(resolved, F.lit("")), FAMILIES), first_match(model_name(model, resolved), FAMILIES), known)


def tier(source: Column, model: Column, free: tuple[str, ...] = FREE) -> Column:
    """Go for the lite source, Free by name or suffix, else Paid."""
    return F.when(source == "lite", "Go").when(model.isin(*free) | model.rlike(r"-free(:global)?$"), "Free").otherwise("Paid")


#: Tier labels by their lower-case spelling; others stay as they are.
TIERS = {"paid": "Zen", "zen": "Zen", "go": "Go", "enterprise": "Enterprise", "all": "all"}


def canonical_tier(x: Column) -> Column:
    out = x
    for name, label in TIERS.items():
        out = F.when(F.lower(x) == name, label).otherwise(out)
    return out


def wildcard(x: Column, pattern: str) -> Column:
    """``*`` and ``?`` over the whole of x, line ends included; a trailing `` *`` may be missing."""
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    if body.endswith(r"\ .*"):
        body = body[: -len(r"\ .*")] + "( .*)?"
    return x.rlike(f"(?s)^{body}$")


def last_match(x: Column, y: Column, rules: list[tuple[str, str, str]], default: str = "ask") -> Column:
    """The action of the last rule (pattern for x, pattern for y, action) whose two patterns fit."""
    out = F.lit(default)
    for px, py, action in rules:
        out = F.when(wildcard(x, px) & wildcard(y, py), action).otherwise(out)
    return out


def last_match_rows(requests: DataFrame, rules: DataFrame, ident: str, x: str, y: str, default: str = "ask") -> DataFrame:
    """The same for rules in a table (ordinal, px and py as regular expressions, action): one row per request."""
    if rules.count() > RULES:
        raise ValueError(f"more than {RULES} rules")
    met = requests.join(F.broadcast(rules), F.expr(f"{x} rlike px and {y} rlike py"), "left")
    return met.groupBy(ident).agg(F.coalesce(F.max_by("action", "ordinal"), F.lit(default)).alias("action"))
