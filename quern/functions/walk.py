"""The leaves of JSON texts with their paths, as VARIANT expressions: no Python worker, and one row per leaf in one pass.

Each step opens the containers among the rows and leaves other rows as they are; ``LEVELS`` steps are one plan.  Texts
that are nested deeper go through more steps, as many as the most opening brackets of a text can ask for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels that are opened in one plan.
LEVELS = 8


def _inside(v: str, path: str) -> Column:
    """The members of a container with their paths; anything else as it is."""
    fields = F.expr(f"transform(map_entries(try_variant_get({v}, '$', 'map<string, variant>')), e -> named_struct('path', if({path} = '', e.key, {path} || '.' || e.key), 'value', e.value))")
    items = F.expr(f"transform(try_variant_get({v}, '$', 'array<variant>'), (x, i) -> named_struct('path', {path} || '[' || i || ']', 'value', x))")
    return F.coalesce(fields, items, F.array(F.struct(F.col(path).alias("path"), F.col(v).alias("value"))))


def _container(v: Column) -> Column:
    return F.coalesce(F.to_json(v).rlike(r"^[\[{]"), F.lit(False))


def _deepest(rows: DataFrame, *bodies: str) -> int:
    """At least the depth of the texts: the most opening brackets of one."""
    return rows.agg(F.max(F.greatest(F.lit(0), *[F.length(b) - F.length(F.translate(b, "[{", "")) for b in bodies]))).first()[0] or 0


def _open(rows: DataFrame, kept: list[str], levels: int) -> DataFrame:
    for _ in range(levels):
        rows = rows.select(*kept, F.inline(_inside("value", "path")))
    return rows


def leaves(rows: DataFrame, body: str, root: str = "") -> DataFrame:
    """The other columns of ``rows`` and (path, value: VARIANT) for every leaf of its JSON texts; fields are ``a.b``, items ``a[0]``.

    ``root`` is the path of the text itself.  Empty containers have no leaf, nor has a null text; a text that is no JSON is
    an error.
    """
    kept = [c for c in rows.columns if c != body]
    deepest = _deepest(rows, body)
    opened = min(LEVELS, max(1, deepest))
    out = _open(rows.filter(F.col(body).isNotNull()).select(*kept, F.lit(root).alias("path"), F.parse_json(body).alias("value")), kept, opened)
    while deepest > opened:  # brackets within strings count too, so this may be once more than needed
        if out.filter(_container(F.col("value"))).isEmpty():
            break
        out, opened = _open(out, kept, LEVELS), opened + LEVELS
    return out


_MEMBERS = """coalesce(
  transform(map_entries(try_variant_get(x.value, '$', 'map<string, variant>')), e -> named_struct('path', if(x.path = '', e.key, x.path || '.' || e.key), 'value', e.value)),
  transform(try_variant_get(x.value, '$', 'array<variant>'), (v, i) -> named_struct('path', x.path || '[' || i || ']', 'value', v)), array(x))"""


def unlike(rows: DataFrame, left: str, right: str, root: str = "") -> DataFrame:
    """The other columns of ``rows`` and (first, path, value: JSON) for the leaves that only one of two JSON texts has; ``first`` tells of which.

    A row's texts are compared where they are, and leaves that both have go no further.
    """
    kept = [c for c in rows.columns if c not in (left, right)]
    deepest, sides = _deepest(rows, left, right), (left, right)
    start = lambda c: F.when(F.col(c).isNotNull(), F.array(F.struct(F.lit(root).alias("path"), F.parse_json(c).alias("value")))).otherwise(F.array()).alias(c)
    found, opened = rows.select(*kept, *map(start, sides)), 0
    while opened < max(1, deepest):
        if opened and found.filter(" or ".join(f"exists(`{c}`, x -> coalesce(left(to_json(x.value), 1) IN ('[', '{{'), false))" for c in sides)).isEmpty():
            break
        levels = min(LEVELS, max(1, deepest) - opened)
        for _ in range(levels):
            found = found.select(*kept, *[F.expr(f"flatten(transform(`{c}`, x -> {_MEMBERS}))").alias(c) for c in sides])
        opened += levels
    # no JSON holds the character zero as such, so a leaf is one text, and sets of texts are compared by hash
    leaf = [F.expr(f"transform(`{c}`, x -> concat(x.path, char(0), to_json(x.value)))").alias(c) for c in sides]
    told = found.select(*kept, *leaf)
    only = lambda a, b, first: F.transform(F.array_except(a, b), lambda x: F.struct(F.lit(first).alias("first"), x.alias("leaf")))
    value = F.substring_index("leaf", "\0", -1)
    each = told.select(*kept, F.inline(F.concat(only(left, right, True), only(right, left, False)))).withColumn("value", value)
    return each.select(*kept, "first", F.expr("left(leaf, length(leaf) - length(value) - 1)").alias("path"), "value")


def strings(found: DataFrame) -> DataFrame:
    """Of :func:`leaves` those that are strings, with their text as ``value``."""
    return found.filter(F.schema_of_variant("value") == "STRING").withColumn("value", F.try_variant_get("value", "$", "string"))
