"""Quality rules with thresholds that adapt to language and source (native: DataFrame functions only).

1. Every document gets integer metrics (:func:`measure`), computed inside its own row.
2. Each metric of each (language, source) is summarised by a histogram with relative error below 2 per cent
   (:func:`bucket`): 64 equal steps in every power of two.  Such sketches are merged by adding counts, so the
   aggregation is partial before the shuffle, any partitioning gives the same sketch, and a source that holds a third
   of all rows is still one small row per bucket and task.
3. Each metric states in ``TAIL`` which share of a group it may take for a tail.  A threshold lies half as far beyond
   that tail's quantile as the quantile lies from the median, in the group's own values: there is no fixed cutoff, so
   a group without any symbols rejects a few, and a source of tables keeps its many.  A quantile needs ``ROWS`` rows
   beyond it; a group with fewer takes the merged sketch of its language, and a language with fewer that of all rows.
4. The thresholds (one row per group) are written, and joined to the measured rows: by a broadcast while they are at
   most ``GROUPS`` rows, else as adaptive execution sees fit.

Null text counts as empty (fails the fixed rules); null language or source is a group of its own; repeated rows are
judged alike, each by itself; an empty table gives an empty result.  A text of any length is one row's arrays of its words.  All other columns are carried untouched, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import store

SPACES = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"
#: Per mille of a group's rows that may lie in a metric's tail.
TAIL = {"symbol_pm": 100, "dup_line_pm": 5, "repeat_pm": 5, "chars_pw": 5}
#: Metrics with a threshold below, too.
BOTH = ("chars_pw",)
ROWS = 3
GROUPS = 100_000
#: Documents with at least so many distinct repeated windows are handled by sorting instead of by look-up.
FEW = 128


def bucket(v: Column) -> Column:
    """Sketch bucket of a non-negative long: exact below 128, then 64 equal steps in each power of two.

    The bucket is named by its least value, so that it is also the estimate.
    """
    shift = F.length(F.bin(v)) - 7
    width = F.pow(F.lit(2.0), F.greatest(shift, F.lit(0))).cast("long")
    return v - v % width


def words_of(text: Column) -> Column:
    """The words of a text, an empty array for null or blank text."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPLIT))


def measure(df: DataFrame, text: str) -> DataFrame:
    """Adds column ``m``, a struct of integer metrics, to ``df``; ``text`` names the column with the text."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("__w", words_of(F.col(text)))
    df = df.withColumn("__n", F.size("__w"))
    # in-row windows of three words, hashed; positions of those found twice or more
    df = df.withColumn("__h", F.expr("case when __n < 3 then cast(array() as array<bigint>) else transform(sequence(0, __n - 3), i -> xxhash64(__w[i], __w[i + 1], __w[i + 2])) end"))
    df = df.withColumn("__s", F.sort_array("__h"))
    df = df.withColumn("__d", F.expr("array_distinct(filter(__s, (x, i) -> i > 0 and x = __s[i - 1]))"))
    df = df.withColumn(
        "__p",
        F.expr(
            "case when size(__d) = 0 then cast(array() as array<int>)"
            f" when size(__d) <= {FEW} then filter(sequence(0, __n - 3), i -> array_contains(__d, __h[i]))"
            " else sort_array(transform(filter(transform(sort_array(transform(__h, (x, i) -> struct(x as h, i as i))), (e, k) -> struct(e.h as h, e.i as i, k as k)),"
            "  e -> (e.k > 0 and e.h = __s[e.k - 1]) or (e.k + 1 < size(__s) and e.h = __s[e.k + 1])), e -> e.i)) end"
        ),
    )
    df = df.withColumn("__l", F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn(
        "m",
        F.struct(
            F.col("__n").cast("long").alias("n_words"),
            F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
            F.expr("aggregate(__p, named_struct('c', 0L, 'q', -3), (a, p) -> named_struct('c', a.c + least(3, p - a.q), 'q', p), a -> a.c)").alias("n_repeat_words"),
            F.size("__l").cast("long").alias("n_lines"),
        ),
    )
    return df.drop("__w", "__n", "__h", "__s", "__d", "__p", "__l")


def _rates() -> dict[str, Column]:
    div = lambda a, b: F.expr(f"(m.{a} * 1000) div greatest(m.{b}, 1L)")
    return {"symbol_pm": div("n_symbols", "word_chars"), "dup_line_pm": div("n_dup_lines", "n_lines"), "repeat_pm": div("n_repeat_words", "n_words"), "chars_pw": div("word_chars", "n_words")}


def base_failed() -> Column:
    """The fixed rules: under 50 words, or more than half of the words in repeated windows."""
    return (F.col("m.n_words") < 50) | (F.col("m.n_repeat_words") * 100 > F.col("m.n_words") * 50)


def sketches(rated: DataFrame) -> DataFrame:
    """(level, lang, source, metric, bucket, n): one mergeable sketch per language, source and metric (level 2), and their merged ones per language (1) and for all rows (0)."""
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), bucket(F.col(f"r.{k}")).alias("bucket")) for k in _rates()])
    own = rated.filter(~F.col("base_failed")).select("lang", "source", F.inline(pairs)).groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n"))
    none = F.lit(None).cast("string")
    above = F.array(
        F.struct(F.lit(2).alias("level"), F.col("lang").alias("lang"), F.col("source").alias("source")),
        F.struct(F.lit(1).alias("level"), F.col("lang").alias("lang"), none.alias("source")),
        F.struct(F.lit(0).alias("level"), none.alias("lang"), none.alias("source")),
    )
    return own.select(F.inline(above), "metric", "bucket", "n").groupBy("level", "lang", "source", "metric", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """(level, lang, source, metric, lo, hi) of sketches with enough rows for the metric's tail; a quantile is the least bucket whose cumulative count reaches it."""
    from pyspark.sql import Window

    w = Window.partitionBy("level", "lang", "source", "metric")
    tail = F.create_map(*[x for k, v in TAIL.items() for x in (F.lit(k), F.lit(v))])[F.col("metric")]
    cum = sketch.withColumn("cum", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w)).withColumn("tail", tail)
    reached = lambda share: F.min(F.when(F.col("cum") * 1000 >= F.col("total") * share, F.col("bucket")))
    q = cum.groupBy("level", "lang", "source", "metric").agg(reached(F.col("tail")).alias("low"), reached(F.lit(500)).alias("mid"), reached(1000 - F.col("tail")).alias("high"), F.max(F.col("total") * F.col("tail")).alias("beyond"))
    hi, lo = F.expr("high + (high - mid) div 2"), F.when(F.col("metric").isin(*BOTH), F.expr("low - (mid - low) div 2"))
    return q.filter((F.col("level") == 0) | (F.col("beyond") >= ROWS * 1000)).select("level", "lang", "source", "metric", lo.alias("lo"), hi.alias("hi"))


def limits(sketch: DataFrame) -> DataFrame:
    """(lang, source, f): the thresholds that hold for each group, its own or those of the level above."""
    wide = [F.first(F.when(F.col("metric") == k, F.col(side)), True).alias(f"{side}_{k}") for k in _rates() for side in ("lo", "hi")]
    of = lambda level: found.filter(F.col("level") == level)
    found = fences(sketch).groupBy("level", "lang", "source").agg(*wide)
    names = found.columns[3:]
    groups = sketch.filter("level = 2").select("lang", "source").distinct()
    two, one, zero = groups.alias("g"), of(1).alias("one"), of(0).alias("zero")
    two = two.join(of(2).alias("two"), F.expr("g.lang <=> two.lang and g.source <=> two.source"), "left")
    both = two.join(one, F.expr("g.lang <=> one.lang"), "left").join(F.broadcast(zero), F.lit(True), "left")  # zero is one row
    return both.select("g.lang", "g.source", F.struct(*[F.coalesce(F.col(f"two.{c}"), F.col(f"one.{c}"), F.col(f"zero.{c}")).alias(c) for c in names]).alias("f"))


def judge(docs: DataFrame, owner: str = "", keep_text: bool = True) -> DataFrame:
    """(doc: the whole input row, m: metrics, base_failed, kept) for every row of ``docs`` (text, lang, source).

    Without ``keep_text``, ``doc`` lacks the text, and the written table is a few numbers per row.

    The measured rows are written once into the shared folder; the sketches and the filter both read them from there.
    """
    part = measure(docs.select(F.struct("*").alias("doc")), "doc.text")
    if not keep_text:
        part = part.withColumn("doc", F.col("doc").dropFields("text"))
    part = part.withColumn("base_failed", base_failed()).withColumn("r", F.struct(*[c.alias(k) for k, c in _rates().items()]))
    part = store.table(part, "quality", owner)
    rated = part.select(F.col("doc.lang").alias("lang"), F.col("doc.source").alias("source"), "base_failed", "r")
    found = store.table(limits(sketches(rated)).select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), "f"), "limits", owner)
    if found.count() <= GROUPS:
        found = F.broadcast(found)
    joined = part.join(found, part["doc.lang"].eqNullSafe(found["__lang"]) & part["doc.source"].eqNullSafe(found["__source"]), "left")
    bad = F.lit(False)
    for k in TAIL:
        bad = bad | F.coalesce(bucket(F.col(f"r.{k}")) > F.col(f"f.hi_{k}"), F.lit(False)) | F.coalesce(bucket(F.col(f"r.{k}")) < F.col(f"f.lo_{k}"), F.lit(False))
    return joined.select("doc", "m", "base_failed", (~F.col("base_failed") & ~bad).alias("kept"))


def keep_good(docs: DataFrame, owner: str = "") -> DataFrame:
    """The rows of ``docs`` that pass, with their columns unchanged."""
    return judge(docs, owner).filter("kept").select("doc.*")
