"""Column expressions: dates, keys, money, rates, casts, hashes, network prefixes.  All of them stay in generated code."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROCENTS = 100_000_000


def blank_default(x: Column, default) -> Column:
    """``default`` for null and empty strings."""
    return F.coalesce(F.nullif(x, F.lit("")), default if isinstance(default, Column) else F.lit(default))


def all_of(*conditions: Column | None) -> Column:
    """The conjunction of those conditions that are given; true without any."""
    return reduce(and_, [c for c in conditions if c is not None], F.lit(True))


def iso_week_key(t: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), t).cast("string"), F.lit("-W"), F.lpad(F.extract(F.lit("WEEK"), t).cast("string"), 2, "0"))


def day_key(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd")


def minute_key(t: Column) -> Column:
    return F.date_format(t, "yyyyMMddHHmm").cast("long")


def week_start(t: Column) -> Column:
    return F.date_trunc("week", t)


def is_week_key(key: Column) -> Column:
    """A valid ``YYYY-Www`` key: the Monday it names has that key again."""
    year, week = F.substring(key, 1, 4), F.substring(key, 7, 2).try_cast("int")
    fourth = F.try_to_timestamp(F.concat(year, F.lit("-01-04")))
    monday = F.date_trunc("week", fourth) + F.make_interval(days=(week - 1) * 7)
    return F.coalesce(key.rlike(r"^\d{4}-W\d{2}$") & (iso_week_key(monday) == key), F.lit(False))


def anchored_month(now: Column, anchor: Column) -> tuple[Column, Column]:
    """[start, end) of the month window that holds ``now`` and begins on the anchor's day and time, clamped to each month's length."""

    def start(shift: int) -> Column:
        month = F.add_months(F.trunc(now, "month"), shift)
        day = F.least(F.dayofmonth(anchor), F.dayofmonth(F.last_day(month)))
        return (F.date_add(month, day - 1).cast("timestamp").cast("long") + (anchor.cast("timestamp").cast("long") - F.date_trunc("day", anchor.cast("timestamp")).cast("long"))).cast("timestamp")

    this, before, after = start(0), start(-1), start(1)
    early = now.cast("timestamp") < this
    return F.when(early, before).otherwise(this), F.when(early, this).otherwise(after)


#: Days that a trailing range goes back from the latest day.
RANGES = {"1D": 0, "1W": 6, "2W": 13, "1M": 27, "2M": 55, "3M": 89}


def range_start(kind: Column, earliest: Column, latest: Column) -> Column:
    """The first day of a range that ends with the day ``latest``: trailing, since new year (YTD), or everything; never before ``earliest``."""
    start = F.when(kind == "YTD", F.trunc(latest, "year")).otherwise(earliest)
    for name, days in RANGES.items():
        start = F.when(kind == name, F.date_sub(latest, days)).otherwise(start)
    return F.greatest(earliest, start)


def bucket_label(start: Column, kind: Column, now: Column) -> Column:
    """``JAN 5`` for trailing ranges, ``JAN`` for the year's, and for everything the month of this year or another year's number."""
    month = F.upper(F.date_format(start, "MMM"))
    same_year = F.when(F.year(start) == F.year(now), month).otherwise(F.year(start).cast("string"))
    return F.when(kind == "YTD", month).when(kind == "ALL", same_year).otherwise(F.concat_ws(" ", month, F.dayofmonth(start).cast("string")))


def canonical_json(x: Column) -> Column:
    """JSON text with object keys in order and without spaces; null for what is no JSON."""
    return F.to_json(F.try_parse_json(x))


def seconds_to_midnight(t: Column) -> Column:
    """Whole seconds up to the next UTC day."""
    ms = F.unix_millis(t.cast("timestamp"))
    return F.ceil((F.lit(86_400_000) - ms % 86_400_000) / 1000).cast("long")


def epoch_time(x: Column) -> Column:
    """A number is milliseconds above 1e10, else seconds."""
    return F.when(x > 10_000_000_000, F.timestamp_millis(x.cast("long"))).otherwise(F.timestamp_seconds(x))


def local_day(t: Column, offset: str) -> Column:
    """The calendar day at a fixed offset of a UTC time without zone."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(offset), t.cast("timestamp_ntz")))


def percent_change(now: Column, before: Column) -> Column:
    """Rounded percent; without a positive value before, 100 if there is one now, else 0."""
    return F.when(F.coalesce(before, F.lit(0)) <= 0, F.when(now > 0, 100).otherwise(0)).otherwise(F.floor((now - before) * 100 / before + 0.5)).cast("long")


def share(x: Column, total: Column, places: int = 6) -> Column:
    """x / total (whole numbers) as a decimal, rounded once, halves away from zero; null where the total is not positive."""
    whole = lambda c: c.cast("decimal(20,0)")
    over, twice = F.abs(whole(x)) * F.lit(2 * 10**places).cast("decimal(10,0)") + whole(total), whole(total) * 2
    units = ((over - over % twice) / twice).cast("decimal(18,0)") * F.when(x < 0, -1).otherwise(1)
    return F.when(total > 0, units * F.lit(Decimal(1).scaleb(-places))).cast(f"decimal(18,{places})")


def throughput(tokens: Column, first_ms: Column, last_ms: Column) -> Column:
    """Tokens a second; null for spans under 100 ms or unknown."""
    span = last_ms - first_ms
    return F.when(span >= 100, F.try_divide(tokens * 1000.0, span))


def safe_number(x: Column) -> Column:
    """A finite double, else 0."""
    d = x.try_cast("double")
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), 0.0).otherwise(d)


def safe_bool(x: Column) -> Column:
    return F.when(x == "true", True).when(x == "false", False)


def sum_of_known(*parts: Column) -> Column:
    """The sum of those that are not null; null if all are."""
    known = reduce(lambda a, b: a | b, [p.isNotNull() for p in parts])
    return F.when(known, reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0)) for p in parts]))


#: Where four kinds of provider report usage (anthropic, google, openai, compatible): input, output, reasoning, cache reads, short and long cache writes; first path found counts.
USAGE_PATHS = {
    "anthropic": (("input_tokens",), ("output_tokens",), (), ("cache_read_input_tokens",), ("cache_creation.ephemeral_5m_input_tokens", "cache_creation_input_tokens"), ("cache_creation.ephemeral_1h_input_tokens",)),
    "google": (("promptTokenCount",), ("candidatesTokenCount",), ("thoughtsTokenCount",), ("cachedContentTokenCount",), (), ()),
    "openai": (("input_tokens",), ("output_tokens",), ("output_tokens_details.reasoning_tokens",), ("input_tokens_details.cached_tokens",), (), ()),
    "compatible": (("prompt_tokens",), ("completion_tokens",), ("completion_tokens_details.reasoning_tokens",), ("cached_tokens", "prompt_tokens_details.cached_tokens"), ("prompt_tokens_details.cache_creation_input_tokens",), ()),
}
USAGE_FIELDS = ("input", "output", "reasoning", "cache_read", "cache_write_5m", "cache_write_1h")


def _usage_schema() -> str:
    """The type that holds every path of ``USAGE_PATHS``."""
    tree: dict = {}
    for path in (p for kind in USAGE_PATHS.values() for each in kind for p in each):
        at = tree
        *above, last = path.split(".")
        for name in above:
            at = at.setdefault(name, {})
        at[last] = None
    kind = lambda t: "struct<" + ",".join(f"{k}:{'bigint' if v is None else kind(v)}" for k, v in t.items()) + ">"
    return kind(tree)


def normal_usage(kind: Column, body: Column, estimate_cache: bool = False) -> Column:
    """A struct of ``USAGE_FIELDS`` from a provider's report; fields that a kind lacks are null.

    Cached tokens are taken out of the input where they are part of it (all kinds but the first).  With
    ``estimate_cache``, compatible reports without cache reads count nine tenths of the input as such.
    """
    null = F.lit(None).cast("long")

    def row(name: str, report: Column) -> Column:
        total, output, reasoning, cached, short, long = (F.coalesce(null, *[reduce(lambda at, f: at[f], p.split("."), report) for p in each]) for each in USAGE_PATHS[name])
        total, output = F.coalesce(total, F.lit(0)), F.coalesce(output, F.lit(0))
        if name == "google":
            reasoning, cached = F.coalesce(reasoning, F.lit(0)), F.coalesce(cached, F.lit(0))
        if name == "compatible" and estimate_cache:
            cached = F.when(F.coalesce(cached, F.lit(0)) == 0, F.floor(total * 0.9).cast("long")).otherwise(cached)
        fresh = total if name == "anthropic" else total - F.coalesce(cached, F.lit(0))
        return F.struct(*[c.cast("long").alias(f) for f, c in zip(USAGE_FIELDS, (fresh, output, reasoning, cached, short, long), strict=True)])

    def pick(both: Column) -> Column:
        out = F.lit(None).cast("struct<" + ",".join(f"{f}:bigint" for f in USAGE_FIELDS) + ">")
        for name in USAGE_PATHS:
            out = F.when(both["kind"] == name, row(name, both["report"])).otherwise(out)
        return out

    read = F.struct(kind.alias("kind"), F.from_json(body, _usage_schema()).alias("report"))
    return F.element_at(F.transform(F.array(read), pick), 1)  # so that a report is parsed once


def sum_usage(*usages: Column) -> Column:
    """Usage structs added field by field; a field is null only where it is null in all."""
    return F.struct(*[sum_of_known(*[u[f] for u in usages]).alias(f) for f in USAGE_FIELDS])


def merged_maps(*maps: Column) -> Column:
    """One map of all entries, later maps winning; a null map has none."""
    nothing = F.create_map().cast("map<string,string>")

    def merged(a: Column, b: Column) -> Column:
        a, b = F.coalesce(a, nothing), F.coalesce(b, nothing)
        return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)

    return reduce(merged, maps)


def quoted_identifier(x: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))


def quoted_literal(x: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'"))


def title_case(x: Column) -> Column:
    """The first letter of every word in upper case, the others as they are."""
    words = F.regexp_extract_all(x, F.lit(r"(\w+|\W+)"), F.lit(1))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), "")


def insert_place(sorted_values: Column, x: Column) -> Column:
    """The place (from 0) at which ``x`` goes into an ascending array, before equal values."""
    return F.size(F.filter(sorted_values, lambda v: v < x))


def chunked(values: Column, size: int) -> Column:
    """An array cut into arrays of ``size`` elements."""
    starts = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), F.lit(size)))
    return F.coalesce(F.transform(starts, lambda s: F.slice(values, s, size)), F.array().cast("array<array<string>>"))


def dollars_to_microcents(x: Column) -> Column:
    return F.floor(x * MICROCENTS + 0.5).cast("long")


def card_fee(cents: Column) -> Column:
    """The fee that leaves ``cents`` after 4.4 per cent and 30 cents."""
    return F.floor((cents + 30) / 0.956 * 0.044 + 30 + 0.5).cast("long")


def tier_price(tokens: Column, context: Column, base, tiers: list[tuple[int, float]]) -> Column:
    """Dollars for ``tokens`` at the price (per million) of the highest tier that the context exceeds."""
    price = F.lit(base).cast("decimal(18,8)")
    for size, p in sorted(tiers):
        price = F.when(context > size, F.lit(p).cast("decimal(18,8)")).otherwise(price)
    return tokens.cast("decimal(18,0)") * price / F.lit(1_000_000)


def country(x: Column) -> Column:
    """Two letters in upper case, else ZZ."""
    return F.when(F.length(x) == 2, F.upper(x)).otherwise("ZZ")


def ip_prefix(ip: Column) -> Column:
    """An IPv4 address as /32, an IPv6 address as its /64 network; null for others."""
    parts = F.split(ip, "::", 2)
    section = lambda i: F.when(F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(F.try_element_at(parts, F.lit(i)), ":"))
    head, tail = section(1), section(2)
    missing = F.lit(8) - F.size(head) - F.size(tail)
    full = F.concat(head, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), tail)
    net = F.concat(F.concat_ws(":", F.transform(F.slice(full, 1, 4), lambda p: F.regexp_replace(F.lower(p), r"^0+(?=.)", ""))), F.lit("::/64"))
    return F.when(ip.contains(".") & ~ip.contains(":"), F.concat(ip, F.lit("/32"))).when(ip.contains(":") & (missing >= 0) & (F.size(full) == 8), net)


def token_estimate(text: Column) -> Column:
    """A quarter of the length in UTF-16 units, rounded half up."""
    t = F.coalesce(text, F.lit(""))
    return F.floor((F.length(t) + F.regexp_count(t, F.lit(r"[\x{10000}-\x{10FFFF}]"))) / 4 + 0.5).cast("long")


def base64url(x: Column) -> Column:
    return F.regexp_replace(F.translate(F.base64(x), "+/", "-_"), "[=\\s]", "")


def unbase64url(x: Column) -> Column:
    return F.unbase64(F.translate(x, "-_", "+/"))


def cursor(time: Column, ident: Column) -> Column:
    return base64url(F.to_json(F.struct(ident.alias("id"), time.alias("time"))).cast("binary"))


def string_hash(x: Column, last: int = 4) -> Column:
    """The 31-multiplier hash of the last characters, as an unsigned 32-bit number."""
    codes = F.transform(F.filter(F.split(F.substring(x, -last, last), ""), lambda c: c != ""), F.ascii)
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c) % F.lit(1 << 32))


def fnv1a(x: Column) -> Column:
    """32-bit FNV-1a over code points, in base 36; null for empty text."""
    codes = F.transform(F.filter(F.split(x, ""), lambda c: c != ""), F.ascii)
    h = F.aggregate(codes, F.lit(0x811C9DC5).cast("long"), lambda a, c: (a.bitwiseXOR(c.cast("long")) * F.lit(0x01000193).cast("long")) % F.lit(1 << 32))
    return F.when(F.coalesce(F.length(x), F.lit(0)) > 0, F.lower(F.conv(h.cast("string"), 10, 36)))


def sampled_checksum(x: Column, limit: int = 500_000, size: int = 4096) -> Column:
    """:func:`fnv1a` of the text, or of five samples of a text over ``limit`` characters."""
    n = F.length(x)
    points = [F.lit(0), F.floor(n * 0.25), F.floor(n * 0.5), F.floor(n * 0.75), n - size]
    starts = [F.greatest(F.lit(0), F.least(n - size, p - size // 2)).cast("int") for p in points]
    parts = [F.coalesce(fnv1a(F.substr(x, s + 1, F.lit(size))), F.lit("")) for s in starts]
    return F.when(n <= limit, fnv1a(x)).otherwise(F.concat_ws(":", n.cast("string"), *parts))


def like_contains(x: Column, term: str) -> Column:
    return x.ilike(f"%{term}%")


def under_path(path: Column, directory: Column, root: str) -> Column:
    """The path is the root or below it; rows without a path go by their directory."""
    return (path == root) | path.startswith(root.rstrip("/") + "/") | (path.isNull() & (directory == root))


def usage_status(usage: Column, limit: Column, updated: Column, start: Column, end: Column, now: Column, stale_reset: Column) -> Column:
    """(status, reset_s, percent) of a usage window; usage last updated before its start counts as none."""
    left = F.ceil((F.unix_millis(end) - F.unix_millis(now)) / 1000).cast("long")
    row = lambda s, r, p: F.struct(F.lit(s).alias("status"), r.cast("long").alias("reset_s"), p.cast("long").alias("percent"))
    return F.when(updated < start, row("ok", stale_reset, F.lit(0))).when(usage < limit, row("ok", left, F.floor(F.least(F.lit(100.0), usage * 100 / limit)))).otherwise(row("rate-limited", left, F.lit(100)))


def rolling_status(usage: Column, limit: Column, updated: Column, hours: int, now: Column) -> Column:
    width = F.make_dt_interval(hours=F.lit(hours))
    return usage_status(usage, limit, updated, now - width, updated + width, now, F.lit(hours * 3600))


def weekly_status(usage: Column, limit: Column, updated: Column, now: Column) -> Column:
    start = F.date_trunc("week", now)
    end = start + F.make_dt_interval(days=F.lit(7))
    return usage_status(usage, limit, updated, start, end, now, F.ceil((F.unix_millis(end) - F.unix_millis(now)) / 1000))


def monthly_status(usage: Column, limit: Column, updated: Column, anchor: Column, now: Column) -> Column:
    start, end = anchored_month(now, anchor)
    return usage_status(usage, limit, updated, start, end, now, F.ceil((F.unix_millis(end) - F.unix_millis(now)) / 1000))
