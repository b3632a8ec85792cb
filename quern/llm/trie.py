"""Prefix trie of conversations: which sequences of turns are shared, by how many, and what sharing them would save.

1. :func:`numbered` gives every turn its place: rows are sorted over ranges of (conversation, turn, role, text), so
   that one long conversation is spread over many tasks; each task numbers its rows, and what lies in earlier ranges is
   added from one row per range.
2. :func:`build` hashes each turn to 64 bits and scans the hashes of a conversation into polynomial prefix
   fingerprints (numpy, modulo 2**64).  A scan covers ``CHUNK`` places; a longer conversation's later chunks begin with
   the sum of those before, as prefix sums of a polynomial add up.
3. Turns with one depth and fingerprint are a candidate group; its representative is its least conversation.  The
   group is verified turn by turn: role and text must be the representative's at this depth, and by induction at every
   lesser one, whose groups are verified alike.  Where a group holds several contents, each gets a hash of its own, and
   the scan is repeated until no group is mixed; so the result is exact whatever the hash.
4. The nodes of one representative form a vertical path.  Totals of subtrees come from the tree of paths by pointer
   doubling, as many rounds as the logarithm of its height, and within a path by sums from its end.

Null roles and texts are empty, and equal to empty ones.  Rows without a conversation take no part.  Turns that tie are
ordered by role and text; a turn that is repeated counts as often as it is there.  Other columns are not looked at.  An
empty table has no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import store
from quern.llm.arrow import column

U = np.uint64
#: Places of a conversation that one scan, or one sum along a path, covers.
CHUNK = 4096
#: Conversation ids (2**SLOT of them) whose decimal forms are joined as one string.
SLOT = 16
#: Bits of a turn's hash that are used; fewer make collisions, which tests do.
HASH_BITS = 64
BASE = U(0x9E3779B97F4A7C15)
_LOW = np.concatenate([np.ones(1, U), np.cumprod(np.full((1 << 16) - 1, BASE))])
_HIGH = np.concatenate([np.ones(1, U), np.cumprod(np.repeat(_LOW[-1:] * BASE, (1 << 16) - 1))])


def power(n: np.ndarray) -> np.ndarray:
    """BASE**n modulo 2**64 for 0 <= n < 2**32."""
    return _LOW[n & 0xFFFF] * _HIGH[n >> 16]


def _runs(same: np.ndarray) -> np.ndarray:
    """For each row the index of the row at which its run began."""
    at = np.arange(len(same))
    return np.maximum.accumulate(np.where(same, 0, at))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``place``, the number of a conversation's rows before this one in the task."""
    last, seen = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = column(batch, "conv_id").to_numpy()
        same = np.concatenate([[conv[0] == last], conv[1:] == conv[:-1]])
        began = _runs(same)
        place = np.arange(len(conv)) - began
        if same[0]:
            place[began == 0] += seen
        last, seen = conv[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], names=[*batch.schema.names, "place"])


def numbered(turns: DataFrame, ident: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", owner: str = "") -> DataFrame:
    """(conv_id, place, role, text): each conversation's turns with their places from 0, by ``order`` (null first), role and text."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = turns.filter(F.col(ident).isNotNull()).select(F.col(ident).cast("long").alias("conv_id"), F.col(order).alias("turn"), plain(role).alias("role"), plain(text).alias("text"))
    by = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).select("conv_id", "role", "text", F.spark_partition_id().alias("part"))
    rows = store.table(rows.mapInArrow(_places, "conv_id long, role string, text string, part int, place long"), "turns", owner)
    ends = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("conv_id", "part", F.sum("n").over(before).alias("more")).filter("more is not null")
    # only a range's first conversation can have begun in an earlier one: one row per range
    return rows.join(F.broadcast(carried), ["conv_id", "part"], "left").select("conv_id", (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"), "role", "text")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Depths and fingerprints of rows sorted by (conv_id, place, turn); a row that is no turn holds what came before its chunk."""
    last, count, total = None, 0, U(0)
    for batch in batches:
        if not batch.num_rows:
            continue
        conv, t = column(batch, "conv_id").to_numpy(), column(batch, "t").to_numpy().view(U)
        carried = column(batch, "carried").to_numpy(zero_copy_only=False)
        turn = column(batch, "is_turn").to_numpy(zero_copy_only=False)
        same = np.concatenate([[conv[0] == last], conv[1:] == conv[:-1]]) & turn
        began = _runs(same)
        opens = ~turn[began]
        depth = np.arange(len(conv)) - began + np.where(opens, np.nan_to_num(carried[began]), 1).astype(np.int64)
        start = np.where(opens, t[began], U(0))
        if same[0]:
            depth[began == 0] += count
            start[began == 0] = total
        term = np.where(turn, t * power(depth), U(0))
        sums = np.cumsum(term)
        fp = start + sums - (sums[began] - term[began])
        last, count, total = conv[-1], int(depth[-1]), fp[-1]
        long = lambda x: pa.array(x.astype(U).view(np.int64))
        out = pa.RecordBatch.from_arrays([column(batch, c) for c in ("conv_id", "place", "role", "text", "t")] + [pa.array(depth), long(fp), long(fp - term)], names=["conv_id", "place", "role", "text", "t", "depth", "fp", "prev"])
        yield out.filter(pa.array(turn))


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its chunks' sums, in order: what lies before each later chunk."""
    last, count, total = None, 0, U(0)
    for batch in batches:
        out = []
        for conv, chunk, n, fp in zip(*(column(batch, c).to_pylist() for c in ("conv_id", "chunk", "n", "fp")), strict=True):
            if conv != last:
                last, count, total = conv, 0, U(0)
            out.append((conv, chunk, count, total))
            with np.errstate(over="ignore"):
                total += U(fp % (1 << 64)) * power(np.array([count]))[0]
            count += n
        cols = [[r[i] for r in out] for i in range(3)]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(np.array([r[3] for r in out], U).view(np.int64))], names=["conv_id", "chunk", "n", "t"])


SCANNED = "conv_id long, place long, role string, text string, t long, depth long, fp long, prev long"


def _fingerprints(turns: DataFrame, label: str, owner: str) -> DataFrame:
    """``turns`` (conv_id, place, role, text, t) with depth, prefix fingerprint, and the fingerprint before the turn."""
    rows = turns.select("*", F.floor(F.col("place") / CHUNK).alias("chunk"), F.lit(None).cast("double").alias("carried"), F.lit(True).alias("is_turn"))
    sorted_ = lambda df: df.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "place", "is_turn").mapInArrow(_scan, SCANNED)
    long = store.table(rows.filter("chunk > 0").select("conv_id").distinct(), f"{label}-long", owner)
    if not long.isEmpty():
        alone = rows.join(long, "conv_id").select(rows.columns)
        # each chunk by itself: a row in front makes the scan begin anew
        opening = alone.select("conv_id", "chunk").distinct().select("conv_id", (F.col("chunk") * CHUNK).alias("place"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("t"), "chunk", F.lit(0.0).alias("carried"), F.lit(False).alias("is_turn"))
        sums = sorted_(alone.withColumns({"role": F.lit(""), "text": F.lit("")}).unionByName(opening)).groupBy("conv_id", F.floor(F.col("place") / CHUNK).alias("chunk")).agg(F.max("depth").alias("n"), F.max_by("fp", "depth").alias("fp"))
        carry = sums.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(_totals, "conv_id long, chunk long, n long, t long")
        rows = rows.unionByName(carry.filter("chunk > 0").select("conv_id", (F.col("chunk") * CHUNK).alias("place"), F.lit("").alias("role"), F.lit("").alias("text"), "t", "chunk", F.col("n").cast("double").alias("carried"), F.lit(False).alias("is_turn")))
    return store.table(sorted_(rows), label, owner)


def _verified(turns: DataFrame, owner: str) -> tuple[DataFrame, DataFrame]:
    """(scanned turns, nodes below the root): no node holds two contents."""
    hashed = F.xxhash64("role", "text")
    turns = turns.withColumn("t", hashed if HASH_BITS == 64 else hashed.bitwiseAND((1 << HASH_BITS) - 1))
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    step = 0
    while True:
        scanned = _fingerprints(turns, f"scan-{step}", owner)
        contents = scanned.groupBy("depth", "fp", "t", "role", "text").agg(F.min("conv_id").alias("first"), F.count("*").alias("n"), F.first("prev").alias("prev"))
        contents = contents.select("depth", "fp", "first", "n", "prev", words.alias("words"))
        nodes = contents.groupBy("depth", "fp").agg(F.min("first").alias("conv_id"), F.sum("n").alias("n"), F.min("prev").alias("prev"), F.max("words").alias("words"), F.count("*").alias("kinds"))
        nodes = store.table(nodes, f"nodes-{step}", owner)
        mixed = nodes.filter("kinds > 1").select("depth", "fp")
        if mixed.isEmpty():
            return scanned, nodes
        # each content of a mixed group gets a hash of its own, made from the least conversation that holds it
        own = Window.partitionBy("depth", "fp", "t", "role", "text")
        other = scanned.join(mixed, ["depth", "fp"]).select("conv_id", "place", F.xxhash64("depth", "fp", F.min("conv_id").over(own), F.lit(step)).alias("other"))
        turns = scanned.join(other, ["conv_id", "place"], "left").select("conv_id", "place", "role", "text", F.coalesce("other", "t").alias("t"))
        step += 1


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's strings, which come in order; only the digest's state is held."""
    key, state, done = None, None, []
    for batch in batches:
        for depth, fp, ids in zip(*(column(batch, c).to_pylist() for c in ("depth", "fp", "ids")), strict=True):
            if (depth, fp) == key:
                state.update(b",")
            else:
                if key:
                    done.append((*key, state.hexdigest()))
                key, state = (depth, fp), hashlib.sha256()
            state.update(ids.encode())
        if len(done) >= 10_000:
            yield _rows(done)
            done = []
    if key:
        done.append((*key, state.hexdigest()))
    if done:
        yield _rows(done)


def _rows(done: list[tuple[int, int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in done], pa.int64()), pa.array([r[1] for r in done], pa.int64()), pa.array([r[2] for r in done])], names=["depth", "fp", "ends_sha256"])


def _ends(scanned: DataFrame, ids: DataFrame) -> DataFrame:
    """(depth, fp, ends_sha256) of the nodes at which conversations end."""
    last = scanned.groupBy("conv_id").agg(F.max("depth").alias("depth"), F.max_by("fp", "depth").alias("fp"))
    last = ids.join(last, "conv_id", "left").select("conv_id", F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("fp", F.lit(0)).alias("fp"))
    # ids are distinct, so a slot holds 2**SLOT of them at most
    slots = last.groupBy("depth", "fp", F.shiftright("conv_id", SLOT).alias("slot")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    slots = slots.select("depth", "fp", "slot", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))
    return slots.repartition("depth", "fp").sortWithinPartitions("depth", "fp", "slot").mapInArrow(_digests, "depth long, fp long, ends_sha256 string")


def _path_totals(paths: DataFrame, root: int, owner: str) -> DataFrame:
    """(conv_id, saved, leaves) over each path and all that hang from it, by pointer doubling over ``paths`` (conv_id, up, saved, leaves).

    After k rounds a path holds the sums of what lies less than 2**k paths below it, and points 2**k paths up.
    """
    state = store.table(paths, "paths-0", owner)
    step = 0
    while not state.filter("up is not null").isEmpty():
        step += 1
        below = state.filter("up is not null").groupBy(F.col("up").alias("conv_id")).agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
        above = state.select(F.col("conv_id").alias("up"), F.col("up").alias("next"))
        jump = state.filter(F.col("up") != root).select("conv_id", "up").join(above, "up").select("conv_id", "next")
        total = lambda c: (F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c)
        state = state.join(below, "conv_id", "left").join(jump, "conv_id", "left").select("conv_id", F.col("next").alias("up"), total("saved"), total("leaves"))
        state = store.table(state, f"paths-{step}", owner)
    return state.select("conv_id", "saved", "leaves")


def _from_the_end(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """``sums`` of every node over its path from there downwards; paths are cut into chunks, each of which is added up by itself."""
    nodes = nodes.withColumn("chunk", F.floor(F.col("depth") / CHUNK))
    inside = Window.partitionBy("conv_id", "chunk").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("conv_id").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    whole = nodes.groupBy("conv_id", "chunk").agg(*[F.sum(c).alias(c) for c in sums])
    later = whole.select("conv_id", "chunk", *[F.sum(c).over(after).alias(f"later_{c}") for c in sums]).filter(f"later_{sums[0]} is not null")
    nodes = nodes.withColumns({c: F.sum(c).over(inside) for c in sums}).join(later, ["conv_id", "chunk"], "left")
    return nodes.withColumns({c: F.col(c) + F.coalesce(f"later_{c}", F.lit(0)) for c in sums})


NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def build(turns: DataFrame, ids: DataFrame, owner: str = "") -> DataFrame:
    """One row per node of the trie of ``turns`` (conv_id, place, role, text) and of the conversations ``ids`` (conv_id; those without a turn too).

    Places order a conversation's turns; they are distinct and begin at 0 or soon after.  A node is named by its least
    member ``conv_id`` and its ``depth``; see :data:`NODES`.
    """
    spark = turns.sparkSession
    ids = store.table(ids.select(F.col("conv_id").cast("long").alias("conv_id")).filter("conv_id is not null").distinct(), "ids", owner)
    root, total = ids.agg(F.min("conv_id"), F.count("*")).first()
    if not total:
        return spark.createDataFrame([], NODES)
    scanned, nodes = _verified(turns.select("conv_id", "place", "role", "text"), owner)
    kids = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("prev").alias("fp")).agg(F.count("*").alias("n_children"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("fp").alias("prev"), F.col("conv_id").alias("parent_conv_id"))
    first = nodes.filter("depth = 1").withColumn("parent_conv_id", F.lit(root).cast("long"))
    named = nodes.filter("depth > 1").join(above, ["depth", "prev"]).unionByName(first)
    start = spark.range(1).select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("fp"), F.lit(root).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(total).cast("long").alias("n"), F.lit(0).cast("long").alias("words"))
    named = named.select(start.columns).unionByName(start)
    named = named.join(kids, ["depth", "fp"], "left").join(_ends(scanned, ids), ["depth", "fp"], "left")
    named = named.withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "saved": (F.col("n") - 1) * F.col("words"), "ends_sha256": F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest()))})
    named = store.table(named.withColumn("leaves", (F.col("n_children") == 0).cast("long")).drop("fp", "words"), "named", owner)

    paths = named.groupBy("conv_id").agg(F.min("depth").alias("top"), F.min_by("parent_conv_id", "depth").alias("up"), F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    paths = store.table(paths, "paths", owner)
    whole = _path_totals(paths.select("conv_id", "up", "saved", "leaves"), root, owner)
    hung = paths.filter("up is not null").select("conv_id", "up", "top").join(whole, "conv_id").groupBy(F.col("up").alias("conv_id"), (F.col("top") - 1).alias("depth")).agg(F.sum("saved").alias("hung_saved"), F.sum("leaves").alias("hung_leaves"))
    joined = named.join(hung, ["conv_id", "depth"], "left").withColumns({c: F.col(c) + F.coalesce(f"hung_{c}", F.lit(0)) for c in ("saved", "leaves")})
    done = _from_the_end(joined, ["saved", "leaves"])
    return done.select("conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256")
