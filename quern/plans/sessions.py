"""Conversations and event logs: turns, budgets, compaction, replay, last write wins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import classify
from quern.operators import analytic, joins, log, messages
from quern.plans.registry import query
from quern.session import load
from quern.streaming import counters


def _talk(spark, d):
    return load(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("size"), "text")


T = "c AS (SELECT conv_id, turn, role, CAST(length(text) AS BIGINT) AS size, text FROM conversations)"


@query(f"WITH {T} SELECT conv_id, turn, CAST(count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS turn_no, CAST(min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS BIGINT) AS next_start FROM c")
def turn_segments(spark, d):
    return analytic.turns(_talk(spark, d), "conv_id", "turn", "role").select("conv_id", "turn", "turn_no", "next_start")


@query(f"""WITH {T}, w AS (SELECT *, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn DESC) AS turns FROM c),
s AS (SELECT *, max(CASE WHEN role = 'system' AND turns >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS stopped FROM w),
o AS (SELECT *, turns >= 2 AND stopped = 0 AND role = 'assistant' AS op FROM s),
t AS (SELECT *, sum(CASE WHEN op THEN size ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS total FROM o),
p AS (SELECT *, sum(size) OVER (PARTITION BY conv_id) AS pruned FROM t WHERE op AND total > 100)
SELECT conv_id, turn, size FROM p WHERE pruned > 50""")
def prune_reverse_cumsum(spark, d):
    rows = _talk(spark, d)
    return analytic.prune(rows, "conv_id", ["turn"], "role", "size", F.col("role") == "assistant", F.col("role") == "system", 100, 50).select("conv_id", "turn", "size")


@query(f"""WITH {T}, a AS (SELECT *, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS no FROM c),
u AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY no DESC, turn DESC) AS upto FROM a), e AS (SELECT *, max(upto) OVER (PARTITION BY conv_id, no) AS fin FROM u),
f AS (SELECT *, max(CASE WHEN fin > 600 THEN no END) OVER (PARTITION BY conv_id) AS first_out FROM e)
SELECT conv_id, turn FROM f WHERE fin <= 600 OR (no = first_out AND upto <= 600)""")
def tail_within_budget(spark, d):
    rows = _talk(spark, d).withColumn("no", F.count_if(F.col("role") == "user").over(Window.partitionBy("conv_id").orderBy("turn")))
    return analytic.tail_within(rows, "conv_id", "no", "turn", "size", 600).select("conv_id", "turn")


@query(f"WITH {T}, l AS (SELECT conv_id, max(turn) AS t FROM c WHERE role = 'user' GROUP BY conv_id) SELECT c.conv_id, turn FROM c LEFT JOIN l ON l.conv_id = c.conv_id WHERE t IS NULL OR turn >= t")
def since_last_marker(spark, d):
    return analytic.since_last(_talk(spark, d), "conv_id", ["turn"], F.col("role") == "user").select("conv_id", "turn")


@query(f"WITH {T}, r AS (SELECT *, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS new FROM c), n AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM r) SELECT conv_id, CAST(run AS BIGINT) AS run, role, string_agg(text, '' ORDER BY turn) AS text FROM n GROUP BY conv_id, run, role")
def merged_runs(spark, d):
    return analytic.merge_runs(_talk(spark, d), "conv_id", "turn", ["role"], "text").select("conv_id", "run", "role", "text")


@query(f"WITH {T} SELECT conv_id, turn, role = 'assistant' AND row_number() OVER (PARTITION BY conv_id, role = 'assistant' ORDER BY turn DESC) <= 2 AS marked FROM c")
def last_k_marked(spark, d):
    return analytic.last_k(_talk(spark, d), "conv_id", "turn", 2, F.col("role") == "assistant").select("conv_id", "turn", "marked")


@query("SELECT conv_id, turn AS seq, CAST(before + 1 AS BIGINT) AS expected FROM (SELECT conv_id, turn, lag(turn, 1, -1) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WHERE (conv_id + turn) % 5 <> 0) WHERE turn <> before + 1")
def replay_gap_check(spark, d):
    rows = load(spark, d, "conversations").filter("(conv_id + turn) % 5 <> 0").select("conv_id", F.col("turn").alias("seq"))
    return log.gaps(rows, "conv_id", "seq")


@query("""WITH l AS (SELECT conv_id, max(turn) AS latest FROM conversations WHERE turn < 3 GROUP BY conv_id), i AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE turn >= 2 AND (turn <> 4 OR conv_id % 2 = 0)),
m AS (SELECT i.conv_id, turn, coalesce(latest, -1) AS latest FROM i LEFT JOIN l ON l.conv_id = i.conv_id), p AS (SELECT *, sum(CASE WHEN turn > latest THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM m)
SELECT conv_id, turn, CASE WHEN turn <= latest THEN 'seen' WHEN turn = latest + place THEN 'append' ELSE 'gap' END AS verdict FROM p""")
def ordered_append(spark, d):
    c = load(spark, d, "conversations").select("conv_id", "turn")
    return log.appendable(c.filter("turn < 3"), c.filter("turn >= 2 and (turn <> 4 or conv_id % 2 = 0)"), "conv_id", "turn").select("conv_id", "turn", "verdict")


@query("SELECT c.conv_id, turn FROM conversations c LEFT JOIN (SELECT conv_id, conv_id % 4 AS seen FROM conversations WHERE conv_id % 3 = 0 GROUP BY conv_id) k ON k.conv_id = c.conv_id WHERE seen IS NULL OR turn > seen")
def vector_clock_exclude(spark, d):
    c = load(spark, d, "conversations").select("conv_id", "turn")
    clock = c.filter("conv_id % 3 = 0").select("conv_id", (F.col("conv_id") % 4).alias("turn")).distinct()
    return joins.after_clock(c, clock, "conv_id", "turn")


@query("WITH s AS (SELECT 0 AS gen, conv_id, turn, role FROM conversations WHERE turn % 2 = 0 UNION ALL SELECT 1, conv_id, turn, role FROM conversations WHERE turn % 2 = 1) SELECT conv_id, turn, role FROM s QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY gen DESC, turn DESC) = 1")
def lww_merge(spark, d):
    c = load(spark, d, "conversations").select("conv_id", "turn", "role")
    return log.last_write_wins(c.filter("turn % 2 = 0"), c.filter("turn % 2 = 1"), "conv_id", "turn")


@query("WITH s AS (SELECT 0 AS gen, conv_id, turn, role FROM conversations WHERE turn <= 1 UNION ALL SELECT 1, conv_id, turn, role FROM conversations WHERE turn > 2) SELECT conv_id, turn, role FROM s QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY gen DESC, turn DESC) = 1")
def incremental_compaction(spark, d):
    c = load(spark, d, "conversations").select("conv_id", "turn", "role")
    return log.compact(c.filter("turn <= 1"), c, "conv_id", "turn", 2)[0]


@query("WITH v AS (SELECT conv_id AS grp, conv_id * 100 + turn // 2 AS part, turn AS seq, CASE WHEN role = 'system' THEN 0 ELSE length(text) END AS amount FROM conversations), l AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY part ORDER BY seq DESC, amount DESC) = 1) SELECT grp, CAST(sum(amount) AS BIGINT) AS amount FROM l GROUP BY grp")
def signed_delta_log(spark, d):
    c = load(spark, d, "conversations").select(F.col("conv_id").alias("grp"), F.expr("conv_id * 100 + turn div 2").alias("part"), (F.col("turn") * 1_000_000 + F.when(F.col("role") == "system", 0).otherwise(F.length("text"))).alias("seq"), (F.col("role") == "system").alias("removed"), F.length("text").cast("long").alias("amount"))
    return log.signed_totals(c, "part", "seq", "removed", "grp", ["amount"])


@query("WITH s AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'updated' ELSE 'delta' END AS kind FROM conversations), m AS (SELECT *, count(*) FILTER (kind = 'updated') OVER (PARTITION BY conv_id) AS n, max(CASE WHEN kind = 'updated' THEN turn END) OVER (PARTITION BY conv_id) AS last FROM s) SELECT conv_id, turn, kind FROM m WHERE (kind <> 'updated' OR turn = last) AND (kind <> 'delta' OR n < 2)")
def coalesced_queue(spark, d):
    c = load(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", "updated").otherwise("delta").alias("kind"))
    return counters.coalesced(c, "conv_id", "turn", "kind")


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def debounced_last(spark, d):
    return counters.debounced(load(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn")


@query("SELECT conv_id, CASE WHEN role LIKE 'a%' AND turn >= 4 THEN 'allow' WHEN role = 'user' THEN 'deny' ELSE 'ask' END AS action, turn FROM conversations")
def rule_last_match(spark, d):
    c = load(spark, d, "conversations")
    action = classify.last_match(F.col("role"), F.col("turn").cast("string"), [("user", "*", "deny"), ("a*", "4 *", "allow"), ("a*", "5", "allow"), ("a*", "6", "allow"), ("a*", "7", "allow"), ("a*", "8*", "allow"), ("a*", "9*", "allow"), ("a*", "1?", "allow")])
    return c.select("conv_id", "turn", action.alias("action"))


@query("WITH r AS (SELECT *, coalesce(max(CASE WHEN role = 'system' THEN turn END) OVER (PARTITION BY conv_id), -1) AS reset FROM conversations) SELECT conv_id, CAST(count(*) AS BIGINT) AS messages, CAST(sum(length(text)) AS BIGINT) AS letters, min_by(role, turn) AS first, max_by(role, turn) AS last, CAST(count(*) FILTER (role = 'user') AS BIGINT) AS asked FROM r WHERE turn > reset GROUP BY conv_id")
def projected_sessions(spark, d):
    """A fold in which order counts: a system message deletes what was there, the first and the last role are kept."""
    c = load(spark, d, "conversations").select("conv_id", "turn", "role", F.to_json(F.struct(F.length("text").alias("n"), "role")).alias("data"))

    def add(state, data):
        old = state or {"messages": 0, "letters": 0, "first": data["role"], "asked": 0}
        return {**old, "messages": old["messages"] + 1, "letters": old["letters"] + data.get("n", 0), "last": data["role"], "asked": old["asked"] + (data["role"] == "user")}

    handlers = {"user": add, "assistant": add, "tool": add, "system": lambda state, data: None}
    return log.project(c, "conv_id", "turn", "role", "data", handlers, "conv_id long, messages long, letters long, first string, last string, asked long")


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS raw FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'assistant') GROUP BY conv_id")
def fragments_joined(spark, d):
    c = load(spark, d, "conversations").select("conv_id", "turn", "text", (F.col("role") == "assistant").alias("done"))
    return log.fragments(c, "conv_id", "turn", "text", "done", "a string").select("conv_id", "raw")


def step_events(spark, d):
    """Every assistant turn as a step with text that comes in two parts, and a tool call that succeeds or fails; every other turn as a prompt."""
    c = load(spark, d, "conversations")
    at, assistant = F.col("turn") * 10, F.col("role") == "assistant"
    event = lambda no, kind, **fields: F.struct((at + no).alias("seq"), F.lit(f"session.next.{kind}").alias("kind"), F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()], (at + no).alias("timestamp"))).alias("data"))
    half = F.floor(F.length("text") / 2).cast("int")
    call, first, rest = F.concat(F.lit("c"), F.col("turn").cast("string")), F.substring("text", 1, 1 << 30).substr(F.lit(1), half), F.col("text").substr(half + 1, F.length("text"))
    step = [
        event(0, "step.started", agent=F.lit("a")), event(1, "text.started"), event(2, "text.delta", delta=first), event(3, "text.delta", delta=rest),
        event(4, "tool.input.started", callID=call, name=F.lit("grep")), event(5, "tool.input.delta", callID=call, delta=F.lit("{}")), event(6, "tool.called", callID=call, input=F.lit("x")),
        event(8, "retried"), event(9, "step.ended", finish=F.lit("stop"), cost=F.lit(1)),
    ]
    done = F.when(F.col("turn") % 4 == 1, event(7, "tool.success", callID=call)).otherwise(event(7, "tool.failed", callID=call))
    prompt = F.array(event(0, "prompted", prompt=F.struct("text")))
    return c.select("conv_id", F.inline(F.when(assistant, F.concat(F.array(*step), F.array(done))).otherwise(prompt))).withColumn("id", F.concat_ws("-", "conv_id", "seq"))


def list_columns(lists, message):
    """The columns of a message list that have plain SQL, from its JSON column."""
    get = lambda p: F.get_json_object(message, p)
    return lists.select("session", "position", "type", F.coalesce(get("$.text"), get("$.content[0].text")).alias("text"), get("$.finish").alias("finish"), get("$.content[1].state.status").alias("tool"))


@query("SELECT CAST(conv_id AS VARCHAR) AS session, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS position, CASE role WHEN 'assistant' THEN 'assistant' ELSE 'user' END AS type, text, CASE WHEN role = 'assistant' THEN 'stop' END AS finish, CASE WHEN role = 'assistant' THEN CASE WHEN turn % 4 = 1 THEN 'completed' ELSE 'error' END END AS tool FROM conversations")
def message_lists(spark, d):
    """Message lists of steps and prompts, folded from their events."""
    return list_columns(messages.message_lists(step_events(spark, d), "conv_id", "seq", "id", "kind", "data"), "message")
