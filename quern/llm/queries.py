"""The thin ``opN_<name>`` queries over whole tables, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import codes, ctw, near, packing, piece, quality, rollup, simhash, sstable, store, substring, trie, urls, vafile
from quern.session import load


BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(load(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE)).drop("ids")


def op2_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts of all documents, deletes of every tenth, all languages but English revised to a second tokenizer; batches are sent twice."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    changed = ~F.col("lang").eqNullSafe("en") & F.coalesce(F.col("doc_id") % 10 != 3, F.lit(True))
    counted = store.table(rollup.count_tokens(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE), changed), "counts")
    none = [F.lit(None).cast("string").alias("old_version"), F.lit(None).cast("long").alias("old_tokens")]
    group, before = ["source", "lang"], [F.lit(BYTE_BPE).alias("version"), F.col("first_tokens").alias("tokens")]
    first = counted.select(F.lit("insert").alias("op"), *group, *before, *none)
    second = counted.filter("doc_id % 10 = 3").select(F.lit("delete").alias("op"), *group, *before, *none)
    third = counted.filter("second_tokens is not null").select(F.lit("revise").alias("op"), *group, F.lit(PIECE_BPE).alias("version"), F.col("second_tokens").alias("tokens"), F.lit(BYTE_BPE).alias("old_version"), F.col("first_tokens").alias("old_tokens"))
    ledger = store.new_path(spark, "ledger")
    for name, batch in (("1", first), ("2", second), ("2", second), ("3", third), ("1", first)):
        rollup.commit(batch, ledger, name)
    return rollup.totals(spark, ledger)


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = store.new_path(spark, "sst")
    shards = sstable.write(load(spark, sf_dir, "documents"), folder, public_tokenizers.path(BYTE_BPE))
    return sstable.scan(shards, folder)


def op4_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    scored = ctw.score(docs.withColumn("held_out", held_out), ~held_out, carry=("doc_id", "held_out"), scanned=True)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = near.classes(docs, "doc_id", "text", k=3, num=85, den=100)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.search(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(load(spark, sf_dir, "pages"))


def op8_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece.digests(load(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.digest(substring.find(docs, "text", 35), "text", "doc_id", 35)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    m = [F.col(f"m.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return quality.judge(docs, keep_text=False).select("doc.doc_id", *m, "base_failed", "kept")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, ids): each conversation c begins with the first h turns of conversation c - c % 20 and goes on after its own first h; h = crc32(c) % 4."""
    turns = store.table(trie.numbered(conversations), "numbered")
    ids = turns.select("conv_id").distinct()
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    heads = turns.filter("conv_id % 20 = 0 and place < 3").withColumnRenamed("conv_id", "base")
    borrowed = ids.withColumn("base", F.expr("conv_id - conv_id % 20")).join(heads, "base").filter(F.col("place") < h)
    return borrowed.select(turns.columns).unionByName(turns.filter(F.col("place") >= h)), ids


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.build(*rebuilt(load(spark, sf_dir, "conversations")))


def op12_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(load(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(load(spark, sf_dir, "embeddings")).drop("n_exact")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op5_near_duplicates": OP5_SQL, "op6_top_k": OP6_SQL, "op7_url_rules": OP7_SQL, "op9_substring_dedup": OP9_SQL, "op10_quality_rules": OP10_SQL, "op11_prefix_trie": OP11_SQL, "op13_vector_codes": OP13_SQL}


def _op10_sql() -> str:
    rates = {"symbol_pm": ("n_symbols", "word_chars"), "dup_line_pm": ("n_dup_lines", "n_lines"), "repeat_pm": ("n_repeat_words", "n_words"), "chars_pw": ("word_chars", "n_words")}
    rated = ", ".join(f"({a} * 1000) // greatest({b}, 1) AS {k}" for k, (a, b) in rates.items())
    long = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS metric, {k} AS v FROM rated WHERE NOT base_failed" for k in rates)
    B = lambda k: f"(r.{k} - r.{k} % CAST(pow(2, greatest(length(bin(r.{k})) - 7, 0)) AS BIGINT))"

    def limit(k: str, side: str) -> str:
        one = lambda level, same: f"(SELECT {side} FROM fence f WHERE f.level = {level} AND f.metric = '{k}'{same})"
        lang, source = " AND f.lang IS NOT DISTINCT FROM r.lang", " AND f.source IS NOT DISTINCT FROM r.source"
        return f"coalesce({one(2, lang + source)}, {one(1, lang)}, {one(0, '')})"

    bad = [f"coalesce({B(k)} > {limit(k, 'hi')}, false)" for k in rates] + [f"coalesce({B(k)} < {limit(k, 'lo')}, false)" for k in ("chars_pw",)]
    return f"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
g AS (
  SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
h AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM g),
p AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM h, (SELECT unnest(range(0, 3)) AS k) WHERE n > 1 GROUP BY doc_id),
m AS (
  SELECT w.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines
  FROM w LEFT JOIN p ON p.doc_id = w.doc_id),
rated AS (SELECT *, {rated}, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
long AS ({long}),
b AS (SELECT lang, source, metric, v - v % CAST(pow(2, greatest(length(bin(v)) - 7, 0)) AS BIGINT) AS bucket FROM long),
s AS (
  SELECT 2 AS level, lang, source, metric, bucket, count(*) AS n FROM b GROUP BY ALL
  UNION ALL SELECT 1, lang, NULL, metric, bucket, count(*) FROM b GROUP BY ALL
  UNION ALL SELECT 0, NULL, NULL, metric, bucket, count(*) FROM b GROUP BY ALL),
c AS (SELECT *, CASE metric WHEN 'symbol_pm' THEN 100 ELSE 5 END AS tail, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS cum, sum(n) OVER (PARTITION BY level, lang, source, metric) AS total FROM s),
q AS (
  SELECT level, lang, source, metric, min(bucket) FILTER (cum * 1000 >= total * tail) AS low, min(bucket) FILTER (cum * 2 >= total) AS mid,
         min(bucket) FILTER (cum * 1000 >= total * (1000 - tail)) AS high, max(total * tail) AS beyond
  FROM c GROUP BY ALL),
fence AS (SELECT level, lang, source, metric, low - (mid - low) // 2 AS lo, high + (high - mid) // 2 AS hi FROM q WHERE level = 0 OR beyond >= 3000)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({" OR ".join(bad)}) AS kept FROM rated r
"""


OP10_SQL = _op10_sql()

OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
      ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS shingle FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT pair.a, pair.b FROM pair JOIN n x ON x.doc_id = pair.a JOIN n y ON y.doc_id = pair.b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT a AS doc_id, b AS other FROM link UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.other)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m.low, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(m.low, w.doc_id)) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT doc_id, min(other) AS low FROM reach GROUP BY doc_id) m ON m.doc_id = w.doc_id
"""

OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""



def _op7_sql() -> str:
    """Aliases by recursion over all links.  Dots in a relative target's path, and entities but ``&amp;``, are left as they are: for these the tests have cases of their own."""
    host = lambda u: f"translate(regexp_extract(coalesce({u}, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = lambda u: f"regexp_extract(coalesce({u}, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    query = lambda u: f"regexp_extract(coalesce({u}, ''), '(?s)^.*?://[^/?#]*[^?#]*([?][^#]*)', 1)"
    address = lambda u: f"CASE WHEN {host(u)} <> '' THEN {host(u)} || regexp_replace({path(u)}, '/+$', '') || {query(u)} END"
    ordered = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda u, what: "CASE " + " ".join(f"WHEN ({host(u)} = '{h}' OR ends_with({host(u)}, '.{h}')) AND starts_with({path(u)}, '{p}') THEN '{h + p if what else v}'" for v, h, p in ordered) + " END"
    return f"""
WITH RECURSIVE tag AS (
  SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\\b[^>]*>')) AS tag FROM pages WHERE url IS NOT NULL),
named AS (
  SELECT url, replace(CASE
    WHEN regexp_matches(tag, '(?is)^<link') AND regexp_matches(tag, '(?is)\\brel\\s*=\\s*["'']?canonical\\b') THEN regexp_extract(tag, '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1)
    WHEN regexp_matches(tag, '(?is)^<meta') AND regexp_matches(tag, '(?is)http-equiv\\s*=\\s*["'']?refresh\\b') THEN regexp_extract(tag, '(?is)\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1)
    ELSE '' END, '&amp;', '&') AS t FROM tag),
link AS (
  SELECT url, CASE
    WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN t
    WHEN starts_with(t, '//') THEN regexp_extract(url, '^([^:/?#]+:)', 1) || t
    WHEN starts_with(t, '/') THEN regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) || t
    WHEN starts_with(t, '?') THEN regexp_extract(url, '^([^?#]*)', 1) || t
    WHEN starts_with(t, '#') THEN regexp_extract(url, '^([^#]*)', 1) || t
    ELSE regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) || coalesce(nullif(regexp_extract({path('url')}, '(?s)^(.*/)', 1), ''), '/') || t END AS t
  FROM named WHERE t <> ''),
edge AS (SELECT DISTINCT {address('url')} AS a, {address('t')} AS b FROM link WHERE regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://')),
pair AS (SELECT a, b FROM edge WHERE a <> b UNION SELECT b, a FROM edge WHERE a <> b),
reach AS (SELECT a AS node, a AS other FROM pair UNION SELECT reach.node, pair.b FROM reach JOIN pair ON pair.a = reach.other),
told AS (SELECT DISTINCT {address('u')} AS named, {fits('u', False)} AS v FROM (SELECT url AS u FROM pages UNION SELECT t FROM link) WHERE {fits('u', False)} IS NOT NULL),
alias AS (SELECT node, CASE WHEN bool_or(v = 'allow') THEN 'allow' ELSE 'block' END AS inherited FROM reach JOIN told ON told.named = reach.other GROUP BY node)
SELECT page_id, {host('url')} AS host, {path('url')} AS path, {fits('url', True)} AS rule, coalesce({fits('url', False)}, alias.inherited, 'allow') AS verdict
FROM pages LEFT JOIN alias ON alias.node = {address('url')}
"""


OP7_SQL = _op7_sql()

OP9_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(words) - 33)) AS i, words FROM w WHERE len(words) >= 35),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY array_to_string(words[i:i + 34], ' ')) AS n FROM p),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM k, (SELECT unnest(range(0, 35)) AS j) WHERE n > 1),
word AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM w),
kept AS (SELECT word.doc_id, string_agg(word, ' ' ORDER BY word.i) AS text, count(*) AS n FROM word ANTI JOIN gone ON gone.doc_id = word.doc_id AND gone.i = word.i GROUP BY word.doc_id)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(len(w.words) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

OP11_SQL = r"""
WITH steps AS (SELECT list(v ORDER BY i) AS v FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a // 2, 3988292384 * (a % 2))) AS v FROM range(256) r(i))),
turn AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
conv AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)), lambda a, b: xor(a // 256, steps.v[1 + xor(a, b) % 256]))) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turn), steps),
again AS (
  SELECT conv.conv_id, place, role, text FROM conv JOIN turn ON turn.conv_id = conv.base AND place < h
  UNION ALL SELECT turn.conv_id, place, role, text FROM conv JOIN turn ON turn.conv_id = conv.conv_id AND place >= h),
deep AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS depth, role, text FROM again),
path AS (
  SELECT conv_id, depth, text, list({'role': role, 'text': text}) OVER (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS path FROM deep
  UNION ALL SELECT conv_id, 0, '', [] FROM conv),
member AS (SELECT conv_id, depth, text, min(conv_id) OVER (PARTITION BY depth, path) AS node, max(depth) OVER (PARTITION BY conv_id) AS ends FROM path),
node AS (
  SELECT node AS conv_id, depth, count(*) AS n_convs, (count(*) - 1) * len(regexp_extract_all(min(text), '[^\x20\x09-\x0D]+')) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends = depth), '')) AS ends_sha256
  FROM member GROUP BY node, depth),
above AS (SELECT a.node AS conv_id, a.depth, b.node AS parent_conv_id FROM member a LEFT JOIN member b ON b.conv_id = a.conv_id AND b.depth = a.depth - 1 WHERE a.node = a.conv_id),
kids AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n FROM above WHERE depth > 0 GROUP BY ALL),
full_node AS (SELECT node.*, parent_conv_id, coalesce(kids.n, 0) AS n_children FROM node JOIN above USING (conv_id, depth) LEFT JOIN kids USING (conv_id, depth)),
below AS (
  SELECT a.node AS conv_id, a.depth, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM full_node d JOIN member a ON a.conv_id = d.conv_id AND a.depth <= d.depth GROUP BY ALL)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256 FROM full_node JOIN below USING (conv_id, depth)
"""


def _op13_sql() -> str:
    """Two rounds of training and the last assignment, by brute force over all entries."""
    assign = lambda n: f"""
near{n} AS (
  SELECT s.vec_id, s.label, s.part, min(struct_pack(d := list_sum(list_transform(range(1, len(s.v) + 1), lambda i: (s.v[i] - b.v[i]) * (s.v[i] - b.v[i])))::BIGINT, entry := b.entry)) AS best, any_value(s.v) AS v, s.r
  FROM seg s JOIN book{n} b ON b.part = s.part GROUP BY s.r, s.vec_id, s.label, s.part)"""  # noqa: E731
    move = lambda n: f"""
mean{n} AS (
  SELECT part, entry, list(m ORDER BY i) AS v FROM (
    SELECT part, best.entry AS entry, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS m FROM near{n}, (SELECT unnest(range(1, 5)) AS i) GROUP BY ALL) GROUP BY part, entry),
book{n + 1} AS (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{n} b LEFT JOIN mean{n} m USING (part, entry))"""  # noqa: E731
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER (ORDER BY vec_id, embedding) AS r
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
seg AS (SELECT r, vec_id, label, part, v[4 * part + 1:4 * part + 4] AS v FROM kept, (SELECT unnest(range(0, 16)) AS part)),
book0 AS (SELECT part, r - 1 AS entry, v FROM seg WHERE r <= 64),{assign(0)},{move(0)},{assign(1)},{move(1)},{assign(2)},
coded AS (SELECT r, vec_id, label, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM near2 GROUP BY ALL),
told AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, told
"""


OP13_SQL = _op13_sql()
