"""One registered query per operator, over its whole table, with check SQL where DuckDB can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import brown_lm, chat, decontaminate, exact, html_extract, mixing, pii, quality, repair, sharding, simhash, toxicity, trie
from .common import crc_text, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``bytes``: shard sizes near equal."""
    out = sharding.assign_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op2_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op4_golden_ratio_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op5_segment_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex64(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op8_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "broken_rules")


@query
def op9_event_sourced_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role")) for k, r in enumerate(("user", "assistant"))]))
    probe = spark.range(1).select(probe.alias("p")).select(F.lit(-1).cast("long").alias("conv_id"), "p.turn", "p.role", F.lit("</s>[INST] ok [/INST]").alias("text"))
    got = chat.read_back(chat.render(chat.fold(chat.to_events(given.unionByName(probe)))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return got.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query
def op10_candidate_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pii.detect(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return got.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(pii.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


ORACLES["op9_event_sourced_chat"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(text) + length(text) * 3 - length(replace(text, '\', '')) - length(replace(text, '<', '')) - length(replace(text, '[', '')) AS body,
    length(role) + length(role) * 4 - length(replace(role, '\', '')) - length(replace(role, '<', '')) - length(replace(role, '[', '')) - length(replace(role, chr(10), '')) AS head
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(body + head + 24) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""

#: The same rule in integers: the stream order is by md5, the schedule is the golden ratio modulo 2**32.
ORACLES["op4_golden_ratio_mix"] = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
s2 AS (SELECT *, source_size * 3 AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(weight) OVER () AS BIGINT) AS weights FROM s),
s3 AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place, (total - coalesce(CAST(sum(cap) OVER w AS BIGINT), 0)) / (weights - coalesce(CAST(sum(weight) OVER w AS BIGINT), 0)) AS level
  FROM s2 WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT source, source_size, total, count(*) OVER () AS n,
    coalesce(least(CAST(cap AS DOUBLE), (SELECT arg_min(level, place) FROM s3 WHERE level < cap / weight) * weight), 0.0) AS target FROM s3),
g2 AS (
  SELECT *, greatest(1, least(4096, total // (1024 * n))) AS block,
    CAST(round(sum(target) OVER (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING) / sum(target) OVER () * 4294967296) AS BIGINT) AS hi FROM goals),
g3 AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY source NULLS LAST), 0) AS lo, greatest(1, (source_size + block - 1) // block) AS blocks FROM g2),
slots AS (SELECT i, (i * 2654435769) % 4294967296 AS u FROM (SELECT unnest(range((SELECT max((total + block - 1) // block) FROM g3))) AS i)),
ranked AS (SELECT source, blocks, row_number() OVER (PARTITION BY source ORDER BY i) - 1 AS rank FROM slots JOIN g3 ON u >= lo AND u < hi),
taken AS (SELECT source, rank % blocks AS b, least(count(*), 3) AS times FROM ranked GROUP BY 1, 2),
placed AS (
  SELECT doc_id, source, size, row_number() OVER () AS row_id,
    CAST(sum(size) OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix'), doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start FROM d),
cut AS (
  SELECT p.*, g.block, unnest(range(start // g.block, (start + size - 1) // g.block + 1)) AS b
  FROM placed p JOIN g3 g ON p.source IS NOT DISTINCT FROM g.source WHERE size > 0),
got AS (
  SELECT row_id, CAST(sum((least(start + size, (c.b + 1) * block) - greatest(start, c.b * block)) * coalesce(times, 0)) AS BIGINT) AS taken
  FROM cut c LEFT JOIN taken t ON c.source IS NOT DISTINCT FROM t.source AND c.b = t.b GROUP BY row_id)
SELECT p.doc_id, p.size, g.source_size, g.target, coalesce(taken, 0) AS taken
FROM placed p JOIN goals g ON p.source IS NOT DISTINCT FROM g.source LEFT JOIN got USING (row_id)"""


@query
def op3_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model, ["doc_id"])
    return out.select("doc_id", (crc_text(F.col("doc_id")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op6_latent_semantic_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents only, one row per document and benchmark item."""
    out = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", F.explode("_hits").alias("h")).select("doc_id", "h.item_id", "h.share", "h.cosine", "h.kind")


@query
def op7_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score_documents(table(spark, sf_dir, "documents"))


@query
def op11_hash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.mark(table(spark, sf_dir, "documents"))


ORACLES["op11_hash_groups"] = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
r AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY body) AS group_size FROM d
  WINDOW w AS (PARTITION BY body ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(body) AS text_sha256 FROM r"""


@query
def op12_edit_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations"))


#: crc32 of the texts in a table keys(key), by byte, for WITH RECURSIVE.
CRC32 = r"""
bits(b, v, k) AS (SELECT b, b, 0 FROM range(256) t(b) UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc(key, i, c) AS (
  SELECT key, 0, 4294967295::BIGINT FROM keys
  UNION ALL SELECT key, i + 1, xor(c >> 8, v) FROM crc JOIN bits ON k = 8 AND b = xor(c & 255, ascii(substr(key, i + 1, 1))) WHERE i < length(key)),
hashed AS (SELECT key, xor(c, 4294967295) AS h FROM crc WHERE i = length(key))"""

#: The same lattice turn by turn: per state the cheapest audit so far, ties by the audit.
ORACLES["op12_edit_lattice"] = r"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
keys AS (SELECT DISTINCT key FROM given),""" + CRC32 + r""",
convs AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
hurt AS (
  SELECT c, turn, CASE WHEN h % 20 = 4 THEN 'user' ELSE role END AS role,
    CASE h % 20 WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE h % 20 WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM given JOIN hashed USING (key) JOIN convs ON convs.conv_id IS NOT DISTINCT FROM given.conv_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS place FROM hurt),
turns AS (
  SELECT *, CASE left(role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END AS r,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY place) > 1 THEN 'd'
      WHEN regexp_matches(text, '[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY c ORDER BY place) || left(role, 1) AS pair
  FROM placed),
follows(s, n, name) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
edits AS (
  SELECT s, r, 'D' AS edit, s AS to_s, 2 AS cost, '' AS name FROM follows, range(4) t(r)
  UNION ALL SELECT s, r, 'R', n, 1, name FROM follows, range(4) t(r)
  UNION ALL SELECT s, r, 'K', r, 0, NULL FROM (VALUES (0, 1), (0, 2), (1, 2), (3, 2), (2, 3)) t(s, r)),
inserts AS (
  SELECT s, s AS to_s, 0 AS cost, '' AS audit, '' AS said FROM follows
  UNION ALL SELECT s, n, 5, 'I', name || ':' || chr(10) FROM follows
  UNION ALL SELECT a.s, b.n, 10, 'II', a.name || ':' || chr(10) || b.name || ':' || chr(10) FROM follows a JOIN follows b ON a.n = b.s),
step(c, i, s, cost, audit, said) AS (
  SELECT c, 0, to_s, cost, audit, said FROM convs, inserts WHERE s = 0
  UNION ALL
  SELECT c, i, s, cost, audit, said FROM (
    SELECT t.c, t.i + 1 AS i, n.to_s AS s, t.cost + e.cost + n.cost + CASE WHEN e.edit <> 'D' AND fault = 't' THEN 5 ELSE 0 END AS cost, t.audit || e.edit || n.audit AS audit,
      t.said || CASE WHEN e.edit = 'D' THEN '' ELSE coalesce(e.name, role) || ':' || text || chr(10) END || n.said AS said
    FROM step t JOIN turns ON turns.c = t.c AND place = t.i + 1 JOIN edits e ON e.s = t.s AND e.r = turns.r AND (e.edit = 'D' OR fault IN ('', 't')) JOIN inserts n ON n.s = e.to_s)
  QUALIFY row_number() OVER (PARTITION BY c, s ORDER BY cost, audit) = 1),
facts AS (
  SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (place > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY c),
best AS (SELECT step.* FROM step LEFT JOIN facts USING (c) WHERE i = coalesce(n, 0) AND s IN (0, 3) QUALIFY row_number() OVER (PARTITION BY c ORDER BY cost, audit) = 1)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(cost AS BIGINT) AS cost, audit, sha256(left(said, greatest(length(said) - 1, 0))) AS repaired_sha256
FROM convs JOIN best USING (c) LEFT JOIN facts USING (c)"""


@query
def op13_radix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


ORACLES["op13_radix_trie"] = r"""
WITH RECURSIVE given AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, coalesce(CAST(conv_id AS VARCHAR), '') AS key FROM conversations),
keys AS (SELECT DISTINCT key FROM given),""" + CRC32 + r""",
said AS (SELECT DISTINCT role, text, left(sha256(strlen(role) || ':' || role || text), 32) AS sha FROM given),
ids AS (SELECT role, text, sha, row_number() OVER (ORDER BY role, text) AS id, strlen(text) AS w FROM said),
convs AS (SELECT conv_id, key, list(id ORDER BY turn NULLS FIRST, sha, w) AS seq FROM given JOIN ids USING (role, text) GROUP BY conv_id, key),
members AS (
  SELECT c.conv_id, list_concat(coalesce(b.seq[1:CAST(h % 9 AS INT)], []), c.seq[CAST(h % 9 AS INT) + 1:]) AS seq
  FROM convs c JOIN hashed USING (key) LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 5),
ways AS (SELECT conv_id, len(seq) AS n, unnest(range(len(seq) + 1)) AS d, seq FROM members),
node AS (
  SELECT seq[1:d] AS p, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = n), '')) AS ends_sha256
  FROM ways GROUP BY 1, 2),
kids AS (SELECT p[1:depth - 1] AS p, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * coalesce(w, 0) AS again FROM node LEFT JOIN kids USING (p) LEFT JOIN ids ON id = p[depth]),
tops AS (SELECT n_children, again, p, unnest(range(depth + 1)) AS d FROM full_node),
under AS (SELECT p[1:d] AS p, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(again) AS BIGINT) AS saved_tokens FROM tops GROUP BY 1)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
FROM full_node n JOIN under USING (p) LEFT JOIN node u ON n.depth > 0 AND u.p = n.p[1:n.depth - 1]"""
