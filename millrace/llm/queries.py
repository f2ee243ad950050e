"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .conversations import damage_and_repair
from .hnsw import near_vectors
from .linededup import dedup_lines
from .media import store_and_read
from .minhash import near_duplicates
from .mixing import mix, words
from .packing import pack, token_pieces
from .periodic import looped, periodic_runs
from .sentencepiece_codec import encode_decode
from .suffixdedup import remove_repeats
from .tokencount import count_tokens
from .toxicity import held_out, learn, score
from .warc import read_warc, write_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids with an end id and the decoded text of every document, as digests."""
    out = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.withColumnRenamed("doc", "doc_id")


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by a classifier trained on the label model's posteriors."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return out.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to a sharded archive and read back."""
    out = read_warc(*write_warc(table(spark, sf_dir, "pages")))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op4_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex FROM p),
b AS (SELECT page_id, payload_bytes, translate(array_to_string(list_transform(range(8), lambda k: to_base(('0x' || substr(hex, 5 * k + 1, 5))::BIGINT, 32, 4)), ''), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest FROM d),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""


@query
def op8_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as chunked media, rebuilt, and described from what was read back."""
    return store_and_read(table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")


@query
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of strings of 400 bytes that occur elsewhere too."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(F.col("doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "repeats_passage")


@query
def op10_hnsw_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of vectors whose cosine is 0.95 or more."""
    out = near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return out.select(F.col("doc").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("doc") == F.col("component")).alias("kept"))


ORACLES["op10_hnsw_near_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND list_dot_product(e, e) > 0 AND isfinite(list_dot_product(e, e))),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(node, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.node WHERE r.root < p.b),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node),
n AS (SELECT a, count(*) AS k FROM p GROUP BY a)
SELECT v.vec_id, coalesce(n.k, 0)::BIGINT AS n_links, c.root AS component_id, c.root = v.vec_id AS kept FROM v JOIN c ON c.node = v.vec_id LEFT JOIN n ON n.a = v.vec_id"""


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of byte-level BPE tokens of every document."""
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("doc", "doc_id")


@query
def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources takes from every document."""
    out = mix(table(spark, sf_dir, "documents"), F.array("source"), words(F.col("text")))
    return out.select(F.col("doc").alias("doc_id"), "size", "source_size", "target", "taken")


ORACLES["op6_mix_sources"] = """
WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS size, (row_number() OVER (ORDER BY source COLLATE C NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY 3 * size::DOUBLE / w, source) AS k, sum(size) OVER () AS total, sum(w) OVER () AS weights FROM s),
c AS (SELECT *, coalesce(sum(3 * size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped, coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM o),
f AS (SELECT min(k) AS k FROM c WHERE (total - capped) * w <= 3 * size * (weights - gone)),
z AS (SELECT c.k, c.total - c.capped AS rest, c.weights - c.gone AS left_ FROM c JOIN f USING (k)),
t AS (SELECT c.source, c.size AS source_size, CASE WHEN c.k < z.k THEN (3 * c.size)::DOUBLE ELSE (z.rest * c.w)::DOUBLE / z.left_ END AS target FROM c, z),
q AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target + 0.5)::BIGINT // source_size END AS passes, CASE WHEN source_size = 0 THEN 0 ELSE floor(target + 0.5)::BIGINT % source_size END AS rest FROM t),
r AS (SELECT d.doc_id, d.size, q.source_size, q.target, q.passes, q.rest, sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || d.doc_id::VARCHAR), d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, ((passes + CASE WHEN 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM r"""


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that several documents share stay in the one with the smallest id."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


#: chr(9) to chr(13) and the blank, as DuckDB's trim takes them.
_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op9_line_dedup"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS line
      FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM d)),
k AS (SELECT doc_id, i, line, {_LOWER.format(f"trim(line, {_BLANKS})")} AS key FROM l),
r AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, k.i, k.line, r.key IS NOT NULL AND r.first <> k.doc_id AS dropped FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id"""


@query
def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of two-word shingles are alike to 80 percent."""
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words_each=2)
    return out.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), (F.col("doc") == F.col("component")).alias("kept"))


ORACLES["op7_minhash_near_dedup"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]] ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w),
t AS (SELECT doc_id, len(sh) AS n, list_sort(sh) AS sh FROM s),
c AS (SELECT min(doc_id) AS node, n, sh FROM t WHERE n > 0 GROUP BY n, sh),
e AS (SELECT node, n, unnest(sh) AS x FROM c),
p AS (SELECT a.node AS a, b.node AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k
      FROM e a JOIN e b ON a.x = b.x AND a.node < b.node AND least(a.n, b.n) * 100 >= 80 * greatest(a.n, b.n) GROUP BY ALL HAVING 100 * k >= 80 * (na + nb - k)),
g AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(node, root) AS (SELECT node, node FROM c UNION SELECT g.b, r.root FROM r JOIN g ON g.a = r.node WHERE r.root < g.b),
q AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT t.doc_id, t.n AS n_shingles, coalesce(q.root, t.doc_id) AS component_id, coalesce(q.root, t.doc_id) = t.doc_id AS kept
FROM t LEFT JOIN c ON t.n > 0 AND t.sh = c.sh LEFT JOIN q ON c.node = q.node"""


@query
def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces of at most 1,024 tokens, packed into few sequences."""
    pieces = token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)
    return pack(pieces, capacity=1024).withColumnRenamed("doc", "doc_id")


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation damaged by rule and repaired with the cheapest edits."""
    return damage_and_repair(table(spark, sf_dir, "conversations"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeating words of every document, some of whose words go in circles by rule."""
    return periodic_runs(table(spark, sf_dir, "documents"), prepare=looped).withColumnRenamed("doc", "doc_id")


#: crc32 by its table of 256 remainders; the program backward over four states (nothing yet, system, user, assistant), then the
#: walk forward, an edit a step.
ORACLES["op13_conversation_repair"] = """
WITH RECURSIVE tab AS (SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
fat AS (SELECT src.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda x: ord(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fate FROM src, tab),
dam AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy FROM fat WHERE fate <> 0),
num AS (SELECT *, row_number() OVER o AS i, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g') AS bare, lag(role[1]) OVER o || role[1] AS pair
  FROM dam WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role COLLATE C, text COLLATE C, copy)),
r AS (SELECT conv_id, turn, i, n, role, text, role[1] AS x, pair, CASE WHEN bare = '' THEN 1 WHEN seen > 1 THEN 2 WHEN bare[-1] NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS f FROM num),
b(conv_id, i, c0, c1, c2, c3) AS (SELECT DISTINCT conv_id, n + 1, 0, 10, 5, 0 FROM r UNION ALL
  SELECT conv_id, i, least(b0, 5 + least(b2, 5 + b3)), least(b1, 5 + least(b2, 5 + b3)), least(b2, 5 + b3), least(b3, 5 + b2) FROM (
    SELECT b.conv_id, r.i, least(2 + c0, CASE WHEN f IN (1, 2) THEN 999999999 ELSE least(1 + c2, CASE x WHEN 's' THEN c1 WHEN 'u' THEN c2 ELSE 999999999 END) + m END) AS b0,
      least(2 + c1, CASE WHEN f IN (1, 2) THEN 999999999 ELSE c2 + m + (x <> 'u')::INT END) AS b1, least(2 + c2, CASE WHEN f IN (1, 2) THEN 999999999 ELSE c3 + m + (x <> 'a')::INT END) AS b2,
      least(2 + c3, CASE WHEN f IN (1, 2) THEN 999999999 ELSE c2 + m + (x <> 'u')::INT END) AS b3
    FROM b JOIN (SELECT *, CASE WHEN f = 3 THEN 5 ELSE 0 END AS m FROM r) r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i - 1)),
p AS (SELECT b.conv_id, b.i, [b.c0, b.c1, b.c2, b.c3] AS c, [v.c0, v.c1, v.c2, v.c3] AS v, r.role, r.text, r.x, r.f, CASE WHEN r.f = 3 THEN 5 ELSE 0 END AS m FROM b LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i LEFT JOIN b v ON v.conv_id IS NOT DISTINCT FROM b.conv_id AND v.i = b.i + 1),
w(conv_id, i, s, audit, said) AS (SELECT conv_id, 1, 0, '', []::VARCHAR[] FROM p WHERE i = 1 UNION ALL
  SELECT conv_id, i + (e <> 'I')::INT, CASE WHEN e = 'D' THEN s WHEN e = 'K' AND x = 's' THEN 1 ELSE t END, audit || e,
    CASE e WHEN 'D' THEN said WHEN 'K' THEN list_append(said, role || ':' || text) ELSE list_append(said, CASE t WHEN 2 THEN 'user:' ELSE 'assistant:' END || CASE WHEN e = 'R' THEN text ELSE '' END) END FROM (
    SELECT w.*, p.role, p.text, p.x, CASE WHEN s = 2 THEN 3 ELSE 2 END AS t,
      CASE WHEN v IS NOT NULL AND v[1] IS NOT NULL AND 2 + v[s + 1] = c[s + 1] THEN 'D' WHEN 5 + c[CASE WHEN s = 2 THEN 3 ELSE 2 END + 1] = c[s + 1] THEN 'I'
        WHEN f IN (0, 3) AND (CASE x WHEN 's' THEN CASE WHEN s = 0 THEN v[2] END WHEN 'u' THEN CASE WHEN s <> 2 THEN v[3] END WHEN 'a' THEN CASE WHEN s = 2 THEN v[4] END END) + m = c[s + 1] THEN 'K' WHEN v[1] IS NOT NULL THEN 'R' END AS e
    FROM w JOIN p ON p.conv_id IS NOT DISTINCT FROM w.conv_id AND p.i = w.i) WHERE e IS NOT NULL),
z AS (SELECT conv_id, max_by(audit, (i, length(audit))) AS audit, max_by(said, (i, length(audit))) AS said FROM w GROUP BY conv_id),
q AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 1) AS blank, count(*) FILTER (f = 2) AS duplicate, count(*) FILTER (f = 3) AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.c0, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN q ON q.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM e.conv_id AND b.i = 1"""
