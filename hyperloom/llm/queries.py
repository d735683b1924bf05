"""The operators as queries over whole tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.llm import bpe, html_text, interpolated, language, merkle, mixing, pii, quality, simhash, spans, suffix, topk, vector_codes
from hyperloom.llm.common import table


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.verdicts(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return judged.select("doc_id", *quality.ADDED)


def op7_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def op9_interpolated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")).drop("label")


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.identify(docs, language.fit(docs))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    every_second = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    tampered = merkle.leaf_of(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], F.translate("text", "\n", ""))
    rows = merkle.manifest(table(spark, sf_dir, "documents"), carried={"tampered": F.when(every_second, tampered)})
    back = merkle.folded(F.coalesce("tampered", "leaf"), F.col("steps"))
    proven = rows.select("doc_id", "leaf", "subroot", "root", merkle.digest_of(F.col("steps")).alias("proof_sha256"), back.alias("folded_root"))
    return proven.withColumn("verified", F.col("folded_root") == F.col("root"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2:3].isdigit()}


OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, source FROM documents),
w AS (SELECT doc_id, t, source, list_filter(regexp_split_to_array(t, '[ \t-\r]+'), lambda x: x <> '') AS words FROM d),
l AS (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS line FROM d),
n AS (SELECT doc_id, source, t, line, trim(lower(regexp_replace(line, '[^\p{L}]+', ' ', 'g'))) AS norm,
             len(list_filter(regexp_split_to_array(line, '[ \t-\r]+'), lambda x: x <> '')) AS words FROM l),
texts AS (SELECT source, count(DISTINCT t) AS texts FROM d GROUP BY source),
f AS (SELECT n.source, norm, min(doc_id) AS first FROM n JOIN texts ON n.source IS NOT DISTINCT FROM texts.source WHERE norm <> ''
      GROUP BY n.source, norm, texts HAVING count(DISTINCT t) > 10 AND count(DISTINCT t) > 0.005 * texts),
gone AS (SELECT n.doc_id, sum(n.words) AS gone FROM n JOIN f ON n.source IS NOT DISTINCT FROM f.source AND n.norm = f.norm AND n.doc_id <> f.first GROUP BY n.doc_id),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM n WHERE words > 0 GROUP BY doc_id),
g AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM w, unnest(range(1, len(words) - 1)) AS u(i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, unnest([0, 1, 2]) AS u(k) GROUP BY doc_id),
b AS (SELECT w.doc_id, len(words) AS n_words, len(array_to_string(words, '')) AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(gone, 0)::BIGINT AS n_removed_words
      FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
       AND (n_removed_words = 0 OR (n_words - n_removed_words >= 0.4 * n_words AND n_words - n_removed_words >= 25)) AS kept
FROM b
"""


OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def codes_sql(k: int) -> str:
    """Round k: the entry of each part, the lower one if tied, and the codebooks after it."""
    return f"""a{k} AS MATERIALIZED (SELECT vec_id, part, min(dist * 256 + entry) % 256 AS entry, min(dist) AS dist
      FROM (SELECT vec_id, part, entry, sum((x - c) * (x - c))::BIGINT AS dist FROM p JOIN b{k} USING (part, pos) GROUP BY ALL) GROUP BY ALL),
    b{k + 1} AS MATERIALIZED (SELECT part, entry, pos, coalesce(m.c, b{k}.c) AS c
      FROM b{k} LEFT JOIN (SELECT part, entry, pos, floor(sum(x) / count(*))::BIGINT AS c FROM p JOIN a{k} USING (vec_id, part) GROUP BY ALL) m USING (part, entry, pos))"""


OP11_SQL = f"""
WITH v AS (SELECT vec_id, label, embedding AS e, len(embedding) // 4 AS width FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, i // width AS part, i % width AS pos, floor(1024 * e[i + 1]::DOUBLE)::BIGINT AS x FROM (SELECT *, unnest(range(len(e))) AS i FROM v)),
b0 AS MATERIALIZED (SELECT part, entry, pos, x AS c FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v QUALIFY entry < 256) USING (vec_id)),
{", ".join(codes_sql(k) for k in range(5))},
codes AS (SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error FROM a4 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) FROM b4) AS codebooks_sha256 FROM codes JOIN v USING (vec_id)
"""


def leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def up_sql(name: str, start: str) -> str:
    """The levels of trees from (source, pos, n, h), each from the one below."""
    return f"""{name} AS (SELECT 0 AS lvl, source, pos, n, h FROM {start} UNION ALL
      SELECT lvl + 1, source, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY lvl, source, pos // 3, n)"""


def steps_sql(nodes: str, start: str, k: int) -> str:
    """For each lowest node the siblings to its left and right, level by level."""
    side = lambda c: f"coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos {c} l.pos // pow(3, lvl)::BIGINT), '')"
    return f"""SELECT l.source, l.pos, {k} + lvl AS k, {side("<")} AS l, {side(">")} AS r FROM {start} l
      JOIN {nodes} x ON x.source IS NOT DISTINCT FROM l.source AND x.n > 1 AND x.pos // 3 = l.pos // pow(3, lvl + 1)::BIGINT GROUP BY l.source, l.pos, lvl"""


OP13_SQL = f"""
WITH RECURSIVE crc AS (SELECT *, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
      lambda s, c: list_reduce(range(8), lambda t, i: xor(t >> 1, 3988292384 * (t & 1)), xor(s, c)), 4294967295) & 1 AS other FROM documents),
leaves AS (SELECT doc_id, source, {leaf_sql("text")} AS h, CASE WHEN other = 1 THEN {leaf_sql("replace(text, chr(10), '')")} END AS tampered,
      row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM crc),
{up_sql("nodes", "leaves")},
subroots AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
over AS (SELECT NULL::VARCHAR AS source, pos, n, subroot AS h FROM subroots),
{up_sql("upper", "over")},
low_steps AS ({steps_sql("nodes", "leaves", 0)}),
top_steps AS ({steps_sql("upper", "over", 1000)}),
steps AS (SELECT source, pos, k, l, r FROM low_steps UNION ALL
      SELECT a.source, a.pos, k, t.l, t.r FROM leaves a JOIN subroots s ON a.source IS NOT DISTINCT FROM s.source JOIN top_steps t ON t.pos = s.pos),
lists AS (SELECT source, pos, list(l || '|' || r ORDER BY k) AS steps, string_agg(l || r, '' ORDER BY k) AS proof FROM steps GROUP BY source, pos),
folds AS (SELECT a.doc_id, a.h AS leaf, s.subroot, (SELECT h FROM upper WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
      list_reduce(coalesce(steps, []::VARCHAR[]), lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2)), coalesce(a.tampered, a.h)) AS folded_root
      FROM leaves a JOIN subroots s ON a.source IS NOT DISTINCT FROM s.source LEFT JOIN lists p ON p.source IS NOT DISTINCT FROM a.source AND p.pos = a.pos)
SELECT *, folded_root = root AS verified FROM folds
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_top_k": OP5_SQL, "op6_quality_rules": OP6_SQL, "op11_vector_codes": OP11_SQL, "op13_merkle_manifest": OP13_SQL}
