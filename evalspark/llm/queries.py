"""Queries over the driver's tables for the corpus operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm import boilerplate, conversations, decontaminate, exact_dedup, language, merkle, mixing, ngram_join, quality, simhash, structure_sql, tokens, toxicity, warc
from evalspark.llm.common import hash_fold, shared_path, table


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language.fit_rows(language.training_rows(docs))
    held = (hash_fold(F.col("doc_id"), 4) == 2).alias("held_out")
    return language.identify(docs.select("doc_id", held, "text"), profiles)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_near(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_rows(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    held = (hash_fold(F.col("doc_id"), 3) == 1).alias("held_out")
    scored = toxicity.score_toxicity(docs.select("doc_id", held, "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.resolved(warc.read_archives(spark, path, payloads=False))


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    tokens.write_tokens(table(spark, sf_dir, "documents"), path)
    return token_report(spark, path)


def token_report(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the documents in the token files at path."""
    files = tokens.read_tokens(spark, path)
    read = tokens.starts(tokens.id_checksums(files), files)
    return read.select("doc_id", "start", "n_tokens", F.col("_crc").alias("ids_crc32"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_rows(quality.training_rows(docs, table(spark, sf_dir, "labels")))
    held = (hash_fold(F.col("doc_id"), 4) == 2).alias("held_out")
    scored = quality.score_quality(docs.select("doc_id", held, "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "end", F.round("similarity", 6).alias("similarity"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boilerplate.drop_boilerplate(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "host", "host_pages", "n_lines", "n_dropped", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.checked(merkle.manifest(table(spark, sf_dir, "documents")))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations")))


QUERIES = {
    f.__name__: f
    for f in (op1_language, op2_exact_dedup, op3_ngram_join, op4_toxicity, op5_warc, op6_tokens, op7_quality, op8_decontaminate, op9_mix, op10_line_dedup)
    + (op11_simhash, op12_manifest, op13_repair)
}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+')"
_SHINGLES = "CASE WHEN len({0}) = 0 THEN [] WHEN len({0}) < 5 THEN [array_to_string({0}, ' ')] ELSE [array_to_string({0}[i:i + 4], ' ') FOR i IN range(1, len({0}) - 3)] END"

ORACLE_SQL: dict[str, str] = {
    "op12_manifest": structure_sql.MANIFEST,
    "op13_repair": structure_sql.REPAIR,
    "op2_exact_dedup": f"""WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
  SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""",
    "op3_ngram_join": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents), s AS (SELECT doc_id, list_distinct({_SHINGLES.format('w')}) AS s FROM w),
  n AS (SELECT doc_id, len(s) AS n FROM s), u AS (SELECT doc_id, unnest(s) AS g FROM s), c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
  l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
  r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
  SELECT doc_id, n::bigint AS n_shingles, (SELECT min(b) FROM r WHERE r.a = doc_id) AS component_id FROM n""",
    "op5_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), g AS (SELECT h, max(page_id) AS m FROM p GROUP BY h), d AS (SELECT page_id, h, m, sha1(h) AS s FROM p JOIN g USING (h))
  SELECT page_id, octet_length(encode(h))::bigint AS payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(s, i // 4 * 5 + 1, 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int + 1, 1) FOR i IN range(32)], '') AS payload_digest,
    CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to FROM d""",
    "op8_decontaminate": f"""WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark), d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
  ip AS (SELECT item_id, len(w) AS n, p - 1 AS pos, array_to_string(w[p:p + 4], ' ') AS g FROM i, LATERAL (SELECT unnest(range(1, greatest(len(w) - 3, 2))) AS p) WHERE len(w) > 0),
  df AS (SELECT g, count(DISTINCT item_id) AS df FROM ip GROUP BY 1), total AS (SELECT count(*) + 1 AS n FROM i WHERE len(w) > 0),
  ig AS (SELECT DISTINCT item_id, g, ln(1 + (SELECT n FROM total) / df::double) AS wt FROM ip JOIN df USING (g)), iw AS (SELECT item_id, sum(wt) AS theirs FROM ig GROUP BY 1),
  dp AS (SELECT doc_id, p - 1 AS pos, array_to_string(w[p:p + 4], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 3, 2))) AS p) WHERE len(w) > 0),
  st AS (SELECT DISTINCT doc_id, item_id, ip.n, greatest(0, least(dp.pos - ip.pos, len(d.w) - ip.n)) AS start FROM dp JOIN ip USING (g) JOIN d USING (doc_id)),
  win AS (SELECT doc_id, item_id, n, start, least(n, len(w)) AS size, w[start + 1:start + n] AS w FROM st JOIN d USING (doc_id)),
  wg AS (SELECT doc_id, item_id, start, size, unnest(list_distinct({_SHINGLES.format('w')})) AS g FROM win),
  sc AS (SELECT doc_id, item_id, start, size, sum(coalesce(ig.wt, 0)) AS shared, sum(coalesce(ig.wt, ln(1 + (SELECT n FROM total)::double))) AS mine FROM wg LEFT JOIN ig USING (item_id, g) GROUP BY 1, 2, 3, 4),
  sim AS (SELECT doc_id, item_id, start, size, shared / (mine + theirs - shared) AS s FROM sc JOIN iw USING (item_id)),
  best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY round(s, 9) DESC, start) AS k FROM sim WHERE s >= 0.75 - 1e-9)
  SELECT doc_id, item_id, start::int AS start, (start + size)::int AS "end", round(s, 6) AS similarity FROM best WHERE k = 1""",
    "op10_line_dedup": rf"""WITH p AS (SELECT page_id, lower(coalesce(regexp_extract(url, '{boilerplate.HOST}', 1), '')) AS host,
    list_filter([trim(regexp_replace(x, '<[^>]*>', '', 'g')) FOR x IN string_split_regex(regexp_replace(coalesce(html, ''), '{boilerplate.DROPPED}', '', 'g'), '{boilerplate.LINE_BREAK}')], lambda x: x <> '') AS lines FROM pages),
  t AS (SELECT host, count(*) AS host_pages FROM p GROUP BY 1), l AS (SELECT host, unnest(list_distinct(lines)) AS line FROM p), o AS (SELECT host, line, count(*) AS k FROM l GROUP BY 1, 2),
  b AS (SELECT host, list(line) AS bad FROM o JOIN t USING (host) WHERE k >= 2 AND host_pages >= {boilerplate.MIN_PAGES} AND k > {boilerplate.MAX_RATIO} * host_pages GROUP BY 1),
  f AS (SELECT page_id, host, host_pages, lines, list_filter(lines, lambda x: NOT coalesce(list_contains(bad, x), false)) AS kept FROM p JOIN t USING (host) LEFT JOIN b USING (host))
  SELECT page_id, host, host_pages, len(lines)::bigint AS n_lines, (len(lines) - len(kept))::bigint AS n_dropped, md5(array_to_string(kept, chr(10))) AS text_md5 FROM f""",
}
