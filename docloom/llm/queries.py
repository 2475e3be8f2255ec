"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark, sf_dir):
    from docloom.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_context_tree(spark, sf_dir):
    from docloom.llm.context_tree import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op3_token_rollup(spark, sf_dir):
    """All documents go in; those labelled low in quality are revised (their first line goes), toxic ones deleted; one batch is committed twice."""
    from docloom.llm.blocks import cut, shared_folder
    from docloom.llm.token_rollup import Ledger, counted

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ledger = Ledger(spark, shared_folder(spark, "ledger"))
    ledger.commit("000", inserts=counted(docs))
    first_line = F.coalesce(F.locate("\n", "text"), F.lit(0))
    shorter = counted(docs.withColumn("text", F.col("text").substr(first_line + 1, F.length("text"))))
    poor = labels.where("quality = 0").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    revised = cut(shorter.join(poor, "doc_id", "left_semi"))  # counts are joined, not texts
    ledger.commit("001", revisions=revised)
    ledger.commit("001", revisions=revised)
    ledger.commit("002", deletes=labels.where("toxic = 1").select("doc_id"))
    return ledger.totals()


OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, lang, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN substr(text, strpos(text, chr(10)) + 1) ELSE text END AS text
  FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
v AS (SELECT source, lang, 'words-1' AS tokenizer, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n, length(text) AS c FROM d
  UNION ALL SELECT source, lang, 'pieces-1', len(regexp_extract_all(text, '[A-Za-z0-9\x{80}-\x{10FFFF}]+|[^A-Za-z0-9\x{80}-\x{10FFFF}\x20\x09-\x0D]')), length(text) FROM d)
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(sum(c) AS BIGINT) AS n_chars FROM v GROUP BY 1, 2, 3
"""


def op4_jaccard_join(spark, sf_dir):
    from docloom.llm.jaccard_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, h FROM (SELECT doc_id, array_to_string(ws[i:i + 3], ' ') AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, least(len(ws), 1) + 1))) AS i FROM w))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY 1
"""


def op5_substring_dedup(spark, sf_dir):
    from docloom.llm.substring_dedup import dedup_substrings

    return dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
own AS (SELECT h, min(doc_id) AS least_id FROM win GROUP BY 1),
bad AS (SELECT DISTINCT doc_id, i + o AS pos FROM (SELECT doc_id, i, unnest(range(0, 50)) AS o FROM win JOIN own USING (h) WHERE doc_id > least_id)),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS t FROM word ANTI JOIN bad USING (doc_id, pos) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""


def op6_progressive_jpeg(spark, sf_dir):
    from docloom.llm.progressive_jpeg import media_digest, store_texts

    return media_digest(store_texts(table(spark, sf_dir, "documents")))


def op7_url_filter(spark, sf_dir):
    from docloom.llm.url_globs import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"))


def op8_string_tiling(spark, sf_dir):
    from docloom.llm.tiling import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "item_words", "covered_words", "coverage")


def op9_toxic_crf(spark, sf_dir):
    from docloom.llm.toxic_crf import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumn("spans", F.size("spans")).withColumnRenamed("spans", "n_spans")


def op10_sanitise(spark, sf_dir):
    from docloom.llm.sanitise import find_personal_data, span_digest

    return span_digest(find_personal_data(table(spark, sf_dir, "documents")))


OP7_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS t FROM pages),
p AS (SELECT page_id, translate(regexp_extract(t, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(t, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, rule, rhost, rpath) AS (VALUES ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'),
  ('block', 'net/de/', 'net', '/de/'), ('allow', 'example.net/de/8', 'example.net', '/de/8'), ('block', 'org/es/', 'org', '/es/'))
SELECT page_id, host, path,
  (SELECT arg_max(rule, length(rule)) FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS rule,
  coalesce((SELECT arg_max(verdict, length(rule)) FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)), 'allow') AS verdict
FROM p
"""

QUERIES = {"op1_mixing": op1_mixing, "op2_context_tree": op2_context_tree, "op3_token_rollup": op3_token_rollup, "op4_jaccard_join": op4_jaccard_join, "op5_substring_dedup": op5_substring_dedup, "op6_progressive_jpeg": op6_progressive_jpeg, "op7_url_filter": op7_url_filter, "op8_string_tiling": op8_string_tiling, "op9_toxic_crf": op9_toxic_crf, "op10_sanitise": op10_sanitise}
SQL = {"op3_token_rollup": OP3_SQL, "op4_jaccard_join": OP4_SQL, "op5_substring_dedup": OP5_SQL, "op7_url_filter": OP7_SQL}
