"""The corpus operators' queries over the driver's tables, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, exact_dedup, gru_langid, lexical_search, mixing, permutation_ann, quality_trees, simhash, substring_dedup, url_rules, warc, whitening
from tidemark.operators.steps import spread

URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def op1_mixing(spark, sf_dir):
    return mixing.mixing_plan(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_permutation_ann(spark, sf_dir):
    vectors = _read(spark, sf_dir, "embeddings")
    return permutation_ann.nearest_neighbours(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(_read(spark, sf_dir, "documents"))


def op4_url_rules(spark, sf_dir):
    return url_rules.judged_urls(_read(spark, sf_dir, "pages"), url_rules.rule_table(spark, URL_RULES))


def op5_bpe(spark, sf_dir):
    return bpe.encoded(_read(spark, sf_dir, "documents"), tokenizer_path())


def op6_simhash(spark, sf_dir):
    return simhash.near_duplicates(_read(spark, sf_dir, "documents")).drop("fp")


def op7_licenses(spark, sf_dir):
    from tidemark.llm import licenses

    return licenses.license_matches(_read(spark, sf_dir, "documents"))


def op8_gru_langid(spark, sf_dir):
    return gru_langid.predicted_languages(_read(spark, sf_dir, "documents"))


def op9_substring_dedup(spark, sf_dir):
    return substring_dedup.repeated_word_spans(_read(spark, sf_dir, "documents")).drop("spans", "factors")


def op10_warc(spark, sf_dir):
    return warc.page_archive(_read(spark, sf_dir, "pages"))


def op11_whitening(spark, sf_dir):
    return whitening.whitened_vectors(_read(spark, sf_dir, "embeddings")).drop("deviation_digits")


def op12_quality_trees(spark, sf_dir):
    return quality_trees.quality_scores(_read(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_lexical_search(spark, sf_dir):
    return lexical_search.ranked_documents(_read(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict:
    found = (op1_mixing, op2_permutation_ann, op3_exact_dedup, op4_url_rules, op5_bpe, op6_simhash, op7_licenses, op8_gru_langid, op9_substring_dedup, op10_warc, op11_whitening, op12_quality_trees, op13_lexical_search)
    return {f.__name__: f for f in found}


_WS = r"[\x20\x09-\x0D]"
_DOTTED = "('.' || host)"
_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = {
    "op1_mixing": r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
  md5(concat_ws(':', 'mix', coalesce(doc_id::VARCHAR, 'null'), md5(coalesce(text, '')), nullif(nth, 1)::VARCHAR)) AS h FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, coalesce(text, ''), source) AS nth FROM documents)),
p AS (SELECT source, sum(size)::BIGINT AS source_size, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM d GROUP BY source),
q AS (SELECT *, 3 * source_size AS most, sum(source_size) OVER ()::BIGINT
    - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS remain,
    sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS open FROM p),
l AS (SELECT (min_by(remain::DOUBLE / open, most / weight)) AS level FROM q WHERE most * open > remain * weight),
t AS (SELECT source, source_size, CASE WHEN most * open <= remain * weight THEN most::DOUBLE ELSE (SELECT level FROM l) * weight END AS target FROM q),
r AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate)::BIGINT + CASE WHEN ('0x' || left(h, 8))::BIGINT / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
""",
    "op3_exact_dedup": rf"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_WS}+', '', 'g') AS k, length(coalesce(text, '')) AS n FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY k ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY k) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(k) AS text_sha256 FROM g
""",
    "op4_url_rules": rf"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, CASE WHEN ends_with({_DOTTED}, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN ends_with({_DOTTED}, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN ends_with({_DOTTED}, '.net') AND starts_with(path, '/es/') THEN 'net/es/' WHEN ends_with({_DOTTED}, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN ends_with({_DOTTED}, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM r
""",
    "op9_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(generate_series(1, len(w) - 34)) AS i, w FROM d WHERE len(w) >= 35),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS k FROM s),
f AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM h) WHERE n > 1),
c AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(generate_series(i, i + 34)) AS p FROM f) GROUP BY doc_id),
o AS (SELECT d.doc_id, w, coalesce(gone, []::BIGINT[]) AS gone FROM d LEFT JOIN c USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
  sha256(array_to_string(list_select(w, list_filter(generate_series(1, len(w)), lambda j: NOT list_contains(gone, j))), ' ')) AS kept_sha256 FROM o
""",
    "op10_warc": r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS low FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND low <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND low <> page_id THEN low END AS refers_to FROM g
""",
    "op13_lexical_search": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents), c AS (SELECT count(*) AS total, sum(len(w))::BIGINT AS words FROM d WHERE len(w) > 0),
i AS (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS w FROM benchmark), q AS (SELECT i, item_id, unnest(w) AS term FROM i),
t AS (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d), p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY ALL),
s AS (SELECT r, doc_id, term, floor(1000 * ln((2 * total + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * total) // words))) AS s FROM p JOIN f USING (term), c),
k AS (SELECT i, item_id, r, doc_id, sum(s)::BIGINT AS score FROM q JOIN s USING (term) GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM k WHERE score > 0) WHERE rank <= 20
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
