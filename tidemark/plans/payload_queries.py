"""Queries of ``operators.payloads``, with their SQL: the pages' and vectors' JSON is nested by number, 0 to 8 levels deep."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import payloads
from tidemark.plans.queries import query
from tidemark.plans.tables import read


_PAGES = r"""j AS (SELECT page_id, repeat('{"wrap":[', (page_id % 9)::INT) || '{"name":"n","videoUrl":' || to_json(coalesce(url, ''))::VARCHAR || ',"list":[{"cover":[' || to_json(coalesce(url, '') || '.PNG?w=1')::VARCHAR || ',[3,"  "]]},' || to_json(coalesce(url, '') || '/a.b.srt')::VARCHAR || '],"' || (['asr', 'plain', 'poster', 'ocrText'])[(page_id % 4 + 1)::INT] || '":[[' || to_json(coalesce(url, '') || 'm.Mp3')::VARCHAR || ']],"z":null}' || repeat(']}', (page_id % 9)::INT) AS json FROM pages)"""


def _page_json(spark, d):
    i, url = F.col("page_id"), F.coalesce("url", F.lit(""))
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    key = F.element_at(F.array(*[F.lit(k) for k in ("asr", "plain", "poster", "ocrText")]), (i % 4 + 1).cast("int"))
    n = (i % 9).cast("int")
    whole = F.concat(F.repeat(F.lit('{"wrap":['), n), F.lit('{"name":"n","videoUrl":'), quoted(url), F.lit(',"list":[{"cover":['), quoted(F.concat(url, F.lit(".PNG?w=1"))), F.lit(',[3,"  "]]},'), quoted(F.concat(url, F.lit("/a.b.srt"))), F.lit('],"'), key, F.lit('":[['), quoted(F.concat(url, F.lit("m.Mp3"))), F.lit(']],"z":null}'), F.repeat(F.lit("]}"), n))
    return read(spark, d, "pages").select("page_id", whole.alias("json"))


def _in(column, words):
    return " OR ".join(f"contains({column}, '{w}')" for w in words) or "false"


_CATEGORY = "CASE " + " ".join(f"WHEN {_in('low', words)}{' OR ending IN (' + ', '.join(repr(e) for e in endings) + ')' if endings else ''} THEN '{category}'" for category, words, endings in payloads.PATH_RULES) + " END"


@query(rf"""WITH {_PAGES}, l AS (SELECT page_id, t.type, json_extract_string(t.value, '$') AS path, coalesce(nullif(regexp_extract(t.fullkey, '\."?([^.\[\]"]+)"?(\[[0-9]+\])*$', 1), ''), '') AS name FROM j, json_tree(json) t),
c AS (SELECT page_id, name, trim(path) AS path, lower(name) AS low, lower(regexp_extract(string_split(trim(path), '?')[1], '[^/][^/]*?(\.[^./]+)/*$', 1)) AS ending FROM l WHERE type = 'VARCHAR' AND trim(path) <> '')
SELECT page_id, category, name, path, count(*) AS n FROM (SELECT *, {_CATEGORY} AS category FROM c) WHERE category IS NOT NULL GROUP BY ALL""")
def media_paths(spark, d):
    return payloads.media_paths(_page_json(spark, d), ["page_id"], "json").groupBy("page_id", "category", "name", "path").agg(F.count("*").alias("n"))


@query(rf"""WITH {_PAGES} SELECT page_id, t.type AS kind, count(*) AS n, max(length(t.fullkey) - length(replace(replace(t.fullkey, '.', ''), '[', '')))::INT AS depth FROM j, json_tree(json) t
WHERE t.type NOT IN ('OBJECT', 'ARRAY') GROUP BY ALL""")
def json_leaves(spark, d):
    kind = F.when(F.schema_of_variant("leaf") == "STRING", "VARCHAR").when(F.schema_of_variant("leaf") == "VOID", "NULL").otherwise("UBIGINT")
    return payloads.json_leaves(_page_json(spark, d), ["page_id"], "json").groupBy("page_id", kind.alias("kind")).agg(F.count("*").alias("n"), F.max(F.size("place")).alias("depth"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE * 1000)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL),
x AS (SELECT vec_id, CASE vec_id % 7 WHEN 0 THEN [v] WHEN 1 THEN [v, list_reverse(v)] WHEN 2 THEN [v] WHEN 3 THEN [v] WHEN 4 THEN [v] ELSE [] END AS vs FROM e)
SELECT vec_id, (i - 1)::INT AS place, len(vs[i])::INT AS n, list_sum(vs[i])::DOUBLE AS total, vs[i][1]::DOUBLE AS first FROM (SELECT *, unnest(range(1, len(vs) + 1)) AS i FROM x)""")
def payload_vectors(spark, d):
    i = F.col("vec_id")
    v = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long"))
    text, back = F.to_json(v), F.to_json(F.reverse(v))
    wrap = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    shapes = {0: wrap('{"embedding":', text, "}"), 1: wrap('{"embeddings":[', text, ',["x"],', back, "]}"), 2: wrap('{"data":[{"index":0},{"embedding":', text, '},{"embedding":[1]}]}'), 3: wrap('{"vectors":"none","embedding":[],"vector":', text, "}"), 4: wrap('{"embedding":[1,"a"],"vectors":[', text, ",[null,1],[[2]]]}"), 5: wrap('{"vector":"', text, '"}')}
    json = text  # a bare list is no answer
    for k, shape in shapes.items():
        json = F.when(i % 7 == k, shape).otherwise(json)
    rows = read(spark, d, "embeddings").where(F.col("embedding").isNotNull()).select("vec_id", json.alias("json"))
    out = payloads.payload_vectors(rows, ["vec_id"], "json")
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return out.select("vec_id", "place", F.size("vector").alias("n"), total.alias("total"), F.get("vector", F.lit(0)).alias("first"))
