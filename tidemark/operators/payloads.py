"""Values out of JSON of any shape and depth, by VARIANT: leaves, media paths, vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.steps import cut

# ---- fixed values: what a key or an ending says about a path, in order ----
VIDEO, IMAGE, AUDIO, TEXT = ([".mp4", ".mov", ".m4v", ".webm"], [".jpg", ".jpeg", ".png", ".webp"], [".wav", ".mp3", ".m4a", ".aac", ".flac"], [".json", ".srt", ".vtt", ".txt"])
PATH_RULES = [
    ("video", ["video"], VIDEO), ("cover", ["cover", "poster"], []), ("frame", ["frame", "shot"], []), ("audio", ["audio", "wav"], AUDIO), ("ocr", ["ocr"], []),
    ("transcript", ["transcript", "subtitle", "asr"], []), ("features", ["feature"], []), ("cover", [], IMAGE), ("transcript", [], TEXT),
]
VECTOR_KEYS = ["embeddings", "embedding", "vectors", "vector"]
# ---- end of fixed values ----


def _is_container(v: Column) -> Column:
    return F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)")


def json_leaves(df: DataFrame, keys: list[str], json: str) -> DataFrame:
    """Every value in the JSON that is no object or list: keys, name (of the nearest field), place (its positions from the top), leaf (variant).

    Each level of nesting is one pass over the containers that are left, until
    none are; the deepest text sets the number of passes, and a row's values
    stand on rows of their own from the first one on.  Fields are in order of
    their names, as VARIANT keeps them.  Invalid or null JSON has no leaves.
    """
    spark, own = df.sparkSession, [f"__k{i}" for i in range(len(keys))]
    level = df.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.lit("").alias("__name"), F.array().cast("array<int>").alias("__place"), F.try_parse_json(F.col(json)).alias("__v")).where(F.col("__v").isNotNull())
    parts = [level.where(~_is_container(F.col("__v")))]
    while True:
        opened = level.where(_is_container(F.col("__v"))).lateralJoin(spark.tvf.variant_explode(F.col("__v").outer()))
        level = cut(opened.select(*own, F.coalesce(F.col("key"), F.col("__name")).alias("__name"), F.concat("__place", F.array(F.col("pos").cast("int"))).alias("__place"), F.col("value").alias("__v")))
        parts.append(level.where(~_is_container(F.col("__v"))))
        if level.where(_is_container(F.col("__v"))).isEmpty():
            break
    found = reduce(DataFrame.unionByName, parts)
    return found.select(*[F.col(o).alias(k) for k, o in zip(keys, own, strict=True)], F.col("__name").alias("name"), F.col("__place").alias("place"), F.col("__v").alias("leaf"))


def ending(path: Column) -> Column:
    """A path's ending with its point, lower-cased, without what follows a question mark; blank if there is none."""
    return F.lower(F.regexp_extract(F.substring_index(path, "?", 1), r"[^/][^/]*?(\.[^./]+)/*$", 1))


def path_category(name: Column, path: Column) -> Column:
    """What a text in JSON names, by its field's name and its ending; null for other texts."""
    low, end = F.lower(name), ending(path)
    out = None
    for category, words, endings in PATH_RULES:
        test = reduce(lambda a, b: a | b, [*[F.contains(low, F.lit(w)) for w in words], *([end.isin(endings)] if endings else [])])
        out = F.when(test, category) if out is None else out.when(test, category)
    return out


def media_paths(df: DataFrame, keys: list[str], json: str) -> DataFrame:
    """The paths that JSON of any shape holds: keys, category, name, place, path."""
    said = F.trim(F.try_variant_get("leaf", "$", "string"))
    texts = json_leaves(df, keys, json).where(F.schema_of_variant("leaf") == "STRING").withColumn("path", said).where(F.col("path") != "")
    return texts.withColumn("category", path_category(F.col("name"), F.col("path"))).where(F.col("category").isNotNull()).select(*keys, "category", "name", "place", "path")


def _numbers(v: Column) -> Column:
    """A variant's entries as doubles; null unless it is a list of numbers, one at least."""
    listed = F.try_variant_get(v, "$", "array<double>")
    plain = F.schema_of_variant(v).rlike(r"^ARRAY<(BIGINT|DECIMAL\([0-9,]+\)|DOUBLE|FLOAT)>$")
    return F.when(plain & (F.size(listed) > 0) & ~F.exists(listed, lambda x: x.isNull()), listed)


def _vectors(v: Column) -> Column:
    """The vectors that a variant is or lists; empty for anything else."""
    inner = F.filter(F.transform(F.try_variant_get(v, "$", "array<variant>"), _numbers), lambda x: x.isNotNull())
    return F.when(_numbers(v).isNotNull(), F.array(_numbers(v))).otherwise(F.coalesce(inner, F.array().cast("array<array<double>>")))


def payload_vectors(df: DataFrame, keys: list[str], json: str) -> DataFrame:
    """Vectors of an embedding service's answer, from the first field that has any: keys, place (from 0), vector.

    Fields are embeddings, embedding, vectors, vector, each a vector or a list
    of them, and then the embedding of each entry of data.  Lists that hold
    anything but numbers are no vectors; an answer without one has no rows.
    """
    answer = F.try_parse_json(F.col(json))
    fields = [F.try_variant_get(answer, f"$.{k}", "variant") for k in VECTOR_KEYS]
    entries = F.transform(F.try_variant_get(answer, "$.data", "array<variant>"), lambda e: F.try_variant_get(e, "$.embedding", "variant"))
    every = F.concat(F.array(*[_vectors(f) for f in fields]), F.coalesce(F.transform(entries, _vectors), F.array().cast("array<array<array<double>>>")))
    best = F.get(F.filter(every, lambda x: F.size(x) > 0), F.lit(0))
    own = [f"__k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.posexplode(best).alias("place", "vector"))
    return rows.select(*[F.col(o).alias(k) for k, o in zip(keys, own, strict=True)], "place", "vector")
