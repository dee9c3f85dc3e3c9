"""The bank of prototypes, and which of them a text fits best."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.texts import blank, token_list
from tidemark.operators import prototypes
from tidemark.operators.steps import cut

# ---- fixed values: keywords that count, the least number that they are held against, and what trust is worth ----
MOST_WORDS, LEAST_WORDS = 10, 3
TRUST_FLOOR, TRUST_SHARE = 0.65, 0.35
MATURE = 3
# ---- end of fixed values ----
DIM = 128
#: Targets of an account in one piece of work, and prototypes that are compared at a time.
DEAL, STRIDE = 4_096, 16


def dense_vectors(df: DataFrame, key: str, text: Column, dim: int = DIM) -> DataFrame:
    """Hashed text vectors as arrays: key, v; null for texts without tokens."""
    slots = prototypes.hashed_vectors(df.select(key, token_list(text).alias("__tokens")), key, "__tokens", dim)
    packed = slots.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("slot", "weight"))).alias("__m"))  # at most dim entries
    return packed.select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("__m", i), F.lit(0.0))).alias("v"))


def prototype_bank(samples: DataFrame, account: str, group: list[str], value: str, views: str, score: str, title: str, order: list[Column], words: int = 8, examples: int = 3) -> DataFrame:
    """An account's groups of scored samples as prototypes, best first.

    Returns account, name, n, avg_score, confidence, stability, lift (the
    group's upper quarter over the account's), keywords, place and v, the vector
    of its keywords and its best titles.
    """
    keys = [account, *group]
    rows = cut(samples.where(F.col(account).isNotNull()))
    name = F.concat_ws("|", *[blank(F.col(g).cast("string")) for g in group])
    groups = prototypes.prototypes(rows, keys, value, views, score)
    whole = prototypes.spread_percentiles(rows, [account], value, {"__p": 0.75}).drop("n")
    said = F.array_distinct(F.filter(F.split(F.lower(blank(F.col(title))), r"\s+"), lambda w: w != ""))
    weighted = prototypes.weighted_keywords(rows.withColumn("__words", said), keys, "__words", score, words)
    listed = weighted.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "keyword"))), lambda x: x["keyword"]).alias("keywords"))
    first = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= examples)
    titles = first.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__r", title))), lambda x: blank(x[title])), " ").alias("__titles"))
    out = groups.withColumn("name", name)
    for df in (listed, titles):
        side = df.select(F.col(account).alias("__a"), F.concat_ws("|", *[blank(F.col(g).cast("string")) for g in group]).alias("__n"), *[c for c in df.columns if c not in keys])
        out = out.join(side, (F.col(account) == F.col("__a")) & (F.col("name") == F.col("__n")), "left").drop("__a", "__n")
    lift = F.coalesce(F.try_divide("p75_value", "__p"), F.lit(0.0))
    out = cut(out.join(whole, account, "left").withColumns({"lift": lift, "keywords": F.coalesce("keywords", F.array().cast("array<string>")), "__id": F.to_json(F.struct(F.col(account).alias("a"), "name"))}))
    vectors = dense_vectors(out, "__id", F.concat_ws(" ", F.array_join("keywords", " "), "__titles"))
    best = [F.desc(F.col("n") >= MATURE), F.desc("stability_rank"), F.desc("lift"), F.desc(F.col("avg_score") * F.col("confidence")), F.desc("n"), F.desc("max_value"), F.asc("name")]
    ranked = out.join(vectors, "__id", "left").withColumn("place", F.row_number().over(Window.partitionBy(account).orderBy(*best)))
    return ranked.select(F.col(account).alias("account"), "name", "n", "avg_score", "confidence", "stability", "lift", "keywords", "place", "v")


def prototype_fits(targets: DataFrame, bank: DataFrame, key: str, account: str, text: str, k: int = 5) -> DataFrame:
    """The k prototypes of its account that each text fits best: key, rank, name, similarity, overlap, fit.

    A fit is the better of two likenesses, of vectors and of keywords, times the
    prototype's worth; no likeness is above 1, so a worth bounds the fits.
    Prototypes are compared by falling worth, some at a time, and no further
    once every text's k-th best reaches the next one's worth.
    """
    rows = cut(targets.select(F.col(key).alias("key"), F.col(account).alias("account"), F.lower(blank(F.col(text))).alias("text")))
    asked = rows.join(dense_vectors(rows, "key", F.col("text")), "key", "left")
    sizes = asked.groupBy("account").agg(F.ceil(F.count("*") / DEAL).cast("int").alias("__w"))
    left = asked.join(sizes, "account").withColumn("salt", F.pmod(F.xxhash64("key"), F.col("__w")).cast("int")).drop("__w")
    worth = F.col("avg_score") * (TRUST_FLOOR + TRUST_SHARE * F.col("confidence"))
    right = bank.join(sizes, "account").select(F.col("account").alias("a2"), F.explode(F.sequence(F.lit(0), F.col("__w") - 1)).alias("s2"), "name", F.slice("keywords", 1, MOST_WORDS).alias("words"), F.size("keywords").alias("size"), F.col("v").alias("w"), worth.alias("worth"))

    def matrix(column) -> np.ndarray:
        m = np.array([np.zeros(DIM) if v is None else v for v in column], np.float64).reshape(len(column), DIM)
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    def best(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"key": x["key"][:0], "name": pd.Series([], dtype=object), "similarity": [], "overlap": [], "fit": []})
        y = y.sort_values(["worth", "name"], ascending=[False, True], kind="stable")
        a, b, value = matrix(x["v"]), matrix(y["w"]), y["worth"].to_numpy()
        texts, found = x["text"].tolist(), []
        kth = np.full(len(x), -1.0)
        for at in range(0, len(y), STRIDE):
            if (np.round(kth, 9) > np.round(value[at], 9)).all():
                break
            some = slice(at, at + STRIDE)
            cosine = np.clip(a @ b[some].T, 0, 1)
            overlap = np.array([[min(1.0, sum(w.lower() in t for w in words if w) / max(LEAST_WORDS, min(MOST_WORDS, n))) if t and n else 0.0 for words, n in zip(y["words"].to_numpy()[some], y["size"].to_numpy()[some], strict=True)] for t in texts])
            found.append((cosine, overlap, np.maximum(cosine, overlap) * value[some]))
            fits = np.concatenate([f for *_, f in found], 1)
            if fits.shape[1] >= k:
                kth = -np.partition(-fits, k - 1, axis=1)[:, k - 1]
        cosine, overlap, fits = (np.concatenate(part, 1) for part in zip(*found, strict=True))
        names = y["name"].to_numpy()[: fits.shape[1]]
        rank = np.array([np.lexsort((names, -np.round(row, 9)))[:k] for row in fits])
        take = lambda m: np.take_along_axis(m, rank, 1).ravel()
        return pd.DataFrame({"key": np.repeat(x["key"].to_numpy(), rank.shape[1]), "name": names[rank].ravel(), "similarity": take(cosine), "overlap": take(overlap), "fit": take(fits)})

    kind = dict(rows.dtypes)["key"]
    found = left.groupBy("account", "salt").cogroup(right.groupBy("a2", "s2")).applyInPandas(best, f"key {kind}, name string, similarity double, overlap double, fit double")
    order = Window.partitionBy("key").orderBy(F.desc(F.round("fit", 9)), "name")
    return found.withColumn("rank", F.row_number().over(order)).select(F.col("key").alias(key), "rank", "name", "similarity", "overlap", "fit")
