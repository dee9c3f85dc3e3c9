"""Rows of captured history: which of them count, where their numbers come from, and what a table of them amounts to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import clamp, safe_ratio


def _text(col: Column) -> Column:
    return F.trim(F.coalesce(col.cast("string"), F.lit("")))


def _some(col: Column) -> Column:
    return F.coalesce(col.cast("double"), F.lit(0.0)) > 0


def conjunction(df: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Rows that have every wanted value; None asks for nothing."""
    tests = [F.col(c) == F.lit(v) for c, v in wanted.items() if v is not None]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def research_eligible(item: Column, *rewards: Column) -> Column:
    """An item is named and one of its rewards (for memory: or counters) is above zero."""
    return (_text(item) != "") & reduce(lambda a, b: a | b, [_some(r) for r in rewards])


def is_mock(source_kind: Column, raw: Column) -> Column:
    """Made-up rows: by their kind, or by the source that their raw form names first."""
    named = F.coalesce(*[F.nullif(_text(F.get_json_object(raw, f"$.{k}")), F.lit("")) for k in ("sample_source", "source", "source_kind")], F.lit(""))
    return F.contains(F.lower(_text(source_kind)), F.lit("mock")) | (F.lower(named) == "mock")


def prototype_signal(views: Column, floor: int, *rewards: Column) -> Column:
    """Enough views; where none are known, and none are asked for, any reward."""
    return F.when(_some(views), views >= floor).otherwise(reduce(lambda a, b: a | b, [_some(r) for r in rewards]) if floor <= 0 else F.lit(False))


def trainable(mock: Column, item: Column, sample_key: Column, *metrics: Column) -> Column:
    """No mock, known by item or by a title key, and with a counter above zero."""
    stable = (_text(item) != "") | (F.startswith(_text(sample_key), F.lit("title:")) & (F.length(_text(sample_key)) > 6))
    return ~mock & stable & reduce(lambda a, b: a | b, [_some(m) for m in metrics])


def play_missing(views: Column, raw: Column) -> Column:
    """Whether the play count is unknown: by the row's own note on its metrics, else by the count."""
    noted = F.get_json_object(raw, "$.metric_availability.views")
    return F.when(noted.isNotNull(), F.lower(noted).isin("false", "0", "")).otherwise(~_some(views))


def account_scopes(df: DataFrame, account: str, least: int = 50) -> DataFrame:
    """For each account the rows it is judged by: its own if there are ``least`` of them, else all; account, rows, scope, reason."""
    n = df.groupBy(account).agg(F.count("*").alias("rows"))
    own = (F.col("rows") >= least) & (_text(F.col(account)) != "")
    return n.select(account, "rows", F.when(own, "account").otherwise("global_fallback").alias("scope"), F.when(own, "").otherwise("target_account_below_50_samples").alias("reason"))


def first_metric(raw: Column, source: str, keys: list[str]) -> Column:
    """struct(value, source): the first filled key at the root, then under statistics, then under metrics, and where it stood."""
    tries = []
    for place in ("", "statistics.", "metrics."):
        for key in keys:
            value = F.get_json_object(raw, f"$.{place}{key}")
            tries.append(F.when(_text(value) != "", F.struct(value.alias("value"), F.lit(f"{source}.{place}{key}").alias("source"))))
    return F.coalesce(*tries, F.struct(F.lit(None).cast("string").alias("value"), F.lit("").alias("source")))


def metric_source(*sources: Column) -> Column:
    """One name for where a row's metrics came from."""
    heads = F.array_sort(F.array_distinct(F.filter(F.array(*[F.substring_index(_text(s), ".", 1) for s in sources]), lambda x: x != "")))
    both = F.array_contains(heads, "raw_api") & F.array_contains(heads, "clean_json")
    return F.when(F.size(heads) == 0, "none").when(both, "mixed_raw_api_clean_json").otherwise(F.array_join(heads, "|"))


def contract(df: DataFrame, columns: dict[str, tuple[Column, object]]) -> DataFrame:
    """Fixed output columns, each with its default."""
    return df.select(*[F.coalesce(c, F.lit(default)).alias(name) for name, (c, default) in columns.items()])


def lookup_last(df: DataFrame, other: DataFrame, key: str, order: str, take: list[str]) -> DataFrame:
    """Each row with the last row of ``other`` that has its key."""
    last = other.groupBy(key).agg(F.max_by(F.struct(*take), order).alias("__l"))
    return df.join(last, key, "left").select(*df.columns, *[F.col(f"__l.{c}").alias(c) for c in take])


def import_report(df: DataFrame, key: str, order: list[str], known: DataFrame, known_key: str) -> DataFrame:
    """Rows of an import numbered as in their file (from 2, below the header) with whether each is linked; a file is one sorted range a partition key."""
    ids = known.select(F.col(known_key).alias("__k")).distinct()
    return df.join(ids, F.col(key) == F.col("__k"), "left").withColumn("row", F.row_number().over(Window.partitionBy(order[0]).orderBy(*order[1:])) + 1).withColumn("linked", F.col("__k").isNotNull()).drop("__k")


def missing_fields(df: DataFrame, fields: dict[str, Column], k: int = 6) -> DataFrame:
    """The fields that most rows lack: field, missing."""
    one = df.agg(*[F.count_if(~c).alias(n) for n, c in fields.items()]).withColumn("__one", F.lit(1))
    return one.unpivot(["__one"], list(fields), "field", "missing").select("field", "missing").where("missing > 0").orderBy(F.desc("missing"), "field").limit(k)


def queue_diversity(df: DataFrame, order: list[Column], kind: str, structure: str) -> DataFrame:
    """Adds diversity: 100 less 9 for each row of the same kind before it and 7 for each of the same structure."""
    seen = lambda c: F.row_number().over(Window.partitionBy(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown"))).orderBy(*order)) - 1
    return df.withColumn("diversity", clamp(100.0 - seen(kind) * 9 - seen(structure) * 7))


def top_shares(df: DataFrame, group: str, label: str, order: list[Column], reward: str, k: int = 10) -> DataFrame:
    """Of each group's first k: mean reward, lift, and how much of what could be high or low there is: n, top_reward, lift, high_rate, low_avoidance."""
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    top = F.col("__r") <= k
    out = ranked.groupBy(group).agg(F.count("*").alias("n"), F.avg(F.when(top, F.col(reward))).alias("top_reward"), F.avg(reward).alias("__all"), *[F.count_if(F.col(label) == x).alias(f"__{x}") for x in ("high", "low")], *[F.count_if(top & (F.col(label) == x)).alias(f"__top_{x}") for x in ("high", "low")])
    share = lambda x: F.col(f"__top_{x}") / F.greatest(F.lit(1), F.least(F.lit(k), F.col(f"__{x}")))
    return out.select(group, "n", "top_reward", (F.col("top_reward") / F.greatest(F.lit(1e-6), F.col("__all"))).alias("lift"), share("high").alias("high_rate"), (1 - share("low")).alias("low_avoidance"))


def repeated_in_top(df: DataFrame, group: str, key: str, order: list[Column], k: int) -> DataFrame:
    """Keys that stand more than once among the first k of their group: group, key, n."""
    top = df.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__r") <= k)
    return top.groupBy(group, key).agg(F.count("*").alias("n")).where("n > 1")


def three_cuts(df: DataFrame, group: str, label: str, order: list[Column], key: str, k: int = 8) -> DataFrame:
    """Cuts of one order for each group: the first k of all, of the high and of the low ones; group, cut, rank, key."""
    long = df.withColumn("cut", F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col(label).isin("high", "low"), F.col(label))))))
    return long.withColumn("rank", F.row_number().over(Window.partitionBy(group, "cut").orderBy(*order))).where(F.col("rank") <= k).select(group, "cut", "rank", key)


def reranked(df: DataFrame, first: list[Column], again: list[Column], k: int, more: int = 3) -> DataFrame:
    """The k best by ``again`` of the ``more * k`` best by ``first``; adds base_rank and new_rank."""
    one = df.orderBy(*first).limit(more * k)  # bounded: the two ranks are of so many rows
    w = Window.partitionBy(F.lit(0))
    return one.withColumn("base_rank", F.row_number().over(w.orderBy(*first))).withColumn("new_rank", F.row_number().over(w.orderBy(*again))).where(F.col("new_rank") <= k)


def by_severity(df: DataFrame, severity: str, order: list[str], *more: Column) -> list[Column]:
    """Order by a named severity, then by ``more``."""
    place = reduce(lambda rest, x: F.when(F.col(severity) == x[1], F.lit(x[0])).otherwise(rest), enumerate(order), F.lit(len(order)))
    return [place.asc(), *more]


def best_fit(keys: list[str], fit: str, *tables: DataFrame) -> DataFrame:
    """Union of tables where each key keeps its best fit."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return both.groupBy(*keys).agg(F.max(fit).alias(fit), F.count("*").alias("offers"))


def dataset_summary(df: DataFrame, keys: list[str], item: str, reward: str, label: str) -> DataFrame:
    """Rows, different items, labelled rows, mean and best reward, and whether items repeat, of each dataset."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(item).alias("items"), F.count(label).alias("labelled"), F.avg(reward).alias("mean"), F.max(reward).alias("best"), safe_ratio(F.count(label), F.count("*")).alias("coverage")).withColumn("repeats", F.col("n") > F.col("items"))


def identity(item: Column, sample_key: Column, row_id: Column) -> Column:
    """What a captured row is one of: its item, else its title key, else itself."""
    title = F.when(F.startswith(_text(sample_key), F.lit("title:")) & (F.length(_text(sample_key)) > 6), _text(sample_key))
    return F.coalesce(F.when(_text(item) != "", F.concat(F.lit("item:"), _text(item))), title, F.concat(F.lit("id:"), row_id.cast("string")))


def lookup_by_name(df: DataFrame, name: str, other: DataFrame, other_name: str, other_id: str, found: str) -> DataFrame:
    """Each row with the least identifier of ``other`` whose name is the same without regard to case."""
    ids = other.groupBy(F.lower(F.trim(other_name)).alias("__n")).agg(F.min(other_id).alias(found))
    return df.join(ids, F.lower(F.trim(F.col(name))) == F.col("__n"), "left").select(*df.columns, found)


def prototype_order(count: str, stability: str, lift: str, score: str, confidence: str, best: str) -> list[Column]:
    """Mature groups (three rows) first, then by stability, lift, score times confidence, rows and best row."""
    return [(F.col(count) >= 3).desc(), F.desc(stability), F.desc(lift), (F.col(score) * F.col(confidence)).desc(), F.desc(count), F.desc(best)]


def scope_stats(df: DataFrame, keys: list[str], identity: Column, item: str, order: list[str], flags: dict[str, Column], metrics: list[str]) -> DataFrame:
    """What each scope stores and knows: rows, different ones (each by its best row), repeated items, flagged rows, known metrics.

    ``flags`` must name ``mock``; all figures but stored, different and repeats leave mock rows out.
    """
    facts = {**flags, **{f"known_{m}": _some(F.col(m)) for m in metrics}}
    rows = df.select(*keys, identity.alias("__id"), _text(F.col(item)).alias("__item"), F.struct(*order).alias("__o"), F.struct(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in facts.items()]).alias("__f"))
    best = rows.groupBy(*keys, "__id").agg(F.count("*").alias("__n"), F.max("__item").alias("__item"), F.max_by("__f", "__o").alias("__f"))
    formal = ~F.col("__f.mock")
    g = best.groupBy(*keys).agg(
        F.sum("__n").alias("stored"), F.count("*").alias("different"), F.count_if((F.col("__n") > 1) & (F.col("__item") != "")).alias("repeats"), F.count_if(formal).alias("formal"),
        *[F.count_if(formal & F.col(f"__f.{n}")).alias(n) for n in facts if n != "mock"],
    )
    return g.withColumns({f"{n}_rate": safe_ratio(F.col(n), F.col("formal")) for n in facts if n != "mock"})


def batch_summary(df: DataFrame, saved: Column, account: str, fields: str, k: int = 6, accounts: int = 8) -> DataFrame:
    """A calibration batch in one long table (part, name, n): rows pending and saved, the fields that most rows ask for, the accounts with most rows."""
    pending = df.where(~saved)
    counts = df.agg(F.count_if(~saved).alias("pending"), F.count_if(saved).alias("saved")).withColumn("part", F.lit("rows")).unpivot(["part"], ["pending", "saved"], "name", "n")

    def most(names: DataFrame, part: str, limit: int) -> DataFrame:
        return names.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(limit).select(F.lit(part).alias("part"), "name", "n")

    named = F.coalesce(F.nullif(_text(F.col(account)), F.lit("")), F.lit("unknown"))
    return counts.unionByName(most(pending.select(F.explode(fields).alias("name")), "fields", k)).unionByName(most(pending.select(named.alias("name")), "accounts", accounts))


def first_filled(*tables: DataFrame) -> DataFrame:
    """The rows of the first table that has any, so later sources only stand in for empty ones; the tables have the same columns."""
    out = tables[-1]
    for t in reversed(tables[:-1]):
        some = t.limit(1).select(F.lit(True).alias("__some"))  # one row at most
        out = t.unionByName(out.join(F.broadcast(some), F.lit(True), "left_anti"), allowMissingColumns=True)
    return out


def joined_text(*parts: Column) -> Column:
    """Fields as one text, blank where they are missing, each with its space."""
    return F.concat_ws(" ", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
