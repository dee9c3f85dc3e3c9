"""A table kept as its log of changes: appended events over a snapshot, named by a manifest."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.steps import cut

#: Keys of changes that may be broadcast; they are counted first.
BROADCAST_KEYS = 50_000


class ChangeLog:
    """Rows by ``key`` with ``fields`` (atomic types), below ``folder``.

    A merge compares the given rows with the current ones and appends an event
    for each that makes a difference, so running it again appends nothing.  A
    batch counts once a manifest names it; the manifest's file appears by one
    rename that fails where another writer was first.  ``compact`` writes the
    current rows as a new snapshot; readers of the old one keep it until
    ``vacuum``.  A null value in a change means not given.  Rows with a null key
    are invalid and never written; of several rows of a key in one merge the
    last in ``order`` counts.
    """

    EVENT = "kind string, at long, before map<string,string>, after map<string,string>, reason string, operator string"

    def __init__(self, spark: SparkSession, folder: str, key: str, fields: dict[str, str]):
        self.spark, self.folder, self.key, self.fields = spark, folder.rstrip("/"), key, fields
        names = spark._jvm.org.apache.hadoop.fs
        self._path = lambda *parts: names.Path("/".join([self.folder, *parts]))
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("x").getFileSystem(self._conf)
        self._files = names

    # ------------------------------------------------------------------ manifests

    def manifest(self) -> tuple[int, dict]:
        """The number and content of the newest manifest."""
        folder = self._path("manifest")
        if not self._fs.exists(folder):
            return 0, {"snapshot": None, "batches": [], "archive": [], "next": 1}
        last = max(name for s in self._fs.listStatus(folder) if (name := s.getPath().getName()).isdigit())
        stream = self._fs.open(self._path("manifest", last))
        try:
            return int(last), json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, seen: int, content: dict) -> None:
        draft, final = self._path("manifest", f"draft-{uuid.uuid4().hex}"), self._path("manifest", f"{seen + 1:09d}")
        stream = self._fs.create(draft, True)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        never = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        qualified = lambda p: self._fs.makeQualified(p)
        self._files.FileContext.getFileContext(qualified(final).toUri(), self._conf).rename(qualified(draft), qualified(final), never)

    # ------------------------------------------------------------------ reading

    def _schema(self) -> str:
        return ", ".join(f"`{n}` {t}" for n, t in self.fields.items())

    def _base(self, content: dict) -> DataFrame:
        if content["snapshot"]:
            return self.spark.read.parquet(f"{self.folder}/{content['snapshot']}").select(*self.fields)
        return self.spark.createDataFrame([], self._schema())

    def _events(self, batches: list[str]) -> DataFrame:
        schema = f"`{self.key}` {self.fields[self.key]}, {self.EVENT}"
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{b}" for b in batches]) if batches else self.spark.createDataFrame([], schema)

    def log(self) -> DataFrame:
        """Every event that was ever written: key, kind, at, before, after, reason, operator."""
        return self._events(self.manifest()[1]["archive"])

    def current(self, only: DataFrame | None = None) -> DataFrame:
        """The rows as the newest manifest has them; those of the keys in ``only`` if given."""
        return self._rows(self.manifest()[1], only)

    def _rows(self, content: dict, only: DataFrame | None = None) -> DataFrame:
        base, k = self._base(content), self.key
        if only is not None:
            base = base.join(only, k, "left_semi")
        if not content["batches"]:
            return base
        events = self._events(content["batches"])
        if only is not None:
            events = events.join(only, k, "left_semi")
        values = [f for f in self.fields if f != k]
        last = [F.max(F.when(F.map_contains_key("after", F.lit(f)), F.struct("at", F.col("after")[f].alias("v")))).alias(f"__{i}") for i, f in enumerate(values)]
        birth = F.max(F.when(F.col("kind").isin("create", "delete"), F.struct("at", "kind"))).alias("__birth")
        changed = cut(events.groupBy(k).agg(birth, *last))
        side = F.broadcast(changed) if changed.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else changed
        born = F.col("__birth.kind") == "create"
        given = lambda i: F.col(f"__{i}.v").cast(self.fields[values[i]])
        anew = lambda i: F.when(F.col(f"__{i}.at") >= F.col("__birth.at"), given(i))
        stay = [F.when(born, anew(i)).otherwise(F.when(F.col(f"__{i}").isNotNull(), given(i)).otherwise(F.col(f))).alias(f) for i, f in enumerate(values)]
        kept = base.join(side, k, "left").where(F.col("__birth").isNull() | born).select(k, *stay)
        new = changed.where(born).select(k, *[anew(i).alias(f) for i, f in enumerate(values)])
        there = base.join(F.broadcast(new.select(k)) if side is not changed else new.select(k), k, "left_semi").select(k)
        return kept.unionByName(new.join(there, k, "left_anti")).select(*self.fields)

    # ------------------------------------------------------------------ writing

    def start(self, rows: DataFrame) -> None:
        """The first snapshot."""
        seen, content = self.manifest()
        name = f"snapshots/{uuid.uuid4().hex}"
        rows.select(*[F.col(f).cast(t).alias(f) for f, t in self.fields.items()]).write.parquet(f"{self.folder}/{name}")
        self._commit(seen, {**content, "snapshot": name, "batches": []})

    def merge(self, changes: DataFrame, how: str = "upsert", order: list[Column] = (), reason: str = "", operator: str = "local") -> dict[str, int]:
        """Applies rows of changes; returns how many were created, updated, unchanged, missing (``how`` update), existing (``how`` insert), invalid."""
        seen, content = self.manifest()
        k, given = self.key, [c for c in changes.columns if c != self.key and c in self.fields]
        rank = F.struct(*order, *given) if order or given else F.lit(0)
        rows = cut(changes.groupBy(k).agg(F.max_by(F.struct(F.lit(1).alias("__one"), *given), rank).alias("__c")).select(k, *[F.col(f"__c.{f}").cast(self.fields[f]).alias(f"__new_{f}") for f in given]))
        keys = rows.select(k)
        now = self._rows(content, F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys)
        both = rows.join(now.select(k, F.lit(True).alias("__here"), *given), k, "left")
        differs = F.lit(False)
        for f in given:
            a, b = ((F.round(F.col(c), 6) if self.fields[f] in ("double", "float") else F.col(c)) for c in (f"__new_{f}", f))
            differs |= F.col(f"__new_{f}").isNotNull() & ~a.eqNullSafe(b)
        here = F.col("__here").isNotNull()
        absent = "missing" if how == "update" else "created"
        status = F.when(F.col(k).isNull(), "invalid").when(~here, absent).when(F.lit(how == "insert"), "existing").when(differs, "updated").otherwise("unchanged")
        text = lambda prefix: F.map_filter(F.create_map(*[x for f in given for x in (F.lit(f), F.struct(F.col(f"__new_{f}").cast("string").alias("new"), F.col(f).cast("string").alias("old")))]), lambda _, v: v["new"].isNotNull() & (~here | ~v["new"].eqNullSafe(v["old"])))  # noqa: E731, ARG005
        pairs = text("") if given else F.create_map().cast("map<string,struct<new:string,old:string>>")
        judged = cut(both.select(k, status.alias("status"), F.transform_values(pairs, lambda _, v: v["old"]).alias("before"), F.transform_values(pairs, lambda _, v: v["new"]).alias("after")))
        events = judged.where(F.col("status").isin("created", "updated")).withColumn("kind", F.when(F.col("status") == "created", "create").otherwise("update"))
        self._append(seen, content, events, reason, operator)
        return {r["status"]: r["n"] for r in judged.groupBy("status").agg(F.count("*").alias("n")).collect()}

    def delete(self, keys: DataFrame, reason: str = "", operator: str = "local") -> dict[str, int]:
        """Deletes rows by key; returns how many were deleted and how many are missing."""
        seen, content = self.manifest()
        asked = cut(keys.select(self.key).distinct())
        found = cut(self._rows(content, asked).select(self.key))
        none = F.create_map().cast("map<string,string>")
        self._append(seen, content, found.select(self.key, F.lit("delete").alias("kind"), none.alias("before"), none.alias("after")), reason, operator)
        n = found.count()
        return {"deleted": n, "missing": asked.count() - n}

    def _append(self, seen: int, content: dict, events: DataFrame, reason: str, operator: str) -> None:
        if events.isEmpty():
            return
        name = f"events/{content['next']:09d}-{uuid.uuid4().hex}"
        rows = events.select(self.key, "kind", F.lit(content["next"]).cast("long").alias("at"), "before", "after", F.lit(reason).alias("reason"), F.lit(operator).alias("operator"))
        rows.write.parquet(f"{self.folder}/{name}")
        self._commit(seen, {**content, "batches": [*content["batches"], name], "archive": [*content["archive"], name], "next": content["next"] + 1})

    def compact(self) -> None:
        """The current rows as a new snapshot; the log's events stay readable."""
        seen, content = self.manifest()
        name = f"snapshots/{uuid.uuid4().hex}"
        self._rows(content).write.parquet(f"{self.folder}/{name}")
        self._commit(seen, {**content, "snapshot": name, "batches": []})

    def vacuum(self) -> int:
        """Deletes snapshots, batches and manifests that the newest manifest doesn't need; returns how many."""
        number, content = self.manifest()
        keep = {content["snapshot"], *content["archive"], f"manifest/{number:09d}"}
        gone = 0
        for kind in ("snapshots", "events", "manifest"):
            folder = self._path(kind)
            for s in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
                if f"{kind}/{s.getPath().getName()}" not in keep:
                    gone += bool(self._fs.delete(s.getPath(), True))
        return gone
