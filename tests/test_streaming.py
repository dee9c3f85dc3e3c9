"""Streamed baselines against those of all rows at once, after each batch."""

import random

import pytest

from tidemark.streaming import baselines


def test_streamed_baselines_equal_the_batch_after_every_call(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(baselines, "MOST_PARTS", 2)
    rng = random.Random(3)
    rows, folder = [], f"file://{tmp_path}/kept"
    seen = None
    for step in range(4):
        accounts = [None, "hot", *(f"a{i}" for i in range(6))] if step != 2 else ["a1", "new"]
        more = [(a if rng.random() < 0.7 or step == 2 else "hot", rng.choice([None, round(rng.uniform(-5, 50), 3), 7.0])) for a in accounts * 20]
        rows += more
        spark.createDataFrame(more, "account string, v double").coalesce(2).write.parquet(f"{tmp_path}/in/{step}")
        stream = spark.readStream.schema("account string, v double").parquet(f"{tmp_path}/in/*")
        table = lambda df: {r["account"]: tuple(r[c] for c in ("n", "mean", "median", "p75", "p90")) for r in df.collect()}
        got = table(baselines.baselines_table(stream, "account", "v", folder))
        want = table(baselines.batch_baselines(spark.createDataFrame(rows, "account string, v double"), "account", "v"))
        assert got.keys() == want.keys() and all(got[a] == pytest.approx(want[a]) for a in want)
        if step == 2:
            assert {a for a in got if got[a] != seen.get(a)} <= {"a1", "new"}
        seen = got
    assert len([p for p in (tmp_path / "kept" / "parts").iterdir() if not p.name.startswith(".")]) <= 3
    assert table(baselines.baselines_table(spark.readStream.schema("account string, v double").parquet(f"{tmp_path}/in/*"), "account", "v", folder)) == seen


def test_compaction_of_kept_parts(spark, tmp_path):
    for n in range(5):
        spark.createDataFrame([("a", n, n), (f"k{n}", n, n)], "account string, n long, batch long").coalesce(1).write.parquet(f"{tmp_path}/parts/batch-{n:09d}")
    schema = spark.read.parquet(f"{tmp_path}/parts/batch-{0:09d}").schema
    for _ in range(2):
        got = {r["account"]: r["n"] for r in baselines.compacted(spark, f"file://{tmp_path}", schema, ["account"]).collect()}
        assert got == {"a": 4, **{f"k{n}": n for n in range(5)}}
        baselines.MOST_PARTS, kept = 3, baselines.MOST_PARTS
        assert {r["account"] for r in baselines.compacted(spark, f"file://{tmp_path}", schema, ["account"]).collect()} == set(got)
        baselines.MOST_PARTS = kept
    assert [p.name for p in (tmp_path / "parts").iterdir() if not p.name.startswith(".")] == ["whole-000000004"]


def test_an_account_is_read_and_written_once_a_batch():
    """However many values it has; each call to the state store is a round trip."""
    calls, kept = [], {}

    class Value:
        def get(self):
            calls.append("get")
            return kept.get("v")

        def update(self, v):
            calls.append("update")
            kept["v"] = v

    class Handle:
        def getValueState(self, name, schema):  # noqa: N802, ARG002
            return Value()

    counts = baselines._Counts(0.5)
    counts.init(Handle())
    for seen in (1, 2):
        rows = [("a", cell, 2) for cell in [*range(1000), 7]]
        (got,) = counts.handleInputRows(("a",), iter(rows), None)
        assert (got["account"], got["n"], got["median"]) == ("a", 2002 * seen, 249.5)
    assert calls == ["get", "update"] * 2
