"""The change log against a plain dict: merges, deletes, compaction, readers and writers beside each other."""

import random

import pytest

from tidemark.sources.changelog import ChangeLog

FIELDS = {"id": "int", "name": "string", "score": "double", "n": "long"}


def state(log):
    rows = log.current().collect()
    assert len({r["id"] for r in rows}) == len(rows)
    return {r["id"]: (r["name"], r["score"], r["n"]) for r in rows}


def test_random_changes_equal_a_dict(spark, tmp_path):
    rng = random.Random(4)
    log = ChangeLog(spark, f"file://{tmp_path}/t", "id", FIELDS)
    want = {i: (f"n{i}", i / 3, i) for i in range(30)}
    log.start(spark.createDataFrame([(i, *v) for i, v in want.items()], "id int, name string, score double, n long"))
    for step in range(6):
        how = rng.choice(["upsert", "update", "insert"])
        rows = {i: (rng.choice([None, "", "x", f"n{i}"]), rng.choice([None, i / 3, 1.5, i / 3 + 1e-9])) for i in rng.sample(range(45), 14)}
        expected = {"created": 0, "updated": 0, "unchanged": 0, "missing": 0, "existing": 0}
        for i, (name, score) in rows.items():
            if i not in want:
                expected["missing" if how == "update" else "created"] += 1
                if how != "update":
                    want[i] = (name, score, None)
            elif how == "insert":
                expected["existing"] += 1
            else:
                a, b, n = want[i]
                differs = (name is not None and name != a) or (score is not None and (b is None or round(score, 6) != round(b, 6)))
                expected["updated" if differs else "unchanged"] += 1
                if differs:
                    want[i] = (a if name is None else name, b if score is None else score, n)
        df = spark.createDataFrame([(i, *v) for i, v in rows.items()], "id int, name string, score double")
        assert log.merge(df, how) == {k: v for k, v in expected.items() if v}
        assert state(log) == want
        before = log.manifest()
        again = log.merge(df, how)  # a rerun changes nothing
        assert not {"created", "updated"} & set(again) and (log.manifest() == before)
        if step == 2:
            gone = rng.sample(sorted(want), 5)
            assert log.delete(spark.createDataFrame([(i,) for i in [*gone, 900, 900]], "id int")) == {"deleted": 5, "missing": 1}
            for i in gone:
                del want[i]
            assert state(log) == want
        if step == 4:
            events = log.log().count()
            log.compact()
            assert state(log) == want and log.manifest()[1]["batches"] == [] and log.log().count() == events
            assert log.vacuum() > 0 and state(log) == want and log.log().count() == events


def test_a_deleted_row_comes_back_without_its_old_values(spark, tmp_path):
    log = ChangeLog(spark, f"file://{tmp_path}/t", "id", FIELDS)
    log.start(spark.createDataFrame([(1, "a", 1.0, 1)], "id int, name string, score double, n long"))
    log.merge(spark.createDataFrame([(1, 5)], "id int, n long"))
    log.delete(spark.createDataFrame([(1,)], "id int"))
    assert state(log) == {}
    assert log.merge(spark.createDataFrame([(1, "b")], "id int, name string")) == {"created": 1}
    assert state(log) == {1: ("b", None, None)}
    assert [(r["kind"], r["before"], r["after"]) for r in log.log().orderBy("at").collect()] == [("update", {"n": "1"}, {"n": "5"}), ("delete", {}, {}), ("create", {"name": None}, {"name": "b"})]


def test_the_second_of_two_writers_fails_and_leaves_no_trace(spark, tmp_path):
    log = ChangeLog(spark, f"file://{tmp_path}/t", "id", FIELDS)
    one = spark.createDataFrame([(1, "a")], "id int, name string")
    assert log.merge(one) == {"created": 1}
    seen, content = log.manifest()
    log.merge(spark.createDataFrame([(2, "b")], "id int, name string"))
    with pytest.raises(Exception, match="exist"):
        log._append(seen, content, log._events(content["batches"]), "late", "x")
    assert state(log) == {1: ("a", None, None), 2: ("b", None, None)}


def test_rows_of_one_key_null_keys_and_empty_tables(spark, tmp_path):
    log = ChangeLog(spark, f"file://{tmp_path}/t", "id", FIELDS)
    assert log.current().count() == 0 and log.log().count() == 0
    df = spark.createDataFrame([(1, "a", 1), (1, "z", 0), (None, "q", 5), (2, None, 3)], "id int, name string, turn int")
    assert log.merge(df, order=[df["turn"]]) == {"created": 2, "invalid": 1}
    assert state(log) == {1: ("a", None, None), 2: (None, None, None)}
    assert log.merge(df.limit(0)) == {}
    log.compact()
    assert state(log) == {1: ("a", None, None), 2: (None, None, None)}


def test_memory_bank_computes_new_contents_only(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidemark.functions.texts import token_list
    from tidemark.operators import corrections
    from tidemark.operators.prototypes import hashed_vectors

    log = ChangeLog(spark, f"file://{tmp_path}/bank", "id", {"id": "int", **corrections.MEMORY_FIELDS})
    texts = ["one two three", "one two three", "four", "", None, "five six"]
    rows = lambda t: spark.createDataFrame(list(enumerate(t)), "id int, t string")
    build = lambda t, **k: corrections.memory_bank(log, rows(t), "t", token_list(F.col("t")), **k)
    batches = lambda: len(list((tmp_path / "bank" / "vectors").iterdir()))
    assert build(texts) == {"created": 6, "reused": 0, "total": 6} and build(texts) == {"created": 0, "reused": 6, "total": 6} and batches() == 1
    texts[2] = "five six"  # a text that the bank has already needs no new vector
    assert build(texts) == {"created": 1, "reused": 5, "total": 6} and batches() == 1
    texts[0] = "seven eight"
    assert build(texts) == {"created": 1, "reused": 5, "total": 6} and batches() == 2
    want = hashed_vectors(rows(texts).withColumn("w", token_list(F.col("t"))), "id", "w")
    key = lambda df: sorted((r["id"], r["slot"], r["weight"]) for r in df.collect())
    assert key(corrections.bank_vectors(log)) == key(want)
    assert build(texts, force=True)["created"] == 6 and key(corrections.bank_vectors(log)) == key(want)


def test_memory_bank_sends_no_text_to_be_named(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidemark.functions.texts import token_list
    from tidemark.operators import corrections

    def built(name, text, **how):
        log = ChangeLog(spark, f"file://{tmp_path}/{name}", "id", {"id": "int", **corrections.MEMORY_FIELDS})
        counts = [corrections.memory_bank(log, rows, "t", token_list(F.col("t")), **how) for rows in (text, text)]
        return counts, sorted((r["id"], r["slot"], r["weight"]) for r in corrections.bank_vectors(log).collect())

    rows = spark.createDataFrame([(i, t, str(i)) for i, t in enumerate(["one two", None, "", "one two", "three"])], "id int, t string, other string")
    hashed = rows.withColumn("hash", F.sha2(F.coalesce("t", F.lit("")), 256))
    assert built("named", hashed, content=F.col("hash")) == built("plain", rows)
