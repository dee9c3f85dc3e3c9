"""Queries against their SQL on small tables of the kinds that the third review found faults with."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry


def same_as_sql(spark, folder, name, **tables):
    """The query's rows in order of their columns, after they were held against its SQL over the same tables."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table, rows in tables.items():
        pq.write_table(rows, f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    df = entry.queries()[name](spark, str(folder))
    found = con.execute(entry.oracle_sql()[name])
    at = [d[0] for d in found.description]
    assert sorted(at) == sorted(df.columns)
    want = sorted((dict(zip(at, r, strict=True)) for r in found.fetchall()), key=repr)
    got = sorted(({c: r[c] for c in at} for r in df.collect()), key=repr)
    assert got == want
    return got


def test_rewritten_texts_where_phrases_overlap(spark, tmp_path):
    said = ["mention", "keition mentment", "5555555", "éüßz tionment", "", None]
    docs = pa.table({"doc_id": pa.array(range(len(said)), pa.int64()), "text": pa.array(said, pa.string())})
    assert len(same_as_sql(spark, tmp_path, "rewritten_texts", documents=docs)) == len(said)


def test_clip_transcript_of_short_and_silent_conversations(spark, tmp_path):
    turns = [(1, 0, "x" * 100), (2, 0, "a"), (2, 1, "y" * 60), (3, 0, None), (3, 1, None), (4, 0, "x" * 70), (4, 1, "b"), (5, 0, "w" * 1500), (5, 1, None), (5, 2, "z" * 90), (6, 0, "x" * 119)] + [(7, i, None) for i in range(20)]
    table = pa.table({"conv_id": pa.array([t[0] for t in turns], pa.int64()), "turn": pa.array([t[1] for t in turns], pa.int32()), "role": ["user"] * len(turns), "text": pa.array([t[2] for t in turns], pa.string())})
    got = same_as_sql(spark, tmp_path, "clip_transcript", conversations=table)
    assert [r["conv_id"] for r in got if r["seconds"] < 0] and [r for r in got if r["joined"] is None]


def shuffled_bytes(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_similar_history_shuffles_no_pairs_before_they_are_candidates(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tidemark.plans import backtest

    rows = spark.range(2400).select("id", F.expr("concat('a', id % 3)").alias("account"), F.expr("concat('c', id % 2)").alias("category"), F.expr("concat('s', id % 700)").alias("song"), F.expr("transform(sequence(1, 40), i -> xxhash64(concat(id % 97 * i % 211, '-', i % 5)))").alias("tokens"))
    held, train = rows.where("id % 6 = 0"), rows.where("id % 6 <> 0")

    def found():
        before = shuffled_bytes(spark)
        got = {(r["target"], r["sample"]): r["similarity"] for r in backtest.similar_history(held, train, "id", "tokens", 20).collect()}
        return got, shuffled_bytes(spark) - before

    got, moved = found()
    assert len(got) == 400 * 20 and moved < 5_500_000
    for name, value in {"BLOCK_TOKENS": 9_000, "CHUNK_TOKENS": 3_000, "DENSE": 8, "FEW_VALUES": 2, "HELD_KINDS": 1}.items():
        monkeypatch.setattr(backtest, name, value, raising=False)
    assert found()[0] == got


def test_evidence_rounds_halves_as_its_sql(spark):
    from pyspark.sql import functions as F

    from tidemark.plans import rankers

    x = 0.00015
    say = lambda n: F.lit(x if n == "best" else 0.0)
    assert duckdb.connect().execute(f"SELECT round({x}::DOUBLE, 4)").fetchone()[0] == spark.range(1).select(rankers.strength(say)).first()[0] == 0.0001


def test_a_run_shuffles_each_target_of_an_item_once_and_asked_ids_only(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidemark.operators import syncing

    rows = spark.range(60_000).select(F.expr("concat('ID:99', lpad(id % 30, 10, '0'))").alias("item"), F.expr("concat('w', id % 2)").alias("window"), F.expr("CASE id % 3 WHEN 0 THEN cast(id % 30 AS string) WHEN 1 THEN ' ' END").alias("target"), F.expr("cast(id AS string)").alias("value"))
    known = spark.range(5, 400_000)
    platform = syncing.Platform.below(spark, f"file://{tmp_path}/p")
    before = shuffled_bytes(spark)
    done = syncing.synced(platform, "run", "main", lambda: rows, known, "id")
    moved = shuffled_bytes(spark) - before
    assert done == {"run": "run", "account": "main", "status": "completed_with_warnings", "pulled": 60_000, "mapped": 10, "imported": 30, "linked": 16_000, "unlinked": 44_000, "error": ""}
    assert moved < 100_000, moved


def test_runs_over_odd_cells_equal_a_plain_count(spark, tmp_path):
    import random

    from tidemark.operators import syncing

    rng, known = random.Random(14), {"3", "4", "5", "7 "}
    platform = syncing.Platform.below(spark, f"file://{tmp_path}/p")
    ids = spark.createDataFrame([(i,) for i in [*sorted(known), "3", None]], "id string")
    items = ["1234567890", "ID 12-3456-7890", " 99 0000000001", "123", "", None, "x9900000000001"]
    mapped, kept = {}, {}
    for run in range(2):
        cells = [(rng.choice(items), rng.choice(["w0", "", None]), rng.choice([None, "", " ", " 3 ", "4", "5", "6", "7 ", "8"]), rng.choice([None, "", "abc", "1,000", "2%", "1.2万", "3", "-7", "0"])) for _ in range(90 if run else 12)]
        done = syncing.synced(platform, f"run{run}", "main", lambda cells=cells: spark.createDataFrame(cells, "item string, window string, target string, value string"), ids, "id")
        clean = []
        for item, window, target, value in cells:
            digits = "".join(c for c in item or "" if c.isdigit())
            number = {"1,000": 1000.0, "2%": 2.0, "1.2万": 12000.0, "3": 3.0, "-7": -7.0, "0": 0.0}.get(value)
            if len(digits) >= 10:
                clean.append((digits, "final" if window is None else window, (target or "").strip(" "), number))
        named = {i: max(t for j, _, t, _ in clean if j == i) for i, *_ in clean}
        mapped |= {i: t for i, t in named.items() if t}
        linked = [(i, w, t if t in known else mapped.get(i) if mapped.get(i) in known else None, v) for i, w, t, v in clean]
        imported = 0
        for key in {(i, w) for i, w, *_ in linked}:
            here = [(-1.0 if v is None else v, link or "", v) for i, w, link, v in linked if (i, w) == key]
            target, value = max(here, key=lambda x: x[:2])[1], max((v for *_, v in here if v is not None), default=None)
            old = kept.get(key)
            imported += old is None or (target != "" and target != old[0]) or (value is not None and value != old[1])
            kept[key] = (target or (old[0] if old else None), value if value is not None else (old[1] if old else None))
        n, hit = len(linked), sum(link is not None for _, _, link, _ in linked)
        assert done == {"run": f"run{run}", "account": "main", "status": "completed_with_warnings" if hit < n else "completed", "pulled": n, "mapped": sum(t != "" for t in named.values()), "imported": imported, "linked": hit, "unlinked": n - hit, "error": ""}
        assert {(r["item"], r["window"]): (r["target"], r["value"]) for r in platform.metrics.current().collect()} == kept
        assert {r["item"]: r["target"] for r in platform.mappings.current().collect() if r["target"]} == mapped
