import io
import json
import math
import struct
import wave
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.sources import captures, sinks, subtitles


def test_srt_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 0.0, 1.5, "one"), (1, 1, 61.25, 61.3, "two\nlines")], "k int, i int, start double, end double, text string")
    (row,) = subtitles.to_srt(df, "k", "i", offset=0.5).collect()
    (tmp_path / "a.srt").write_text(row["srt"])
    got = [tuple(r) for r in subtitles.read_srt(spark, str(tmp_path)).orderBy("idx").select("idx", "start", "end", "text").collect()]
    assert got == [(0, 0.5, 2.0, "one"), (1, 61.75, pytest.approx(62.05), "two lines")]


def test_asr_json(spark, tmp_path):
    body = {"transcription": [{"offsets": {"from": 500, "to": 1500}, "text": " hi "}, {"timestamps": {"from": "00:00:02,000", "to": "00:00:03,500"}, "text": "x"}, {"offsets": {"from": 1, "to": 2}, "text": " "}]}
    (tmp_path / "a.json").write_text(json.dumps(body))
    got = [tuple(r) for r in subtitles.read_asr_json(spark, str(tmp_path)).orderBy("idx").select("start", "end", "text").collect()]
    assert got == [(0.5, 1.5, "hi"), (2.0, 3.5, "x")]


def test_csv_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes("﻿id,views\na,\"1,234\"\n".encode())
    df = captures.read_metric_csv(spark, str(tmp_path / "m.csv"))
    assert df.columns == ["id", "views"] and df.first()["views"] == "1,234"


def test_works_json_shapes_and_windows(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "1", "metrics_by_window": {"6h": {"views": 3}, "24h": {"views": 9}}}]))
    (tmp_path / "b.json").write_text(json.dumps({"items": [{"id": "2", "metrics_by_window": [{"window_name": "7d", "views": 5}]}, {"id": "3", "views": 1}]}))
    works = captures.read_works_json(spark, str(tmp_path))
    got = sorted((r["work"]["id"], r["window_name"], r["metrics"]["views"]) for r in captures.metric_windows(works).collect())
    assert got == [("1", "24h", "9"), ("1", "6h", "3"), ("2", "7d", "5"), ("3", None, "1")]


def test_snapshots(spark, tmp_path):
    page = {"observed_at": "t", "account": {"nickname": "n"}, "visible_works": [{"visible_count": "1万", "title_tags_text": "x", "tags": ["a"]}]}
    (tmp_path / "one.json").write_text(json.dumps(page))
    (tmp_path / "latest.json").write_text(json.dumps(page))
    (tmp_path / "none.json").write_text(json.dumps({"visible_works": []}))
    assert [r["file"] for r in captures.read_snapshots(spark, str(tmp_path)).collect()] == ["one.json"]


def workbook(rows):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cells = "".join("<row>" + "".join(f'<c r="{chr(65 + i)}{n}" t="inlineStr"><is><t>{v}</t></is></c>' for i, v in enumerate(r) if v) + "</row>" for n, r in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="other" r:id="r1"/><sheet name="works" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/a.xml"/><Relationship Id="r2" Target="worksheets/b.xml"/></Relationships>')
        z.writestr("xl/worksheets/a.xml", f"<worksheet {ns}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/b.xml", f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>")
    return out.getvalue()


def test_workbook_header_and_gaps(spark, tmp_path):
    (tmp_path / "w.xlsx").write_bytes(workbook([["title"], ["id", "name", "views"], ["1", "", "9"], ["2", "b", "8"]]))
    got = sorted((r["row"]["id"], r["row"]["name"], r["row"]["views"]) for r in captures.read_workbooks(spark, str(tmp_path)).collect())
    assert got == [("1", "", "9"), ("2", "b", "8")]


def test_sound_peaks(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(b"".join(struct.pack("<h", level) for level in (100, 100, 20000, 100) for _ in range(8000)))
    frames = captures.read_sound(spark, str(tmp_path))
    got = {r["time"]: r["energy"] for r in frames.collect()}
    assert got[2.0] == 1.0 and math.isclose(got[0.0], 0.005)
    assert [r["time"] for r in captures.peaks(frames).collect()] == [2.0]


def test_replace_scope_leaves_other_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.append(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), path, ("k",))
    sinks.replace_scope(spark.createDataFrame([("a", 9)], "k string, v int"), path, ("k",))
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", 9), ("b", 2)]


def test_newest_file_and_assets(spark, tmp_path):
    for name in ("d1/clip_1234567890.mp4", "d1/x_1234567890.mp4", "d2/none.txt"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"x")
    (row,) = captures.asset_index(spark, str(tmp_path)).collect()
    assert row["item_id"] == "1234567890" and row["category"] == "d1" and len(row["paths"]) == 2
    assert captures.newest_files(spark, str(tmp_path)).where(F.col("dataset") == "d2").count() == 1
