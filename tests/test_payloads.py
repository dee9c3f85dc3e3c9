"""Paths and vectors out of JSON of any shape, against a plain walk."""

import json
import random
from collections import Counter
from pathlib import PurePosixPath

from tidemark.operators import payloads


def shape(rng, depth):
    """A random value; paths, keys that name media, blanks, numbers and nulls among its leaves."""
    if depth and rng.random() < 0.7:
        names = rng.sample(["videoList", "cover", "Frame_1", "shots", "audio", "b.c", "ocr", "asr", "x", "", "posterUrl", "feature"], rng.randrange(4))
        return {n: shape(rng, depth - 1) for n in names} if rng.random() < 0.5 else [shape(rng, depth - 1) for _ in range(rng.randrange(4))]
    return rng.choice(["a/b.MP4?x=.png", "  ", "plain", "c.jpeg", ".wav", "d.e/f", "g.srt/", "s.txt", "..", "a.tar.m4a", " x.webp ", 3, 2.5, True, None, "h.json?"])


def walk(value, name=""):
    if isinstance(value, dict):
        for k, v in value.items():
            yield from walk(v, k)
    elif isinstance(value, list):
        for v in value:
            yield from walk(v, name)
    else:
        yield name, value


def category(name, path):
    low, end = name.lower(), PurePosixPath(path.split("?", 1)[0]).suffix.lower()
    for kind, words, endings in payloads.PATH_RULES:
        if any(w in low for w in words) or end in endings:
            return kind


def test_paths_of_random_shapes(spark):
    rng = random.Random(9)
    values = [shape(rng, rng.randrange(9)) for _ in range(250)]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(900, None), (901, "{bad"), (902, "")], "id int, pos string").repartition(3)
    got = Counter((r["id"], r["category"], r["name"], r["path"]) for r in payloads.media_paths(df, ["id"], "pos").collect())
    want = Counter((i, category(n, t.strip()), n, t.strip()) for i, v in enumerate(values) for n, t in walk(v) if isinstance(t, str) and t.strip() and category(n, t.strip()))
    assert got == want and sum(want.values()) > 100
    leaves = Counter(r["id"] for r in payloads.json_leaves(df, ["id"], "pos").collect())
    assert leaves == Counter(i for i, v in enumerate(values) for _ in walk(v))


def test_keys_of_any_name_and_deep_nesting(spark):
    deep = '{"key":' * 40 + '["x.mp4"]' + "}" * 40
    df = spark.createDataFrame([(1, "a", deep), (2, "b", "[]")], "value int, key string, place string")
    rows = payloads.media_paths(df, ["value", "key"], "place").collect()
    assert [(r["value"], r["key"], r["category"], r["name"], len(r["place"])) for r in rows] == [(1, "a", "video", "key", 41)]
    assert payloads.json_leaves(df.limit(0), ["value"], "place").count() == 0


def test_vectors_of_answers(spark):
    cases = {
        '{"embedding":[1,2.5]}': [[1.0, 2.5]], '{"embeddings":[[1],[2,3]],"embedding":[9]}': [[1.0], [2.0, 3.0]], '{"embeddings":[],"vector":[1e3]}': [[1000.0]], '{"vectors":[[1,"a"],[],[4]]}': [[4.0]],
        '{"data":[{"embedding":[1]},{"embedding":[2]}]}': [[1.0]], '{"data":[{"x":1},7,{"embedding":[[5],[6]]}]}': [[5.0], [6.0]], '{"data":{"embedding":[1]}}': [], "[1,2]": [], '{"vector":"[1]"}': [], '{"embedding":[1,null]}': [], '{"embedding":["1"]}': [], "": [], "{": [], '{"vector":[true]}': [],
    }
    df = spark.createDataFrame(list(enumerate(cases)) + [(99, None)], "id int, j string")
    got = {}
    for r in payloads.payload_vectors(df, ["id"], "j").orderBy("place").collect():
        got.setdefault(r["id"], []).append(list(r["vector"]))
    assert got == {i: v for i, v in enumerate(cases.values()) if v}
