"""Event arcs against the plain definition, on whole lists of turns."""

import random

from tidemark.functions.cues import AUDIENCE, CUE_WORDS, SPONSORS
from tidemark.operators import arcs

WORDS = {"context": ["ctx"], "story": ["story"], "suspense": ["sus"], "music": ["mus"], "reaction": ["rea"]}


def plain(turns):
    """(anchor, first, last, kind) of every turn, each search over the whole list."""
    has = lambda i, *names: any(n in turns[i][2] for n in names)
    setup = lambda i: has(i, "ctx", "story", "sus")

    def after(i, test, within):
        for j in range(i + 1, len(turns)):
            if turns[j][1] - turns[i][0] > within:
                return None
            if test(j):
                return j

    def before(i, test, within):
        for j in range(i - 1, -1, -1):
            if turns[i][1] - turns[j][0] > within:
                return None
            if test(j):
                return j

    music, reaction, n = (lambda i: has(i, "mus")), (lambda i: has(i, "rea")), len(turns)
    out = []
    for i in range(n):
        if setup(i):
            m = i if music(i) else after(i, music, 55)
            r = None if m is None else m if reaction(m) else after(m, reaction, 28)
            last = r if r is not None else m if m is not None else min(n - 1, i + 3)
            out.append((i, i, last, "setup"))
        elif music(i):
            s, r = before(i, setup, 40), after(i, reaction, 24)
            out.append((i, max(0, i - 1) if s is None else s, min(n - 1, i + 2) if r is None else r, "music"))
        elif reaction(i) and (m := before(i, music, 28)) is not None:
            s = before(m, setup, 42)
            out.append((i, max(0, m - 1) if s is None else s, i, "reaction"))
    return out


def test_one_pass_finds_what_whole_lists_give(spark):
    rng = random.Random(7)
    rows, want = [], set()
    for key in range(40):
        at, turns = 0.0, []
        for _ in range(rng.choice([1, 2, 5, 60, 400])):
            length = rng.choice([1.0, 4.0, 4.0, 9.0, 30.0])
            said = " ".join(w for w in ("ctx", "story", "sus", "mus", "rea") if rng.random() < 0.08) + f" t{len(turns)}"
            turns.append((at, at + length, said))
            at += length + rng.choice([-0.5, 0.0, 0.5, 8.0, 80.0])
            at = max(at, turns[-1][0])
        turns.sort(key=lambda t: t[0])
        rows += [(key, i, *t, 10_000.0) for i, t in enumerate(turns)]
        want |= {(key, *found) for found in plain(turns)}
    df = spark.createDataFrame(rows, "k int, i int, s double, e double, t string, n double").repartition(5)
    got = arcs.event_arcs(df, "k", "i", "s", "e", "t", arcs.keyword_cues(WORDS), "n").collect()
    assert {(r["k"], r["anchor"], r["first"], r["last"], r["kind"]) for r in got} == want and len(got) == len(want)
    assert {kind for *_, kind in want} == {"setup", "music", "reaction"}
    by = {(k, i): t for k, i, _, _, t, _ in rows}
    for r in got:
        assert r["text"] == " ".join(by[r["k"], i] for i in range(r["first"], r["last"] + 1)).strip()
        assert 0 <= r["start"] and r["end"] - r["start"] <= 75 and (r["end"] - r["start"] >= 19.99)


def test_state_is_the_turns_of_some_minutes():
    own, most = arcs._Arcs(), 0
    for i in range(50_000):
        own.add((i, i * 2.0, i * 2.0 + 1.5, "x", i % 50 == 0, i % 7 == 0, i % 11 == 0))
        most = max(most, len(own.turns))
    assert most < 90


def test_a_story_with_music_and_applause_is_one_arc(spark):
    said = ["导师点评说这次选择会影响晋级", "他说这首歌写给妈妈 是一路坚持的故事", "副歌高音转调爆发 情绪直接推上去", "全场观众起立欢呼 导师反应很激动", "主持人继续串场"]
    rows = [(1, i, s, e, t, 60.0) for i, ((s, e), t) in enumerate(zip([(0.0, 5.0), (6.0, 11.0), (18.0, 24.0), (25.0, 31.0), (34.0, 39.0)], said, strict=True))]
    df = spark.createDataFrame(rows, "k int, i int, s double, e double, t string, n double")
    cues = arcs.keyword_cues(CUE_WORDS)
    found = arcs.event_arcs(df, "k", "i", "s", "e", "t", cues, "n")
    first = {r["anchor"]: r for r in found.collect()}
    assert (first[0]["first"], first[0]["last"], first[0]["start"], first[0]["end"]) == (0, 3, 0.0, 39.0)
    every = arcs.all_candidates({"arc": found, "window": arcs.turn_windows(df, "k", "i", "s", "e", "t", cues, "n")}, "k")
    ranked = arcs.rough_ranks(every, cues, AUDIENCE, SPONSORS).collect()
    best = max(ranked, key=lambda r: r["rough_rank"])
    assert all(w in best["text"] for w in ("导师", "副歌", "观众")) and not best["discarded"]
    noise = spark.createDataFrame([(1, 0.0, 30.0, "广告 扫码 VIP 直播间 合作伙伴"), (2, 0.0, 30.0, "啦" * 40), (3, 0.0, 30.0, "")], "k int, start double, end double, text string")
    assert {r["discarded"] for r in arcs.rough_ranks(noise, cues, AUDIENCE, SPONSORS).collect()} == {True}


def test_empty_and_null_turns(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 1.0, None, 9.0), (None, 1, 0.0, 1.0, "ctx", 9.0), (2, 0, 0.0, 2.0, "", 9.0)], "k int, i int, s double, e double, t string, n double")
    cues = arcs.keyword_cues(WORDS)
    assert [(r["k"], r["end"]) for r in arcs.event_arcs(df, "k", "i", "s", "e", "t", cues, "n").collect()] == [(None, 9.0)]
    assert arcs.event_arcs(df.limit(0), "k", "i", "s", "e", "t", cues, "n").count() == 0
