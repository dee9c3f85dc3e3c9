"""Clip candidates from timed turns: event arcs, windows, peaks, their union, rough rank and choice."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import texts
from tidemark.operators import quality, transcripts

# ---- fixed values: how many seconds an arc's parts may lie apart, and how far a span is widened ----
MUSIC_AFTER_SETUP, REACTION_AFTER_SETUP = 55.0, 28.0
SETUP_BEFORE_MUSIC, REACTION_AFTER_MUSIC = 40.0, 24.0
MUSIC_BEFORE_REACTION, SETUP_BEFORE_REACTION = 28.0, 42.0
TURNS_AFTER_SETUP, TURNS_AFTER_MUSIC = 3, 2
ARC = {"before": 3.0, "before_setup": 5.0, "after": 6.0, "after_music": 10.0, "after_reaction": 8.0, "least": 20.0, "most": 75.0}
WINDOW = {"size": 4, "stride": 2, "before": 2.0, "before_setup": 5.0, "before_reaction": 8.0, "after": 6.0, "after_cue": 8.0, "least": 14.0, "least_cue": 18.0, "most": 60.0, "most_setup": 75.0}
PEAK_SECONDS, PEAKS = 32.0, 20
RANK = {
    "whole_arc": 32, "context_music": 22, "music_reaction": 16, "suspense_story": 10, "longest_text": 18, "text_per_point": 10, "quality": 10, "fits": 14, "near": 7, "misfit": -10,
    "sponsor": 10, "sponsor_most": 48, "sponsor_alone": -16, "latin_alone": -26, "latin": -6, "latin_short": -8, "repeats": -80, "thin": -12,
}
# ---- end of fixed values ----
CUES = ("context", "story", "suspense", "music", "reaction")

Cues = dict[str, Callable[[Column], Column]]


def keyword_cues(words: dict[str, list[str]]) -> Cues:
    """Cues that a text gives where it contains one of a kind's words."""
    return {kind: (lambda text, w=words[kind]: texts.contains_any(text, w)) for kind in CUES}


def _setup(cues: Cues, text: Column) -> Column:
    return cues["context"](text) | cues["story"](text) | cues["suspense"](text)


class _Arcs:
    """Turns of one key in order of time, as long as an arc may still need them.

    A turn's arc is settled once a turn ends later than every search from it
    may reach; turns before any search's reach are let go.  State is the turns
    of so many seconds, whatever the length of the key.
    """

    AHEAD = MUSIC_AFTER_SETUP + REACTION_AFTER_SETUP
    BACK = MUSIC_BEFORE_REACTION + SETUP_BEFORE_REACTION

    def __init__(self):
        self.turns, self.next = [], 0  # (order, start, end, text, setup, music, reaction); the first that is not settled

    def _after(self, i: int, flag: int, within: float) -> int | None:
        for j in range(i + 1, len(self.turns)):
            if self.turns[j][2] - self.turns[i][1] > within:
                return None
            if self.turns[j][flag]:
                return j
        return None

    def _before(self, i: int, flag: int, within: float) -> int | None:
        for j in range(i - 1, -1, -1):
            if self.turns[i][2] - self.turns[j][1] > within:
                return None
            if self.turns[j][flag]:
                return j
        return None

    def _span(self, i: int) -> tuple[int, int, str] | None:
        """Where turn i's arc begins and ends, and what the turn is to it."""
        setup, music, reaction = 4, 5, 6
        last, turn = len(self.turns) - 1, self.turns[i]
        if turn[setup]:
            at = i if turn[music] else self._after(i, music, MUSIC_AFTER_SETUP)
            if at is None:
                return i, min(last, i + TURNS_AFTER_SETUP), "setup"
            answer = at if self.turns[at][reaction] else self._after(at, reaction, REACTION_AFTER_SETUP)
            return i, at if answer is None else answer, "setup"
        if turn[music]:
            begin, answer = self._before(i, setup, SETUP_BEFORE_MUSIC), self._after(i, reaction, REACTION_AFTER_MUSIC)
            return max(0, i - 1) if begin is None else begin, min(last, i + TURNS_AFTER_MUSIC) if answer is None else answer, "music"
        if turn[reaction]:
            at = self._before(i, music, MUSIC_BEFORE_REACTION)
            if at is None:
                return None
            begin = self._before(at, setup, SETUP_BEFORE_REACTION)
            return max(0, at - 1) if begin is None else begin, i, "reaction"
        return None

    def add(self, turn: tuple) -> list[tuple]:
        self.turns.append(turn)
        return self.settled(False)

    def settled(self, ended: bool) -> list[tuple]:
        """Arcs (anchor, first, last, start, end, text, kind) that no later turn can change."""
        out = []
        while self.next < len(self.turns) and (ended or (len(self.turns) - 1 - self.next >= TURNS_AFTER_SETUP and self.turns[-1][2] - self.turns[self.next][1] > self.AHEAD)):
            found = self._span(self.next)
            if found:
                a, b, kind = found
                part = self.turns[a : b + 1]
                out.append((self.turns[self.next][0], part[0][0], part[-1][0], part[0][1], part[-1][2], " ".join(t[3] or "" for t in part).strip(), kind))
            self.next += 1
        if self.next < len(self.turns):
            keep = self.next
            while keep > 0 and self.turns[keep - 1][1] >= self.turns[self.next][1] - self.BACK:
                keep -= 1
            drop = max(0, keep - 1)  # one turn more: a search that finds nothing takes the turn before
            self.turns, self.next = self.turns[drop:], self.next - drop
        return out


def event_arcs(turns: DataFrame, key: str, order: str, start: str, end: str, text: str, cues: Cues, length: str) -> DataFrame:
    """Spans that tell of an event, setup, music and reaction: one for each turn that gives a cue and fits into an arc.

    From a setup, forward to the music and the reaction to it; from music, back
    to its setup and forward to its reaction; from a reaction, back to the music
    and its setup.  Keys are dealt whole and read in order of time in one pass
    that holds the turns of some minutes.  Returns key, anchor, first, last,
    kind, start, end, text; times are widened by what the whole text says and
    kept within ``length`` (a column, the same for all turns of a key).
    """
    kinds = dict(turns.dtypes)
    flags = {"setup": _setup(cues, F.col(text)), "music": cues["music"](F.col(text)), "reaction": cues["reaction"](F.col(text))}
    rows = turns.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(start).cast("double").alias("s"), F.col(end).cast("double").alias("e"), F.col(text).alias("t"), *[F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()], F.col(length).cast("double").alias("length"))
    kind = f"k {kinds[key]}, anchor {kinds[order]}, first {kinds[order]}, last {kinds[order]}, s double, e double, text string, kind string, length double"

    def fold(batches):
        own, of, whole = _Arcs(), object(), 0.0
        schema = None
        for batch in batches:
            schema = schema or pa.schema([("k", batch.schema.field("k").type), *[(n, batch.schema.field("o").type) for n in ("anchor", "first", "last")], ("s", pa.float64()), ("e", pa.float64()), ("text", pa.string()), ("kind", pa.string()), ("length", pa.float64())])
            out = []
            k, length_, *turn = (batch.column(n).to_pylist() for n in ("k", "length", "o", "s", "e", "t", "setup", "music", "reaction"))
            for i, now in enumerate(zip(*turn, strict=True)):
                if k[i] != of:
                    out += [(of, *arc, whole) for arc in own.settled(True)]
                    own, of, whole = _Arcs(), k[i], length_[i]
                out += [(of, *arc, whole) for arc in own.add(now)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        if last := [(of, *arc, whole) for arc in own.settled(True)]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*last, strict=True), schema, strict=True)], schema=schema)

    found = rows.repartition("k").sortWithinPartitions("k", "s", "o").mapInArrow(fold, kind)
    said = F.col("text")
    before = F.when(_setup(cues, said), ARC["before_setup"]).otherwise(ARC["before"])
    after = F.when(cues["reaction"](said), ARC["after_reaction"]).when(cues["music"](said), ARC["after_music"]).otherwise(ARC["after"])
    out = _fitted(found, F.col("s") - before, F.col("e") + after, F.lit(ARC["least"]), F.lit(ARC["most"]))
    return out.select(F.col("k").alias(key), "anchor", "first", "last", "kind", "start", "end", "text")


def _fitted(df: DataFrame, start: Column, end: Column, least: Column, most: Column) -> DataFrame:
    """Adds start and end: within 0 and ``length``, widened about the middle to ``least`` seconds, cut to ``most``."""
    df = df.withColumns({"__a": F.greatest(F.lit(0.0), start), "__b": F.least(F.col("length"), end)})
    short = F.col("__b") - F.col("__a") < least
    low = F.greatest(F.lit(0.0), (F.col("__a") + F.col("__b")) / 2 - least / 2)
    high = F.least(F.col("length"), low + least)
    df = df.withColumns({"start": F.when(short, F.round(F.greatest(F.lit(0.0), high - least), 3)).otherwise(F.col("__a")), "__b": F.when(short, F.round(high, 3)).otherwise(F.col("__b"))})
    cut = F.when(F.col("__b") - F.col("start") > most, F.least(F.col("length"), F.col("start") + most)).otherwise(F.col("__b"))
    return df.withColumns({"end": F.round(cut, 3), "start": F.round("start", 3)}).drop("__a", "__b")


def turn_windows(turns: DataFrame, key: str, order: str, start: str, end: str, text: str, cues: Cues, length: str) -> DataFrame:
    """Spans of four turns from every second one on, widened by what they say: key, anchor, start, end, text."""
    ahead = Window.partitionBy(key).orderBy(order).rowsBetween(0, WINDOW["size"] - 1)
    rows = turns.select(key, F.col(order).alias("anchor"), F.col(order), F.col(start).cast("double").alias("s"), F.last(F.col(end).cast("double")).over(ahead).alias("e"), F.coalesce(text, F.lit("")).alias("t"), F.col(length).cast("double").alias("length"))
    rows = transcripts.sliding_windows(rows, key, order, "t", WINDOW["size"], WINDOW["stride"]).withColumn("text", F.trim("joined"))
    said = F.col("text")
    setup, music, reaction = _setup(cues, said), cues["music"](said), cues["reaction"](said)
    before = F.when(setup, WINDOW["before_setup"]).when(reaction, WINDOW["before_reaction"]).otherwise(WINDOW["before"])
    after = F.when(music | reaction, WINDOW["after_cue"]).otherwise(WINDOW["after"])
    least = F.when(setup | music | reaction, WINDOW["least_cue"]).otherwise(WINDOW["least"])
    out = _fitted(rows, F.col("s") - before, F.col("e") + after, least, F.when(setup, WINDOW["most_setup"]).otherwise(WINDOW["most"]))
    return out.select(key, "anchor", "start", "end", "text")


def peak_spans(peaks: DataFrame, key: str, at: str, rank: str, length: str, text: str = "") -> DataFrame:
    """A span about each of a key's first peaks: key, anchor (the peak's rank), start, end, text."""
    first = peaks.where(F.col(rank) <= PEAKS).select(key, F.col(rank).alias("anchor"), F.col(at).cast("double").alias("t"), F.col(length).cast("double").alias("length"))
    return _fitted(first, F.col("t"), F.col("t"), F.lit(PEAK_SECONDS), F.lit(PEAK_SECONDS)).select(key, "anchor", "start", "end", F.lit(text).alias("text"))


def all_candidates(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """The union of candidate generators, each row with the name of its own."""
    named = [df.select(key, F.lit(name).alias("origin"), F.col("anchor").cast("long").alias("anchor"), "start", "end", "text") for name, df in parts.items()]
    return reduce(DataFrame.unionByName, named)


def latin_share(text: Column) -> Column:
    """Share of latin letters among all characters but white space; 0 for texts under 18 of them or with ten Han characters."""
    compact = F.regexp_replace(texts.blank(text), r"\s+", "")
    latin, han = (F.length(F.regexp_replace(compact, f"[^{kept}]", "")) for kept in ("A-Za-z", r"\x{4e00}-\x{9fff}"))
    return F.when((F.length(compact) < 18) | (han >= 10), 0.0).otherwise(F.round(latin / F.length(compact), 3))


def text_quality(text: Column) -> Column:
    """Length up to 48 characters (.65) and variety of characters (.35), 0..1; hardly any for a text that repeats itself."""
    said = F.trim(texts.blank(text))
    n = F.length(said)
    kinds = F.size(F.array_distinct(F.regexp_extract_all(said, F.lit("(?s)."), F.lit(0))))
    score = F.least(F.lit(1.0), n / 48) * 0.65 + F.least(F.lit(1.0), kinds / F.greatest(F.lit(1), n) * 3) * 0.35
    return F.when(n == 0, 0.0).when(quality.is_repetitive(said), 0.05).otherwise(F.round(score, 3))


def rough_ranks(candidates: DataFrame, cues: Cues, audience: list[str], sponsors: list[str], text: str = "text") -> DataFrame:
    """Adds quality, rough_rank and discarded to spans with start, end and text."""
    said = F.col(text)
    df = candidates.withColumns({"quality": text_quality(said), "__sponsors": texts.keyword_hits(said, sponsors), "__latin": latin_share(said), "__repeats": quality.is_repetitive(said), **{f"__{c}": cues[c](said) for c in CUES}})
    df = df.withColumns({"__ctx": F.col("__context") | F.col("__story"), "__seen": F.col("__reaction") | texts.contains_any(said, audience), "__d": F.col("end") - F.col("start")})
    c, points = (lambda n: F.col(f"__{n}")), (lambda test, name, other=0: F.when(test, RANK[name]).otherwise(other))
    latin = points(~(c("ctx") | c("seen") | c("suspense")), "latin_alone", RANK["latin"]) + points((c("d") < 24) & ~c("seen"), "latin_short")
    terms = [
        points(c("ctx") & c("music") & c("reaction"), "whole_arc"), points(c("ctx") & c("music"), "context_music"), points(c("music") & c("reaction"), "music_reaction"), points(c("suspense") | c("story"), "suspense_story"),
        F.least(F.lit(RANK["longest_text"]), F.length(texts.blank(said)) / RANK["text_per_point"]), F.when(c("d").between(18, 55), RANK["fits"]).when(c("d").between(12, 75), RANK["near"]).otherwise(RANK["misfit"]),
        F.col("quality") * RANK["quality"], -F.least(F.lit(RANK["sponsor_most"]), c("sponsors") * RANK["sponsor"]), points((c("sponsors") >= 2) & ~(c("seen") | c("suspense")), "sponsor_alone"),
        F.when(c("latin") >= 0.55, latin).otherwise(0), points(c("repeats"), "repeats"), points(F.col("quality") < 0.35, "thin"),
    ]
    # one term after the other, as the SQL has them: another order has other last digits, and so other ties
    score = reduce(lambda total, term: total + term, terms)
    gone = c("repeats") | (c("sponsors") >= 4) | (F.col("quality") < 0.22)
    return df.withColumns({"rough_rank": score.cast("double"), "discarded": gone}).select(*candidates.columns, "quality", "rough_rank", "discarded")


def chosen_candidates(ranked: DataFrame, key: str, item: str) -> DataFrame:
    """The candidates that are kept, best first: not discarded, no text twice, and none over another by more than 55 %."""
    rows = ranked.where(~F.col("discarded")).withColumn("__print", texts.fingerprint(F.col("text")))
    return transcripts.suppress_overlaps(rows, key, item, "start", "end", "rough_rank", "__print")
