"""Substring dedup by relative Lempel-Ziv parsing.

Words are the letters.  The reference is the corpus itself, cut into blocks of
``BLOCK`` words at places that the content names: of every 35-word window the
block with the smallest hash is indexed, so equal windows name equal blocks
wherever they stand.  Each block that stands twice is a reference block; every
text that holds it hands in the stretch of words whose windows name it.

A task holds the stretches of a reference block and parses each greedily from
left to right against all others: at a word whose window stands elsewhere, word
for word, a factor begins with that place as its source, and goes on as far as
the words of both agree; at other words a literal is passed over.  After a
factor, the next window to be looked up is the first that reaches beyond it, so
windows over the boundary of two factors are checked for themselves.  Factors
are at least a window long; their words become duplicate spans.

Equal texts are met once in each task and count as often as they occur, and
equal stretches of one text are handed in once, with all their places.  A
block with more than ``HOT_PLACES`` places is not brought together: its
stretches are cut into single windows, which are counted with partial sums in
every task (by a 96-bit name, and the least and greatest words of a name must
be the same).  The windows that repeat are put up in lists of bounded length,
each stretch of the block meets the lists that its windows may be in, and its
runs of windows found there are its factors.

Defined results: a null text has no words; texts shorter than a window keep
all words; repeated rows make each other's windows repeated; a null identifier
is a document like others; extra columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, shared_folder, slices, splittable_join

WINDOW = 35
BLOCK = 12
#: Places of a block from which on its windows are counted over the cluster.
HOT_PLACES = 40_000
#: Places of a block in one text from which on equal stretches count once.
FEW_PLACES = 8
#: Windows of a hot block in one list, and repeated windows of hot blocks whose lists are broadcast; they are counted first.
LIST_WINDOWS, BROADCAST_WINDOWS = 256, 200_000
#: Text that a task takes in hand at once.
PART_BYTES = 1 << 20
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
FACTORS = "k1 long, name int, start int, length int, source long, source_start int"


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def gram_hashes(h: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """Hash of each stretch of n words, mixed so that all bits count."""
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out *= base
        out += h[k : len(h) - n + 1 + k]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def window_blocks(h: np.ndarray, window: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window the position of its block, the first of the smallest hash; and all blocks' hashes."""
    g = gram_hashes(h, block, _B1)
    views = np.lib.stride_tricks.sliding_window_view(g, window - block + 1)
    at = np.empty(len(views), np.int64)
    for s in range(0, len(views), 1 << 14):
        at[s : s + (1 << 14)] = views[s : s + (1 << 14)].argmin(1)
    return at + np.arange(len(views)), g


def stretches(h: np.ndarray, window: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, first window, windows) of each run of windows that name the same block in the same place."""
    at, g = window_blocks(h, window, block)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return g[at[first]], first, np.diff(np.append(first, len(at)))


def parse(rows: list[tuple[list[bytes], int]], window: int):
    """Greedy factors of stretches (words, weight) against each other: (row, start, length, source row, source start).

    A row of weight above 1 stands for equal texts and is parsed as a source only.  Windows are looked up by 128 bits and compared word for word.
    """
    from xxhash import xxh3_128_digest

    places: dict[bytes, list[tuple[int, int]]] = {}
    keys = []
    for r, (words, _) in enumerate(rows):
        own = [xxh3_128_digest(b" ".join(words[i : i + window])) for i in range(len(words) - window + 1)]
        keys.append(own)
        for i, key in enumerate(own):
            found = places.setdefault(key, [])
            if len(found) < 2:  # a place and, for the window that stands there, another
                found.append((r, i))
    for r, (words, weight) in enumerate(rows):
        if weight > 1:
            continue
        i = 0
        while i < len(keys[r]):
            source = next((p for p in places[keys[r][i]] if p != (r, i)), None)
            if source is None:
                i += 1
                continue
            other, j = rows[source[0]][0], source[1]
            n = 0
            while i + n < len(words) and j + n < len(other) and words[i + n] == other[j + n]:
                n += 1
            if n < window:
                raise ValueError("two windows have one 128-bit name")
            yield r, i, n, source[0], j
            i += n - window + 1


def _low(name: int) -> int:
    """The low 32 bits of a 64-bit name, signed; beside the other 64 bits they tell texts apart."""
    return ((name + (1 << 31)) & 0xFFFFFFFF) - (1 << 31)


def _named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text in UTF-8 and 128 bits (k1, k2) that name the text."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(1), body).alias("k2"), F.encode(body, "utf-8").alias("text"))


def _once(batches):
    """Each text once a task."""
    seen: set[tuple[int, int]] = set()
    for whole in batches:
        for batch in slices(whole, "text"):
            new = []
            for i, k in enumerate(zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), strict=True)):
                if k not in seen:
                    seen.add(k)
                    new.append(i)
            if len(new) == batch.num_rows:
                yield batch
            elif new:
                yield batch.take(pa.array(new))


def _different(h: np.ndarray, window: int, block: int, own: np.ndarray, times: np.ndarray) -> np.ndarray:
    """How many different stretches name each block of ``own`` in a text, and one more if any of them repeats."""
    names, first, n = stretches(h, window, block)
    kinds = np.unique(np.stack([names, gram_hashes(h, window, _B1)[first], n.astype(np.uint64)]), axis=1)
    found = np.unique(kinds[0], return_counts=True)[1]  # in the order of ``own``
    return found + (times > found)


def _index_blocks(window: int, block: int):
    """Blocks that each text names, with half of the text's name: more owners than are due do no harm here."""

    def run(batches):
        for batch in _once(batches):
            for part in slices(batch, "text", PART_BYTES):
                rows: list[list[np.ndarray]] = [[], [], []]
                for k, t in zip(part.column("k1").to_pylist(), part.column("text"), strict=True):
                    words = t.as_py().split()
                    if len(words) >= window:
                        at, g = window_blocks(word_hashes(words), window, block)
                        own, times = np.unique(g[np.unique(at)], return_counts=True)
                        if times.max() > FEW_PLACES:
                            times = _different(word_hashes(words), window, block, own, times)
                        for column, x in zip(rows, (own.view(np.int64), np.full(len(own), k, np.int64), times.astype(np.int32)), strict=True):
                            column.append(x)
                if rows[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in rows], names=["block", "owner", "times"])

    return run


STRETCH = "block long, k1 long, name int, source long, at array<int>, weight int, words binary"
HOT_STRETCH = "block long, k1 long, name int, at array<int>, w1 array<long>, w2 array<int>"
HOT_WINDOW = "block long, w1 long, w2 int, source long, weight int, words binary"
_KINDS = {
    STRETCH: (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.binary()),
    HOT_STRETCH: (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())),
    HOT_WINDOW: (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()),
}


def _hand_in(window: int, block: int, shape: str):
    """Of each text the stretches that name a reference block; or, of hot blocks, their single windows or the windows' names."""
    names_of = [c.split()[0] for c in shape.split(", ")]

    def run(batches):
        last = None
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                rows: list[tuple] = []
                for k1, k2, doc, t, held, copied in zip(*(part.column(c) for c in ("k1", "k2", "doc_id", "text", "blocks" if shape == STRETCH else "hot", "copied")), strict=True):
                    k1, k2 = k1.as_py(), k2.as_py()
                    if not held.is_valid or not len(held.values) or (k1, k2) == last:
                        continue
                    last = (k1, k2)
                    words = t.as_py().split()
                    if len(words) < window:
                        continue
                    h = word_hashes(words)
                    index = held.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                    weight, low, doc = 1 + (k2 in (copied.as_py() or ())), _low(k2), doc.as_py()
                    names, first, n = stretches(h, window, block)
                    if shape != STRETCH:
                        w1, w2 = gram_hashes(h, window, _B1).view(np.int64), (gram_hashes(h, window, _B2) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    seen: dict = {}  # equal stretches, or windows, of one text
                    for s in np.flatnonzero(np.isin(names, index)).tolist():
                        name, a, b = int(names[s].view(np.int64)), int(first[s]), int(first[s] + n[s])
                        if shape == HOT_WINDOW:
                            for i in range(a, b):
                                key = (int(w1[i]), int(w2[i]))
                                seen.setdefault(key, [(name, *key, doc), b" ".join(words[i : i + window]), 0])[2] += weight
                            continue
                        key = b" ".join(words[a : b + window - 1])
                        old = seen.setdefault(key, [name, [], a, b])
                        old[1].append(a)
                    for key, old in seen.items():
                        if shape == HOT_WINDOW:
                            rows.append((*old[0], old[2], old[1]))
                        elif shape == STRETCH:
                            rows.append((old[0], k1, low, doc, old[1], weight, key))
                        elif weight == 1:
                            rows.append((old[0], k1, low, old[1], w1[old[2] : old[3]], w2[old[2] : old[3]]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), _KINDS[shape], strict=True)], names=names_of)

    return run


def _parse_blocks(window: int):
    """Stretches sorted by block -> factors; holds those of one block, which are bounded by HOT_PLACES."""

    def factors(group: list[tuple]):
        if len(group) < 2 and len(group[0][3]) < 2:  # windows of one stretch name one place and so differ
            return
        classes: dict[bytes, list[tuple]] = {}
        for row in group:
            classes.setdefault(row[-1], []).append(row)
        kinds = [(words.split(b" "), own) for words, own in classes.items()]
        for words, own in kinds:
            places = [(row[2], at) for row in own[:2] for at in row[3][:2]]  # two are enough: a source, and another for itself
            if len(places) > 1:  # equal stretches: a factor each
                for k1, name, source, at, weight, _ in own:
                    for one in at if weight == 1 else ():
                        yield k1, name, one, len(words), *next(p for p in places if p != (source, one))
        if len(kinds) > 1:
            alone = lambda own: own[0][4] if len(own) == len(own[0][3]) == 1 else 2
            for r, i, n, q, j in parse([(words, alone(own)) for words, own in kinds], window):
                (k1, name, _, at, _, _), source = kinds[r][1][0], kinds[q][1][0]
                yield k1, name, at[0] + i, n, source[2], source[3][0] + j

    def run(batches):
        group: list[tuple] = []
        last, out = None, []
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                for block, *row in zip(*(c.to_pylist() for c in whole.slice(at, 2048).columns), strict=True):
                    if block != last and group:
                        out += factors(group)
                        group = []
                    last = block
                    group.append(tuple(row))
                if out:
                    yield _factor_batch(out)
                    out = []
        if group:
            out += factors(group)
        if out:
            yield _factor_batch(out)

    return run


def _factor_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in FACTORS.split(", ")])


def _remove(window: int):
    """Texts with their factors -> what is left of them."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32())])))

    def run(batches):
        last = None
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                out: list[list] = [[] for _ in range(7)]
                for k1, k2, t, copied, factors in zip(*(part.column(c) for c in ("k1", "k2", "text", "copied", "factors")), strict=True):
                    k1, k2 = k1.as_py(), k2.as_py()
                    if (k1, k2) == last:
                        continue
                    last = (k1, k2)
                    words = t.as_py().split()
                    spans: list[list[int]] = []
                    found = []
                    if k2 in (copied.as_py() or ()) and len(words) >= window:
                        spans.append([0, len(words)])  # the whole text is another's
                    elif factors.is_valid:
                        low = _low(k2)
                        found = sorted((f["start"], f["length"], f["source"], f["source_start"]) for f in factors.as_py() if f["name"] == low)
                    for start, length, *_ in found:
                        if spans and start <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], start + length)
                        else:
                            spans.append([start, start + length])
                    kept, done = [], 0
                    for a, b in spans:
                        kept += words[done:a]
                        done = b
                    kept += words[done:]
                    named = [dict(zip(("start", "length", "source", "source_start"), f, strict=True)) for f in found]
                    for values, x in zip(out, (k1, k2, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), spans, named), strict=True):
                        values.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["k1", "k2", "n_words", "n_removed", "kept_sha256", "spans", "factors"])

    return run


def _look_up(window: int):
    """Stretches with a list of windows that repeat -> a factor for each run of windows in the list."""

    def run(batches):
        last, known = None, {}
        for batch in batches:
            out: list[tuple] = []
            for key, k1, name, at, w1, w2, found in zip(*(batch.column(c) for c in ("list", "k1", "name", "at", "w1", "w2", "found")), strict=True):
                if key.as_py() != last:
                    last, known = key.as_py(), {(f["w1"], f["w2"]): f["first"] for f in found.as_py()}
                runs: list[list] = []
                for i, w in enumerate(zip(w1.as_py(), w2.as_py(), strict=True)):
                    if w in known and runs and runs[-1][1] == i:
                        runs[-1][1] = i + 1
                    elif w in known:
                        runs.append([i, i + 1, known[w]])
                out += [(k1.as_py(), name.as_py(), one + i, window + j - 1 - i, source, None) for one in at.as_py() for i, j, source in runs]
            if out:
                yield _factor_batch(out)

    return run


def _hot_factors(lined: DataFrame, window: int, block: int) -> DataFrame:
    """Factors of the stretches of hot blocks."""
    some = lined.where(F.size("hot") > 0)
    windows = some.mapInArrow(_hand_in(window, block, HOT_WINDOW), HOT_WINDOW)
    found = windows.groupBy("block", "w1", "w2").agg(F.sum("weight").alias("n"), F.min("words").alias("low"), F.max("words").alias("high"), F.min("source").alias("first")).where("n > 1")
    found = checkpoint(found.select("block", "w1", "w2", "first", F.when(F.col("low") != F.col("high"), F.raise_error(F.lit("two windows have one 96-bit name"))).alias("same")))
    lists = found.groupBy("block").agg(F.count("*").alias("n")).select("block", F.ceil(F.col("n") / LIST_WINDOWS).cast("long").alias("lists"))
    place = lambda w, n: F.pmod(F.xxhash64(w), n)
    packed = splittable_join(found.where("same is null"), lists, ["block"]).groupBy("block", "lists", place(F.col("w1"), F.col("lists")).alias("place")).agg(F.collect_list(F.struct("w1", "w2", "first")).alias("found"))
    packed = packed.withColumn("list", F.concat_ws(":", "block", "place"))
    stretches_ = some.mapInArrow(_hand_in(window, block, HOT_STRETCH), HOT_STRETCH)
    few = found.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    lists = F.broadcast(lists) if few else lists
    meet = stretches_.join(lists, "block") if few else splittable_join(stretches_, lists, ["block"])
    meet = meet.withColumn("place", F.explode(F.array_distinct(F.transform("w1", lambda w: place(w, F.col("lists")))))).drop("lists")
    packed = packed.drop("lists")
    met = meet.join(F.broadcast(packed), ["block", "place"]) if few else splittable_join(meet, packed, ["block", "place"])
    return met.select("list", "k1", "name", "at", "w1", "w2", "found").mapInArrow(_look_up(window), FACTORS)


def repeated_word_spans(docs: DataFrame, window: int = WINDOW, block: int = BLOCK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed, kept_sha256, spans (removed word ranges [from, to)), factors.

    A factor (start, length, source, source_start) says that so many words from ``start`` on stand in the document
    ``source`` (one of those with that text) from its word ``source_start`` on; for hot windows the place is null.
    A text that stands twice as a whole is one span without factors.
    """
    if not 1 <= block <= window:
        raise ValueError("a block has between one word and a window's words")
    spark = docs.sparkSession
    named = _named(docs, doc_id, text)
    once = named.select("k1", "k2", "doc_id", "text").mapInArrow(_once, "k1 long, k2 long, doc_id long, text binary")
    copies = named.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1")
    path = shared_folder(spark, "blocks")  # what two joins read is made once
    named.select("k1", "k2", "doc_id", "text").mapInArrow(_index_blocks(window, block), "block long, owner long, times int").write.parquet(path)
    blocks = spark.read.parquet(path)
    again = blocks.groupBy("block").agg(F.min("owner").alias("a"), F.max("owner").alias("b"), F.sum("times").alias("n")).where("a != b or n > 1").select("block", (F.col("n") > HOT_PLACES).alias("hot"))
    held = splittable_join(blocks.select("block", "owner"), again, ["block"])
    none = F.lit(None).cast("long")
    notes = held.select(F.col("owner").alias("k1"), F.when(~F.col("hot"), F.col("block")).alias("block"), F.when(F.col("hot"), F.col("block")).alias("hot"), none.alias("k2"))
    notes = notes.unionByName(copies.select("k1", none.alias("block"), none.alias("hot"), "k2"))
    notes = notes.groupBy("k1").agg(F.collect_set("block").alias("blocks"), F.collect_set("hot").alias("hot"), F.collect_set("k2").alias("copied"))
    notes = checkpoint(notes)  # a text's own blocks and no more
    lined = once.join(notes, "k1", "left")  # the one exchange of the texts
    handed = lined.mapInArrow(_hand_in(window, block, STRETCH), STRETCH).repartition("block").sortWithinPartitions("block")
    factors = handed.mapInArrow(_parse_blocks(window), FACTORS)
    if not notes.where(F.size("hot") > 0).isEmpty():
        factors = factors.unionByName(_hot_factors(lined, window, block))
    packed = factors.groupBy("k1").agg(F.collect_list(F.struct("name", "start", "length", "source", "source_start")).alias("factors"))
    out = "k1 long, k2 long, n_words long, n_removed long, kept_sha256 string, spans array<array<int>>, factors array<struct<start:int,length:int,source:long,source_start:int>>"
    done = lined.join(packed, "k1", "left").mapInArrow(_remove(window), out)
    done = done.groupBy("k1", "k2").agg(*[F.first(c).alias(c) for c in ("n_words", "n_removed", "kept_sha256", "spans", "factors")])
    return splittable_join(named.select("doc_id", "k1", "k2"), done, ["k1", "k2"]).select("doc_id", "n_words", "n_removed", "kept_sha256", "spans", "factors")
