"""Ranked lexical search: TPUT over term-partitioned postings.

An index holds a posting (term, impact, document) for every term of the items
that a document has; it is dealt by ranges of term and falling impact, so a
common term's list spans many partitions.  An item's score of a document is the
sum of its terms' impacts, so three rounds settle its best documents:

1. the heads of the lists: sums over them are lower bounds, and the k-th best of
   an item is a score that its best documents reach;
2. that score over the item's number of terms is a threshold for each of its
   lists: every posting above it is fetched, from all lists alike.  What a
   document can still have from below the thresholds bounds its score from
   above; those that can't reach the k-th best lower bound are out;
3. of the others all postings are looked up, which gives exact scores.

Fetched postings are dealt by document and summed there for all items at once,
in blocks, so no pair of an item and a document is ever a row before it is a
candidate.  Items are taken in blocks of at most ``BLOCK_BYTES`` of text or so.

Defined results: a null or empty text has no terms; documents with equal scores
come by identifier, a null one last; rows of documents that repeat an identifier
and a text are documents each, and so are rows of items; rows are told apart by
identifier and a 64-bit hash of the text; an item without terms, or whose terms
no document has, has no rows; an empty table gives none.  Extra columns of any
name are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, remove, shared_folder, slices

#: Text of items that are searched for together; their terms are broadcast.
BLOCK_BYTES = 8 << 20
#: Cells of a block of sums (items times documents) in a task.
CELLS = 2 << 20
#: Documents that go on to the last round and may be broadcast; they are counted first.
BROADCAST_DOCS = 50_000

#: A-Z lower-cased; bytes below 0x80 that are no letters or digits become spaces, so a term is a word of what is left.
FOLD = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in bytes(range(256)).lower())


def terms_of(raw: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return raw.translate(FOLD).split()


class Search:
    """A block of items: their terms by number, and which items have each term how often."""

    def __init__(self, items: list[tuple], k: int):
        self.ids, self.k = [i for i, _ in items], k
        found = [Counter(terms_of((t or "").encode())) for _, t in items]
        self.terms = {t: n for n, t in enumerate(sorted({t for c in found for t in c}))}
        self.asked = sorted((self.terms[t], i, q) for i, c in enumerate(found) for t, q in c.items())
        self.sizes = np.array([len(c) for c in found], np.int64)
        number, self.items, self.times = (np.array(x, np.int64) for x in zip(*self.asked, strict=True)) if self.asked else (np.zeros(0, np.int64),) * 3
        self.starts = np.searchsorted(number, np.arange(len(self.terms) + 1))

    def of(self, term: int):
        """Items that have a term, and how often."""
        s = slice(self.starts[term], self.starts[term + 1])
        return self.items[s], self.times[s]


def _documents(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("h"), F.encode(F.col(text), "utf-8").alias("text")).where(F.octet_length("text") > 0)


def _totals(rows: DataFrame, search) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and of each of the block's terms the documents that hold it."""

    def counted(batches):
        known, held, df = search.value.terms, [0, 0], Counter()
        for batch in batches:
            for raw in batch.column("text").to_pylist():
                found = terms_of(raw)
                held = [held[0] + bool(found), held[1] + len(found)]
                df.update(known.keys() & set(found))
        yield pa.RecordBatch.from_pydict({"term": pa.array([-2, -1, *(known[t] for t in df)], pa.int32()), "n": pa.array([*held, *df.values()], pa.int64())})

    sums = rows.select("text").mapInArrow(counted, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()  # a row for each term of the block
    by, df = dict(zip(sums["term"].tolist(), sums["n"].tolist(), strict=True)), np.zeros(len(search.value.terms), np.int64)
    for t, n in by.items():
        if t >= 0:
            df[t] = n
    return int(by.get(-2, 0)), int(by.get(-1, 0)), df


def weights(total: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)


def _postings(rows: DataFrame, search, total: int, words: int, weight: np.ndarray) -> DataFrame:
    """term, impact, doc_id, h, copies: rows that repeat a document in one batch are one posting."""

    def posted(batches):
        known = search.value.terms
        for whole in batches:
            for batch in slices(whole, "text"):
                texts, at = {}, Counter(zip(batch.column("doc_id").to_pylist(), batch.column("h").to_pylist(), strict=True))
                for key, raw in zip(zip(batch.column("doc_id").to_pylist(), batch.column("h").to_pylist(), strict=True), batch.column("text").to_pylist(), strict=True):
                    texts.setdefault(key, raw)
                term, tf, long_, doc, h, copies = [], [], [], [], [], []
                for key, raw in texts.items():
                    found = terms_of(raw)
                    counts = Counter(found)
                    mine = [(known[t], counts[t]) for t in known.keys() & counts.keys()]
                    if mine:
                        numbers, times = zip(*mine, strict=True)
                        term += numbers
                        tf += times
                        for out, v in ((long_, len(found)), (doc, key[0]), (h, key[1]), (copies, at[key])):
                            out += [v] * len(mine)
                if term:
                    number, f = np.array(term, np.int64), np.array(tf, np.int64)
                    m = 100 - 25 + 25 * np.array(long_, np.int64) * total // words
                    impact = weight[number] * (1_000_000_000 * f // (1000 * f + 12 * m))
                    yield pa.RecordBatch.from_pydict({"term": pa.array(number, pa.int32()), "impact": impact, "doc_id": pa.array(doc, pa.int64()), "h": pa.array(h, pa.int64()), "copies": pa.array(copies, pa.int64())}).filter(pa.array(impact > 0))

    return rows.mapInArrow(posted, "term int, impact long, doc_id long, h long, copies long")


def _doc_key(c: str = "") -> list:
    return [F.coalesce(F.col(f"{c}doc_id"), F.lit(0)), F.col(f"{c}doc_id").isNull(), F.col(f"{c}h")]


def _by_document(rows: DataFrame) -> DataFrame:
    return rows.repartition(*_doc_key()).sortWithinPartitions(*[c.asc() for c in _doc_key()], "term")


def _blocks(batches, most: int):
    """Batches of postings sorted by document -> tables of whole documents, at most ``most`` in each, and where they start."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if held.num_rows < 1 << 16:
            continue
        yield from _documents_in(held, most, False)
        held = held.slice(int(_starts(held)[-1]))
    if held is not None and held.num_rows:
        yield from _documents_in(held, most, True)


def _starts(table) -> np.ndarray:
    """Places where a document's postings begin."""
    if not table.num_rows:
        return np.zeros(0, np.int64)
    ids, void, h = _columns(table)
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (void[1:] != void[:-1]) | (h[1:] != h[:-1])
    return np.flatnonzero(new)


def _columns(table):
    ids = table.column("doc_id").combine_chunks()
    return ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), table.column("h").to_numpy()


def _documents_in(table, most: int, ended: bool):
    """The table's documents, at most ``most`` together; its last one only if no more of it can follow."""
    starts = _starts(table)
    ends = np.append(starts[1:], table.num_rows)
    if not ended:
        starts, ends = starts[:-1], ends[:-1]
    for at in range(0, len(starts), most):
        s, e = starts[at : at + most], ends[at : at + most]
        yield table.slice(s[0], e[-1] - s[0]), s - s[0]


def _unpacked(table, starts: np.ndarray):
    """(place of the document, term, impact) of each distinct posting, and each document's copies: one that comes again is the same row repeated."""
    place = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
    term, impact, copies = (table.column(c).to_numpy() for c in ("term", "impact", "copies"))
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (place[1:] != place[:-1])
    lowest = term == term[starts][place]  # a document's copies are counted at one of its terms
    times = np.bincount(place[lowest], copies[lowest], len(starts)).astype(np.int64)
    return place[new], term[new].astype(np.int64), impact[new], times


def _summed(search: Search, place: np.ndarray, term: np.ndarray, values: list[np.ndarray], n: int) -> list[np.ndarray]:
    """For each of ``values`` the sums over an item's terms, repeats included: items by documents."""
    out = [np.zeros((len(search.ids), n), np.int64) for _ in values]
    order = np.argsort(term, kind="stable")
    place, term, values = place[order], term[order], [v[order] for v in values]
    cuts = np.flatnonzero(np.diff(term)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(term)], strict=True):
        if a < b:
            items, times = search.of(int(term[a]))
            for sums, v in zip(out, values, strict=True):
                sums[np.ix_(items, place[a:b])] += times[:, None] * v[a:b]
    return out


def _heads(index: DataFrame, search: Search) -> np.ndarray:
    """Round 1: the k-th best sum over the lists' heads of each item."""
    spark = index.sparkSession
    order = [F.desc("impact"), *[c.asc() for c in _doc_key()]]
    once = index.groupBy("term", "impact", "doc_id", "h").agg(F.lit(1).alias("one"))
    top = once.withColumn("r", F.row_number().over(Window.partitionBy("term").orderBy(*order))).where(F.col("r") <= search.k).select("term", "impact", "doc_id", "h")
    asked = spark.createDataFrame(search.asked, "term int, item int, times long")
    sums = top.join(F.broadcast(asked), "term").groupBy("item", "doc_id", "h").agg(F.sum(F.col("impact") * F.col("times")).alias("low"))
    last = sums.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("low")))).where(F.col("r") == search.k).select("item", "low").collect()
    out = np.zeros(len(search.ids), np.int64)
    for r in last:
        out[r["item"]] = r["low"]
    return out


def _thresholds(search: Search, reached: np.ndarray, most: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each list the least impact that is fetched and the most that stays behind; of each item the most that all its lists keep back."""
    uniform = reached[search.items] // np.maximum(1, search.sizes[search.items] * search.times)
    from_ = np.full(len(search.terms), np.iinfo(np.int64).max)
    number = np.repeat(np.arange(len(search.terms)), np.diff(search.starts))
    np.minimum.at(from_, number, np.maximum(1, uniform))
    behind = np.where(least >= from_, 0, np.minimum(most, from_ - 1))
    slack = np.zeros(len(search.ids), np.int64)
    np.add.at(slack, search.items, search.times * behind[number])
    return from_, behind, slack


def _ranked(docs: DataFrame, items: list[tuple], k: int, doc_id: str, text: str) -> DataFrame:
    """The k best documents of each item of one block: item (place in the block), doc_id, h, copies, score."""
    spark = docs.sparkSession
    one = Search(items, k)
    search = spark.sparkContext.broadcast(one)
    rows = _documents(docs, doc_id, text)
    total, words, df = _totals(rows, search)
    folder = shared_folder(spark, "postings")
    # a term's postings by falling impact, over as many partitions as they fill
    posts = _postings(rows, search, total, max(1, words), weights(total, df))
    posts.repartitionByRange(F.col("term"), F.desc("impact"), *_doc_key()).sortWithinPartitions(F.col("term"), F.desc("impact"), *[c.asc() for c in _doc_key()]).write.parquet(folder)
    index = spark.read.parquet(folder)
    most, least = (np.zeros(len(one.terms), np.int64) for _ in range(2))
    for r in index.groupBy("term").agg(F.max("impact").alias("most"), F.min("impact").alias("least")).collect():  # a row for each term of the block
        most[r["term"]], least[r["term"]] = r["most"], r["least"]
    reached = _heads(index, one)
    from_, behind, slack = _thresholds(one, reached, most, least)
    cells = max(1, CELLS // max(1, len(one.ids)))

    limits = spark.createDataFrame([(t, int(v)) for t, v in enumerate(from_)], "term int, least long")
    fetched = _by_document(index.join(F.broadcast(limits), "term").where(F.col("impact") >= F.col("least")).select(*index.columns))
    fetched = checkpoint(fetched)

    def bounds(batches):
        """The k best lower bounds of each item among a task's documents."""
        own, best = search.value, None
        for table, starts in _blocks(batches, cells):
            place, term, impact, _ = _unpacked(table, starts)
            (low,) = _summed(own, place, term, [impact], len(starts))
            low = np.concatenate([best, low], 1) if best is not None else low
            best = -np.partition(-low, own.k - 1, axis=1)[:, : own.k] if low.shape[1] > own.k else low
        if best is not None:
            good = best >= np.maximum(reached, 1)[:, None]  # others raise nothing
            yield pa.RecordBatch.from_pydict({"item": pa.array(np.nonzero(good)[0], pa.int32()), "low": best[good]})

    lows = fetched.mapInArrow(bounds, "item int, low long")
    last = lows.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("low")))).where(F.col("r") == k)
    for r in last.select("item", "low").collect():
        reached[r["item"]] = max(reached[r["item"]], r["low"])

    def candidates(batches):
        """Documents that can reach an item's k-th best lower bound, with those items."""
        own = search.value
        for table, starts in _blocks(batches, cells):
            place, term, impact, _ = _unpacked(table, starts)
            low, over = _summed(own, place, term, [impact, impact - behind[term]], len(starts))
            able = (over + slack[:, None] >= np.maximum(reached, 1)[:, None]) & (low > 0)
            doc, item = np.nonzero(able.T)
            if len(doc):
                some, first = np.unique(doc, return_index=True)
                at = pa.array(starts[some])
                yield pa.RecordBatch.from_pydict({"doc_id": table.column("doc_id").combine_chunks().take(at), "h": table.column("h").combine_chunks().take(at), "items": [x.tolist() for x in np.split(item, first[1:])]}, schema=pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("items", pa.list_(pa.int32()))]))

    # the slack is below the score that was reached, so a document without a fetched posting can't be among the best
    chosen = checkpoint(fetched.mapInArrow(candidates, "doc_id long, h long, items array<int>"))
    best = checkpoint(_looked_up(index, chosen, search, cells))
    remove(spark, folder)
    return best


def _looked_up(index: DataFrame, chosen: DataFrame, search, cells: int) -> DataFrame:
    """Round 3: exact scores of the chosen documents for their items."""
    named = chosen.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), F.col("items"))
    if chosen.limit(BROADCAST_DOCS + 1).count() <= BROADCAST_DOCS:
        named = F.broadcast(named)
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g"))
    found = index.join(named, same).drop("d", "g")

    def exact(batches):
        own, best = search.value, None
        for table, starts in _blocks(batches, cells):
            place, term, impact, times = _unpacked(table, starts)
            (score,) = _summed(own, place, term, [impact], len(starts))
            asked = np.zeros(score.shape, bool)
            for n, items in enumerate(table.column("items").combine_chunks().take(pa.array(starts)).to_pylist()):
                asked[items, n] = True
            item, doc = np.nonzero(asked & (score > 0))
            ids, void, h = (c[starts[doc]] for c in _columns(table))
            more = [item, score[item, doc], void, ids, h, times[doc]]
            best = more if best is None else [np.concatenate(x) for x in zip(best, more, strict=True)]
            order = np.lexsort((best[4], best[3], best[2], -best[1], best[0]))
            best = [x[order] for x in best]
            rank = np.arange(len(order)) - np.searchsorted(best[0], best[0])
            best = [x[rank < own.k] for x in best]  # no more than k of a task can be among the k best
        if best is not None:
            item, score, void, ids, h, times = best
            yield pa.RecordBatch.from_pydict({"item": pa.array(item, pa.int32()), "doc_id": pa.array(ids, pa.int64(), mask=void), "h": h, "copies": times, "score": score})

    return _by_document(found).mapInArrow(exact, "item int, doc_id long, h long, copies long, score long")


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The k best documents of each item: item_id, rank (from 1), doc_id, score."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // BLOCK_BYTES))
    out = None
    for b in range(blocks):
        own = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        block = [(r["item_id"], r["text"]) for r in own.collect()]  # about BLOCK_BYTES
        block.sort(key=lambda x: (x[0] is None, x[0], x[1] or ""))
        found = _ranked(docs, block, k, doc_id, text)
        place = F.explode(F.sequence(F.lit(1), F.least(F.col("copies"), F.lit(k)))).alias("copy")  # rows that are alike: k of them are enough
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("h"), F.asc("copy")))
        best = found.select("item", "doc_id", "h", "score", place).withColumn("rank", rank).where(F.col("rank") <= k)
        names = F.broadcast(spark.createDataFrame([(i, x[0]) for i, x in enumerate(block)], "item int, item_id long"))
        best = best.join(names, "item").select("item_id", "rank", "doc_id", "score")
        out = best if out is None else out.unionByName(best)
    return out
