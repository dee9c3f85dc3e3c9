"""Quality classifier: histogram gradient-boosted trees over statistics of whole documents.

Statistics are counted in tasks over every byte, word and line of a text.  The
trees are fitted in numpy to at most about ``FIT_ROWS`` labelled documents,
drawn by the hash of their identifier: features are cut into at most ``BINS``
bins, each level of a tree is one histogram of gradients over (node, feature,
bin), and the trees end as flat arrays (feature, threshold, child, value) that
are walked for all rows and trees at once.

Defined results: a null text counts as empty; an empty text has every statistic
0 and the score that the trees give to that; documents that share an identifier
with a label are all labelled by it, equal ones once, and those with several
labels are fitted to each; labels other than 0 and 1 are ignored; without a
usable label every score is 0.5, and with labels of one kind it is their
smoothed rate; repeated rows are scored each; an empty table gives no rows.
Extra columns of any name are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, drawn_rows, slices

#: Bound on the labelled documents that the trees are fitted to.
FIT_ROWS = 20_000
TREES, DEPTH, BINS, RATE = 80, 5, 128, 0.15
#: Least sum of second derivatives in a leaf, and what is added to it.
LEAST, SMOOTH = 2.0, 1.0
KEEP_FROM = 0.7

#: Classes of bytes whose shares are statistics.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t\v\f\r", "line_end": b"\n",
    "stop": b".", "pause": b",;:", "shout": b"!", "ask": b"?", "quote": b"\"'`", "bracket": b"()[]{}<>", "bar": b"|", "symbol": b"#$%&*+=@\\^_~/-", "control": bytes(c for c in (*range(9), *range(14, 32), 127)), "high": bytes(range(128, 256)),
}
FEATURES = (
    "bytes", "words", "lines", *CLASSES, "word_length", "word_length_spread", "long_words", "distinct_words", "top_word", "same_as_last", "longest_run", "distinct_pairs",
    "capital_words", "marked_words", "bare_marks", "repeated_lines", "line_words", "blank_lines", "marked_lines",
)
_MEMBER = np.array([[c in members for members in CLASSES.values()] for c in range(256)], np.float64)
_BARE = bytes(c for c in range(128) if not bytes([c]).isalnum())
_MARKS = frozenset(b"!?|#$%&*+=@\\^_~<>{}[]")


def statistics(raw: bytes) -> list[float]:
    """The values of FEATURES for a text in UTF-8."""
    if not raw:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = raw.split(), raw.split(b"\n")
    n, k = max(1, len(words)), max(1, len(lines))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    seen, pairs = Counter(words), set(zip(words, words[1:], strict=False))
    same = np.fromiter(map(bytes.__eq__, words, words[1:]), bool, max(0, len(words) - 1)) if len(words) > 1 else np.zeros(0, bool)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
    full = [line for line in (x.strip() for x in lines) if line]
    capital, marked, bare = 0, 0, 0
    for w, c in seen.items():
        capital += c * (len(w) > 1 and w.isupper())
        marked += c * (w[-1] in _MARKS)
        bare += c * (not w.strip(_BARE))
    return [
        float(np.log1p(len(raw))), float(np.log1p(len(words))), float(np.log1p(len(lines))), *(counts @ _MEMBER / len(raw)),
        float(sizes.mean()), float(sizes.std()), float((sizes > 30).mean()), len(seen) / n, max(seen.values(), default=0) / n, float(same.sum()) / n,
        float((edges[1::2] - edges[::2]).max(initial=0)), len(pairs) / max(1, len(words) - 1), capital / n, marked / n,
        bare / n, 1 - len(set(full)) / max(1, len(full)), n / k, 1 - len(full) / k,
        sum(line[-1] in _MARKS for line in full) / max(1, len(full)),
    ]


class Trees:
    """Boosted trees as flat arrays: node i of a tree goes to ``child[i] + (x[feature[i]] > threshold[i])``; a leaf is its own child."""

    def __init__(self, base: float):
        self.base = base
        self.feature = np.zeros((0, 0), np.int32)

    def fit(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
        cuts = [self._cuts(c) for c in x.T]
        bins = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], 1)
        width, nodes = max(map(len, cuts)) + 1, 2 ** (depth + 1) - 1
        self.feature, self.child = (np.zeros((trees, nodes), np.int32) for _ in range(2))
        self.threshold, self.value = np.full((trees, nodes), np.inf), np.zeros((trees, nodes))
        places = bins + np.arange(x.shape[1]) * width  # a cell for each feature and bin
        total = np.full(len(y), self.base)
        for t in range(trees):
            p = 1 / (1 + np.exp(-total))
            at = self._grow(t, p - y, p * (1 - p), bins, places, cuts, width, depth)
            total += self.value[t, at]
        return self

    @staticmethod
    def _cuts(column: np.ndarray) -> np.ndarray:
        """Values that divide a feature's distinct values into at most BINS bins of about as many rows each."""
        values, counts = np.unique(column, return_counts=True)
        if len(values) <= BINS:
            return (values[1:] + values[:-1]) / 2
        ranks = np.searchsorted(np.cumsum(counts), np.arange(1, BINS) * len(column) / BINS)
        at = np.unique(np.minimum(ranks, len(values) - 2))
        return (values[at] + values[at + 1]) / 2

    def _grow(self, t, g, h, bins, places, cuts, width, depth) -> np.ndarray:
        """Grows tree t level by level; returns each row's leaf."""
        at, free, cells = np.zeros(len(g), np.int64), 1, places.shape[1] * width
        open_ = [0]
        for level in range(depth + 1):
            row = np.full(self.feature.shape[1], -1)
            row[open_] = np.arange(len(open_))
            slot = row[at]
            live = np.flatnonzero(slot >= 0)
            if not len(live):
                break
            flat = (slot[live, None] * cells + places[live]).ravel()
            sums = [np.bincount(flat, np.repeat(v[live], places.shape[1]), len(open_) * cells).reshape(len(open_), -1, width) for v in (g, h)]
            whole = [s[:, 0].sum(1) for s in sums]
            self.value[t, open_] = -RATE * whole[0] / (whole[1] + SMOOTH)
            self.child[t, open_] = open_
            if level == depth:
                break
            left = [s.cumsum(2) for s in sums]
            right = [w[:, None, None] - c for w, c in zip(whole, left, strict=True)]
            gain = left[0] ** 2 / (left[1] + SMOOTH) + right[0] ** 2 / (right[1] + SMOOTH) - (whole[0] ** 2 / (whole[1] + SMOOTH))[:, None, None]
            gain[(left[1] < LEAST) | (right[1] < LEAST)] = 0
            best = gain.reshape(len(open_), -1).argmax(1)
            split = {node: divmod(int(b), width) for node, b, s in zip(open_, best, gain.reshape(len(open_), -1).max(1), strict=True) if s > 1e-6}
            following = []
            for node, (f, b) in split.items():
                self.feature[t, node], self.threshold[t, node], self.child[t, node] = f, cuts[f][b], free
                following += [free, free + 1]
                free += 2
            moved = live[np.isin(at[live], list(split))]
            f = self.feature[t, at[moved]]
            at[moved] = self.child[t, at[moved]] + (bins[moved, f] > np.array([split[int(a)][1] for a in at[moved]]))
            open_ = following
        return at

    def scores(self, x: np.ndarray, depth: int = DEPTH) -> np.ndarray:
        """Probability of label 1 for each row: all rows walk all trees a level at a time."""
        total = np.full(len(x), self.base)
        if self.feature.size and len(x):
            trees, rows = np.arange(len(self.feature))[:, None], np.arange(len(x))
            at = np.zeros((len(self.feature), len(x)), np.int64)
            for _ in range(depth):
                over = x[rows, self.feature[trees, at]] > self.threshold[trees, at]
                at = self.child[trees, at] + over
            total = total + self.value[trees, at].sum(0)
        return 1 / (1 + np.exp(-total))


def held_out(doc_id):
    """crc32 of the identifier as text (null: empty) modulo 4 is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def labelled_statistics(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, h, label and statistics of about ``rows`` labelled documents that are not held out."""
    usable = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(~held_out(F.col("doc_id")) & F.col("label").isin(0, 1)).distinct()
    usable = checkpoint(usable)
    drawn = drawn_rows(usable, F.xxhash64("doc_id"), usable.count(), rows)  # about ``rows`` by construction
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8").alias("text"))
    texts = texts.join(F.broadcast(drawn), "doc_id").select("doc_id", "h", "label", "text")

    def measured(batches):
        for batch in batches:
            found = [statistics(raw) for raw in batch.column("text").to_pylist()]
            yield batch.drop_columns(["text"]).append_column("x", pa.array(found, pa.list_(pa.float64())))

    found = checkpoint(texts.mapInArrow(measured, "doc_id long, h long, label int, x array<double>").dropDuplicates(["doc_id", "h", "label"]))
    return drawn_rows(found, F.xxhash64("doc_id", "h"), found.count(), rows)  # an identifier may stand for many texts


def fitted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS) -> Trees:
    picked = sorted(labelled_statistics(docs, labels, doc_id, text, label, rows).collect(), key=lambda r: (r["doc_id"], r["h"], r["label"]))
    y = np.array([r["label"] for r in picked], np.float64)
    if not len(y):
        return Trees(0.0)
    ones = float(y.sum())
    trees = Trees(float(np.log((ones + 1) / (len(y) - ones + 1))))
    return trees.fit(np.array([r["x"] for r in picked]), y) if 0 < ones < len(y) else trees


def quality_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", keep_from: float = KEEP_FROM) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, doc_id, text, label))
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8").alias("text"))

    def scored(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                x = np.array([statistics(raw.as_py()) for raw in batch.column("text")]).reshape(batch.num_rows, len(FEATURES))
                score = model.value.scores(x)
                yield batch.drop_columns(["text"]).append_column("score", pa.array(score)).append_column("predicted", pa.array((score >= keep_from).astype(np.int32)))

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scored, f"doc_id {kind}, held_out boolean, score double, predicted int")
