"""Language identification with a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time, on a
bounded sample of windows of labelled texts; it reads whole texts in windows of
``SPAN`` bytes, labels every byte position from both directions, and pools the
positions' log-probabilities over the document.

Defined results: a text that is null or has no letter is ``und`` with score 0;
without any labelled text all are; ties between languages go to the smaller
name; repeated rows get the same answer; extra columns of any name are ignored
or carried; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import prefix_for, slices

#: Bounds of the fit: different texts drawn for each language, windows for each of them. Languages have no bound.
FIT_DOCS, FIT_WINDOWS = 400, 4
HIDDEN = 6
SPAN = 64
STEPS, BATCH = 500, 192
#: Languages for which STEPS are taken; more languages get more steps.
STEP_LANGS = 64
UNDETERMINED = "und"


def _soft(x):
    """Soft sign; it stands for the hyperbolic tangent, at a sixth of its cost."""
    y = np.abs(x)
    y += 1
    return np.divide(x, y, out=y)


def _gate(x):
    y = _soft(x)
    y *= 0.5
    y += 0.5
    return y


def _soft_slope(y):
    return (1 - np.abs(y)) ** 2


def _gate_slope(y):
    return 0.5 * _soft_slope(2 * y - 1)


class ByteGru:
    """Parameters of both directions and of the output layer; arrays hold units first, windows last."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs, self.hidden = langs, hidden
        self.p = {}
        for d in "fb":
            self.p["T" + d] = rng.normal(0, 0.3, (3 * hidden, 256)).astype(np.float32)  # inputs: a column for each byte
            self.p["U" + d] = rng.normal(0, 1 / np.sqrt(hidden), (3 * hidden, hidden)).astype(np.float32)
            self.p["c" + d] = np.zeros((hidden, 1), np.float32)
        self.p["V"] = rng.normal(0, 0.3, (len(langs), 2 * hidden)).astype(np.float32)
        self.p["a"] = np.zeros((len(langs), 1), np.float32)

    def _scan(self, d: str, x: np.ndarray, keep: bool):
        """States (hidden, steps, windows) of one direction over x (steps, windows); and what training needs."""
        h_n, (steps, n) = self.hidden, x.shape
        u, c = self.p["U" + d], self.p["c" + d]
        inputs = np.take(self.p["T" + d].T.copy(), x, axis=0)  # (steps, windows, 3 hidden)
        states = np.zeros((h_n, steps, n), np.float32)
        h, saved = np.zeros((h_n, n), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = u @ h
            own = np.ascontiguousarray(inputs[t].T)
            zr = _gate(own[: 2 * h_n] + g[: 2 * h_n])
            z, r = zr[:h_n], zr[h_n:]
            m = g[2 * h_n :] + c
            new = _soft(own[2 * h_n :] + r * m)
            if keep:
                saved.append((t, h, z, r, m, new))
            h = new + z * (h - new)
            states[:, t] = h
        return states, saved

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """(languages, steps, windows) for bytes x (steps, windows)."""
        h = np.concatenate([self._scan(d, x, False)[0] for d in "fb"])
        return self._out(h)

    def _out(self, h):
        logits = (self.p["V"] @ h.reshape(len(h), -1) + self.p["a"]).reshape(-1, *h.shape[1:])
        logits -= logits.max(0)
        logits -= np.log(np.exp(logits).sum(0))
        return logits

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        """Mean loss over positions of weight 1 and its gradients, by backpropagation through time."""
        n_h, grads = self.hidden, {k: np.zeros_like(v) for k, v in self.p.items()}
        scans = {d: self._scan(d, x, True) for d in "fb"}
        h = np.concatenate([scans[d][0] for d in "fb"])
        logp = self._out(h)
        total = max(1.0, float(weight.sum()))
        loss = -float((np.take_along_axis(logp, y[None, None, :], 0)[0] * weight).sum()) / total
        dl = np.exp(logp)
        dl[y, :, np.arange(x.shape[1])] -= 1
        dl *= weight / total
        flat = dl.reshape(len(dl), -1)
        grads["V"] = flat @ h.reshape(len(h), -1).T
        grads["a"] = flat.sum(1, keepdims=True)
        dh_all = (self.p["V"].T @ flat).reshape(h.shape)
        for i, d in enumerate("fb"):
            u, dh = self.p["U" + d], np.zeros((n_h, x.shape[1]), np.float32)
            d_in = np.zeros((3 * n_h, *x.shape), np.float32)
            for t, before, z, r, m, new in reversed(scans[d][1]):
                dh = dh + dh_all[i * n_h : (i + 1) * n_h, t]
                dnew = dh * (1 - z) * _soft_slope(new)
                dz = dh * (before - new) * _gate_slope(z)
                dr = dnew * m * _gate_slope(r)
                dg = np.concatenate([dz, dr, dnew * r])
                grads["U" + d] += dg @ before.T
                grads["c" + d] += dg[2 * n_h :].sum(1, keepdims=True)
                d_in[:, t] = np.concatenate([dz, dr, dnew])
                dh = dh * z + u.T @ dg
            for unit, row in enumerate(d_in.reshape(3 * n_h, -1)):
                grads["T" + d][unit] = np.bincount(x.ravel(), row, 256)
        return loss, grads

    def fit(self, windows: np.ndarray, labels: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = 0.02, seed: int = 11) -> ByteGru:
        """Adam over batches that draw every language alike."""
        rng = np.random.default_rng(seed)
        groups = [np.flatnonzero(labels == k) for k in range(len(self.langs))]
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            at = np.array([rng.choice(groups[k]) for k in rng.integers(0, len(groups), batch)])
            x = windows[at].T
            _, grads = self.gradients(np.ascontiguousarray(x), labels[at], (x != 0).astype(np.float32))
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            now = rate * min(1.0, 3 * (1 - step / (steps + 1))) * min(1.0, 1.0 / (norm + 1e-9))
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                self.p[k] -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
        return self


def cut(raw: bytes, span: int) -> np.ndarray:
    """All bytes of a text in windows of ``span``, the last filled up with 0."""
    data = np.frombuffer(raw, np.uint8)
    out = np.zeros(-(-len(data) // span) * span, np.uint8)
    out[: len(data)] = data
    return out.reshape(-1, span)


def held_out(doc_id):
    """crc32 of the identifier as text (null: empty) modulo 5 is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", span: int = SPAN) -> ByteGru | None:
    """The network fitted to every label, to at most FIT_DOCS different texts each and FIT_WINDOWS windows of a text, drawn by hash of the text."""
    body = F.encode(F.col(text), "utf-8")
    rows = docs.where(~held_out(F.col(doc_id)) & F.col(lang).isNotNull() & (F.octet_length(body) > 0)).select(F.col(lang).alias("lang"), F.xxhash64(F.col(text)).alias("h"), F.octet_length(body).alias("size"), body.alias("body"))
    drawn = rows.select("lang", "h").distinct().withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= FIT_DOCS).drop("r")
    pieces = []  # windows at places that the hash names, so no text travels whole
    for k in range(FIT_WINDOWS):
        start = F.pmod(F.xxhash64("h", F.lit(k)), F.greatest(F.col("size") - span, F.lit(0)) + 1)
        pieces.append(F.substring(F.col("body"), start.cast("int") + 1, F.lit(span)).alias(f"w{k}"))
    rows = rows.join(F.broadcast(drawn), ["lang", "h"], "left_semi").select("lang", "h", *pieces).dropDuplicates(["lang", "h"])
    picked = sorted(rows.collect(), key=lambda r: (r["lang"], r["h"]))
    langs = sorted({r["lang"] for r in picked})
    place = {name: i for i, name in enumerate(langs)}
    found = [(place[r["lang"]], bytes(r[f"w{k}"])) for r in picked for k in range(FIT_WINDOWS)]
    if not found:
        return None
    windows = np.zeros((len(found), span), np.uint8)
    for row, (_, w) in zip(windows, found, strict=True):
        row[: len(w)] = np.frombuffer(w, np.uint8)
    return ByteGru(langs).fit(windows, np.array([i for i, _ in found]), STEPS * -(-len(langs) // STEP_LANGS))


def label_texts(net: ByteGru, texts: list[bytes], span: int = SPAN, block: int = 2048) -> tuple[list[str], list[float]]:
    """Pooled language and score of each text; every byte of every text is labelled."""
    cuts = [cut(t, span) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(c) for c in cuts])
    sums = np.zeros((len(net.langs), len(texts)))
    if len(owner):
        windows = np.concatenate(cuts)
        for at in range(0, len(windows), block):
            x = np.ascontiguousarray(windows[at : at + block].T)
            per = (net.log_probabilities(x) * (x != 0)).sum(1)
            for k, row in enumerate(per):
                sums[k] += np.bincount(owner[at : at + block], row, len(texts))
    mean = sums / np.maximum(1, np.array([len(t) for t in texts]))
    odds = np.exp(mean - mean.max(0))
    odds /= odds.sum(0)
    best = odds.argmax(0)
    return [net.langs[i] for i in best], odds[best, np.arange(len(texts))].tolist()


def predicted_languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", keep: tuple[str, ...] | None = None) -> DataFrame:
    """One row for each document: doc_id, held_out, lang_pred, score; or all of ``keep`` with the last two under the prefix that ``prefix_for`` gives."""
    net = train(docs, doc_id, text, lang)
    spark, p = docs.sparkSession, prefix_for(docs)
    held = spark.sparkContext.broadcast(net)
    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.when(letter, F.encode(F.col(text), "utf-8")).alias("text")) if keep is None else docs.select(*keep, F.when(letter, F.encode(F.col(text), "utf-8")).alias(f"{p}text"))
    column = "text" if keep is None else f"{p}text"
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != column]
    names = ("lang_pred", "score") if keep is None else (f"{p}lang_pred", f"{p}score")

    def run(batches):
        own = held.value
        for whole in batches:
            for batch in slices(whole, column):
                texts = batch.column(column)
                some = [i for i in range(batch.num_rows) if texts[i].is_valid] if own else []
                langs, scores = [UNDETERMINED] * batch.num_rows, [0.0] * batch.num_rows
                found = label_texts(own, [texts[i].as_py() for i in some]) if some else ([], [])
                for i, name, score in zip(some, *found, strict=True):
                    langs[i], scores[i] = name, score
                out = batch.drop_columns([column])
                yield out.append_column(names[0], pa.array(langs, pa.string())).append_column(names[1], pa.array(scores, pa.float64()))

    return rows.mapInArrow(run, ", ".join([*fields, f"{names[0]} string", f"{names[1]} double"]))
