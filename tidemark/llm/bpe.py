"""Byte-level BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes cuts every text where its content says so, so a
passage that documents share falls into the same chunks in each of them.  A
chunk is encoded once, as if it were a text, and its tokens are kept in a
bounded table for all documents of the worker.

Where two chunks meet their tokens may be wrong.  The joint is repaired by
encoding a stretch around it anew: from a place in the left chunk to a place in
the right one at which both the chunk's own tokens and the text have an end of
a pre-token.  The stretch grows, over whole chunks if need be, until both sides
agree; the tokens beyond it are then exactly the whole text's.  Places that are
ends of a pre-token whatever stands around are those before a single space
between two printable ASCII characters, and before a full-width stop, comma,
question or exclamation mark behind a Han character; the pre-tokenizer reads
from left to right and looks ahead only, so from there on it goes alike.

Stretches with characters from U+0400 on, where libraries may know different
Unicode versions, are encoded by the tokenizers library; others by tiktoken
over the same vocabulary, read from the same file.

Defined results: a null text counts as empty; an empty text has no tokens and
the digests of no bytes; every row has its own result, repeated or not; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices

WINDOW_BITS = 5  # the rolling hash sees 32 bytes
MASK = (1 << 10) - 1  # a cut every 1,024 bytes on average
TABLE_BYTES = 24 << 20  # of chunks kept for reuse in a worker
#: Pre-tokenizer pattern of byte-level BPE files (fixed value of the format).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary file, with the chunk table of this worker."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        ranks = {bytes(alphabet[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
        self.fast = tiktoken.Encoding("tidemark", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
        table = [b""] * (max([*ranks.values(), *special.values()]) + 1)
        for word, i in ranks.items():
            table[i] = word
        for word, i in special.items():
            table[i] = word.encode()
        self.length = np.array([len(x) for x in table], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        mix = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.gear = ((mix ^ (mix >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)
        self.table: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        self.held = self.asked = self.reused = 0

    def _encode(self, part: bytes) -> np.ndarray:
        if part.isascii() or max(part) < 0xD0:
            return self.fast.encode_to_numpy(part.decode(), allowed_special="all").astype(np.uint32, copy=False)
        return np.array(self.library.encode(part.decode(), add_special_tokens=False).ids, np.uint32)

    def _edges(self, data: np.ndarray) -> list[int]:
        """Where the chunks begin, and the end; never within a character."""
        h = self.gear[data]
        for k in range(WINDOW_BITS):
            step = 1 << k
            h[step:] = h[step:] + (h[:-step] << np.uint32(step) | h[:-step] >> np.uint32(32 - step))
        at = np.flatnonzero((h[32:] >> np.uint32(7)) & np.uint32(MASK) == 0) + 33
        for _ in range(3):
            at = np.where((at < len(data)) & (data[np.minimum(at, len(data) - 1)] & 0xC0 == 0x80), at + 1, at)
        return np.unique(np.concatenate([[0], at, [len(data)]])).tolist()

    @staticmethod
    def _ends(data: np.ndarray) -> np.ndarray:
        """Places that end a pre-token whatever stands around them."""
        plain = (data > 0x20) & (data < 0x7F)
        at = np.flatnonzero(plain[:-2] & (data[1:-1] == 0x20) & plain[2:]) + 1
        if len(data) < 6 or data.max() < 0xE3:
            return at
        han = (data[:-5] >= 0xE5) & (data[:-5] <= 0xE8)
        a, b, c = data[3:-2], data[4:-1], data[5:]
        stop = (a == 0xE3) & (b == 0x80) & ((c == 0x81) | (c == 0x82)) | (a == 0xEF) & (b == 0xBC) & ((c == 0x81) | (c == 0x8C) | (c == 0x9F))
        return np.union1d(at, np.flatnonzero(han & stop) + 3)

    def encode(self, text: str | None) -> np.ndarray:
        raw = (text or "").encode()
        if not raw:
            return np.zeros(0, np.uint32)
        data = np.frombuffer(raw, np.uint8)
        edges = self._edges(data)
        if len(edges) == 2:
            return self._chunk(raw)[0]
        places = self._ends(data)
        parts, at, joint = [], 0, None  # tokens of raw[:at] are put out; a joint that is open begins at ``joint``
        for a, b in zip(edges, edges[1:], strict=False):
            ids, ends = self._chunk(raw[a:b])
            if joint is not None:
                own = places[np.searchsorted(places, a) : np.searchsorted(places, b)]
                at = next((p for p in own.tolist() if self._is_end(ends, p - a)), None)
                if at is None:
                    continue  # no agreement within this chunk: the stretch grows over it
                if at > joint:
                    parts.append(self._encode(raw[joint:at]))
                joint = None
            first = int(np.searchsorted(ends, at - a, side="right"))
            if b == len(raw):
                parts.append(ids[first:])
                continue
            own = places[np.searchsorted(places, at, side="right") : np.searchsorted(places, b, side="right")]
            joint = next((p for p in own[::-1].tolist() if self._is_end(ends, p - a)), at)
            parts.append(ids[first : int(np.searchsorted(ends, joint - a, side="right"))])
        if joint is not None:
            parts.append(self._encode(raw[joint:]))
        return np.concatenate(parts).astype(np.uint32, copy=False)

    @staticmethod
    def _is_end(ends: np.ndarray, offset: int) -> bool:
        """Whether a chunk's own tokens end at ``offset``, too."""
        i = int(np.searchsorted(ends, offset))
        return offset == 0 or i < len(ends) and ends[i] == offset

    def _chunk(self, part: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of a chunk and the places where they end."""
        found = self.table.get(part)
        self.asked += len(part)
        if found is None:
            ids = self._encode(part)
            found = self.table[part] = ids, np.cumsum(self.length[ids])
            self.held += len(part) + 3 * ids.nbytes + 300
            while self.held > TABLE_BYTES:
                old = next(iter(self.table))
                self.held -= len(old) + 3 * self.table.pop(old)[0].nbytes + 300
        else:
            self.reused += len(part)
        return found

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        n = self.length[ids]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[ids] - ends + n, n)
        return self.bytes[at].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encoded(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each document: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, if asked for).

    ``path`` is the vocabulary file, at the same place on every executor.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        own = codec(path)
        for whole in batches:
            for batch in slices(whole, "text"):
                counts, digests, texts, lists = [], [], [], []
                for value in batch.column("text"):
                    ids = own.encode(value.as_py())
                    counts.append(len(ids))
                    digests.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    texts.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
                    if with_ids:
                        lists.append(ids.astype(np.int32))
                columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array(lists, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
