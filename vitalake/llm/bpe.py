"""Byte-level BPE of whole texts by a public vocabulary."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vitalake.sources.tables import spread

#: Where the public vocabularies are; a parameter of every function below.
FOLDER = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"
#: How byte-level BPE cuts a text before it merges; a fixed value of the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A worker keeps the ids of so many different pieces, of so many bytes at most each.
KEPT, KEPT_BYTES = 200_000, 64
NEVER = 1 << 60


def ranks(path: str) -> dict[bytes, int]:
    """Token to id, which is also the rank of the merge that makes it, from a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def vocabulary(name: str = VOCABULARY, folder: str = FOLDER) -> dict[bytes, int]:
    """The ranks of a public vocabulary in ``folder``."""
    return ranks(os.path.join(folder, f"{name}.tiktoken"))


def merge(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    """Ids of ``piece``: the pair of least rank is merged, leftmost first, until none is left.

    A segment tree over the byte positions holds, for each stretch of them, the least
    (rank, position) of a pair that begins there; a merge changes the pairs of the
    live neighbours only, each by a walk from its leaf to the root.
    """
    n = len(piece)
    whole = rank.get(piece)
    if whole is not None:
        return [whole]
    size = 1
    while size < n:
        size *= 2
    # rank * n + position: one number that orders by rank and then from the left.
    tree = [NEVER] * (2 * size)
    follows = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    for i in range(n - 1):
        r = rank.get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r * n + i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    def put(i: int, value: int) -> None:
        i += size
        if tree[i] == value:
            return
        tree[i] = value
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            least = a if a < b else b
            if tree[i] == least:
                return
            tree[i] = least
            i >>= 1

    while tree[1] != NEVER:
        i = tree[1] % n
        j = follows[i]
        after = follows[j]
        follows[i] = after
        put(j, NEVER)
        if after < n:
            before[after] = i
            r = rank.get(piece[i : follows[after]])
            put(i, NEVER if r is None else r * n + i)
        else:
            put(i, NEVER)
        h = before[i]
        if h >= 0:
            r = rank.get(piece[h:after])
            put(h, NEVER if r is None else r * n + h)
    out, i = [], 0
    while i < n:
        out.append(rank[piece[i : follows[i]]])
        i = follows[i]
    return out


class Encoder:
    """Encodes texts; frequent pieces are merged once and kept."""

    def __init__(self, rank: dict[bytes, int]) -> None:
        import regex

        self.rank = rank
        self.cut = regex.compile(PATTERN).findall
        self.kept: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """Ids of ``text`` without special tokens; none for null and empty texts."""
        if not text:
            return []
        out: list[int] = []
        kept = self.kept
        for piece in self.cut(text):
            ids = kept.get(piece)
            if ids is None:
                raw = piece.encode("utf-8", "surrogatepass")
                ids = merge(raw, self.rank)
                if len(raw) <= KEPT_BYTES:
                    if len(kept) >= KEPT:
                        kept.clear()
                    kept[piece] = ids
            out += ids
        return out


def _per_batch(df: DataFrame, key: str, text: str, rank: dict[bytes, int], lengths: bool) -> DataFrame:
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(rank)  # a vocabulary of fixed size
    kind = df.schema[key].dataType.simpleString()
    column = "n_tokens" if lengths else "ids"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for b in batches:
            at = 0
            # A batch may hold very long texts, so its ids are passed on in parts.
            while at < b.num_rows:
                ids: list[np.ndarray] = []
                total, start = 0, at
                for t in b["t"].slice(start):
                    got = np.array(encoder.encode(t.as_py()), np.int32)
                    ids.append(got)
                    total += len(got)
                    at += 1
                    if total > 1 << 20:
                        break
                sizes = np.array([len(x) for x in ids], np.int32)
                if lengths:
                    made = pa.array(sizes)
                else:
                    offsets = np.zeros(len(ids) + 1, np.int32)
                    offsets[1:] = np.cumsum(sizes)
                    made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([b["k"].slice(start, at - start), made], names=[key, column])

    kind_out = "int" if lengths else "array<int>"
    return spread(df.select(df[key].alias("k"), df[text].alias("t"))).mapInArrow(run, f"`{key}` {kind}, {column} {kind_out}")


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = VOCABULARY, folder: str = FOLDER) -> DataFrame:
    """``key`` and ``ids`` of each text by a public byte-level BPE, without special tokens.

    Null and empty texts give an empty list; blank texts are encoded as they are; strings
    that look like special tokens are ordinary text; texts are encoded whole, however
    long; repeated rows and null keys are kept; an empty table gives an empty one;
    further columns aren't looked at. Row by row, without a shuffle of large inputs.
    """
    return _per_batch(df, key, text, vocabulary(name, folder), lengths=False)


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = VOCABULARY, folder: str = FOLDER) -> DataFrame:
    """``key`` and ``n_tokens`` of each text, as ``encode_texts`` would give."""
    return _per_batch(df, key, text, vocabulary(name, folder), lengths=True)
