"""Encoding of a corpus with a byte-level BPE vocabulary.

A segment tree over the ranks of adjacent pairs yields the leftmost pair of lowest rank at its root; a merge changes
three leaves, so a word of n bytes takes O(n log n) whatever its length. Words repeat, so each worker keeps the ids of
those it has seen, up to a bound.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import only, spread

# fixed value: how this vocabulary splits a text into words
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: words a worker remembers, and the longest it keeps; both bound memory only, others are encoded anew
REMEMBERED, REMEMBERED_LENGTH = 300_000, 200
#: ids in one Arrow batch of results, at least one text
BATCH_IDS = 2_000_000
_NO_PAIR = 1 << 62


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    parts: list[bytes] = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def key(i: int) -> int:
        """Rank of the pair that starts at part i, with its place below it; so the least is the leftmost of lowest rank."""
        j = after[i]
        rank = ranks.get(parts[i] + parts[j]) if j < n else None
        return _NO_PAIR if rank is None else rank << 32 | i

    tree = [_NO_PAIR] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = key(i)
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        while k > 1:
            k >>= 1
            least = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == least:
                break
            tree[k] = least

    while (least := tree[1]) != _NO_PAIR:
        i = least & 0xFFFFFFFF
        j = after[i]
        parts[i] += parts[j]
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        if j < n - 1:
            put(j, _NO_PAIR)
        put(i, key(i) if i < n - 1 else _NO_PAIR)
        if before[i] >= 0:
            put(before[i], key(before[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[parts[i]])
        i = after[i]
    return out


class _Words(dict):
    """word -> what `result` makes of its ids; forgets all when it grows too large."""

    def __init__(self, ranks: dict[bytes, int], result: Callable):
        self.ranks, self.result = ranks, result

    def __missing__(self, word: str):
        value = self.result(merge(word.encode("utf-8", "surrogatepass"), self.ranks))
        if len(word) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = value
        return value


_vocabularies: dict[str, dict[bytes, int]] = {}


def _ranks(vocabulary: _Vocabulary) -> dict[bytes, int]:
    """Parsed once per worker process."""
    if vocabulary.id not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[vocabulary.id] = read_ranks(vocabulary.broadcast.value)
    return _vocabularies[vocabulary.id]


class _Vocabulary:
    def __init__(self, broadcast, ident: str):
        self.broadcast, self.id = broadcast, ident


def share(df: DataFrame, vocabulary: str) -> _Vocabulary:
    """The vocabulary file, of fixed size, for the workers; it need only lie on the driver."""
    with open(vocabulary, "rb") as f:
        data = f.read()
    return _Vocabulary(df.sparkSession.sparkContext.broadcast(data), hashlib.md5(data).hexdigest())


def _encoder(vocabulary: _Vocabulary) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split = regex.compile(PATTERN).findall
        words = _Words(_ranks(vocabulary), lambda ids: array("i", ids))

        def batch_of(docs: pa.Array, ends: array, ids: array) -> pa.RecordBatch:
            values = pa.Array.from_buffers(pa.int32(), len(ids), [None, pa.py_buffer(ids)])
            lists = pa.ListArray.from_arrays(pa.Array.from_buffers(pa.int32(), len(ends), [None, pa.py_buffer(ends)]), values)
            return pa.RecordBatch.from_arrays([docs, lists], names=["doc_id", "ids"])

        for batch in batches:
            docs, texts = batch.column(0), batch.column(1)
            ids, ends, first = array("i"), array("i", [0]), 0
            for k in range(batch.num_rows):
                text = texts[k].as_py()
                if text:
                    for word in split(text):
                        ids += words[word]
                ends.append(len(ids))
                if len(ids) > BATCH_IDS or k == batch.num_rows - 1:
                    yield batch_of(docs.slice(first, k + 1 - first), ends, ids)
                    ids, ends, first = array("i"), array("i", [0]), k + 1

    return run


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) of every row, ids in order and without special tokens.

    Null and empty texts give an empty list; blank ones the ids of their white space. The strings of special tokens are
    ordinary text. Repeated keys give a row each. Long texts are encoded whole. A table of fewer
    tasks than cores is spread out first; otherwise no shuffle takes place.
    """
    return spread(only(docs, key, text)).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_encoder(share(docs, vocabulary)), "doc_id bigint, ids array<int>")


def _counter(vocabulary: _Vocabulary) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split = regex.compile(PATTERN).findall
        size = _Words(_ranks(vocabulary), len).__getitem__
        for batch in batches:
            at = batch.schema.get_field_index("text")
            counts = [sum(map(size, split(text))) if text else 0 for text in (x.as_py() for x in batch.column(at))]
            kept = [(name, batch.column(k)) for k, name in enumerate(batch.schema.names) if k != at]
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), pa.array(counts, pa.int64())], names=[*(n for n, _ in kept), "n_tokens"])

    return run


def with_token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Replace the column `text` by n_tokens, the number of its ids (0 for null and empty texts)."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(_counter(share(docs, vocabulary)), f"{kept}, n_tokens bigint")
