"""Token ids of every text by a public byte-level BPE vocabulary.

Speculate and verify: each distinct word is cut greedily into longest vocabulary entries; every adjacent pair of the
proposal is then tested (a sequence is the BPE encoding when each of its adjacent pairs encodes to itself); only words
with a failing pair are merged exactly, by rank. Pairs are tested together per batch, each distinct pair once.

Defined cases: null and empty texts have no ids (an empty list, 0 tokens); blank texts have the ids of their blanks;
special-token strings in a text are ordinary text; very long words are merged in n log n; repeated rows are encoded
each; other columns are not read.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table

#: Where the vocabulary files lie; a parameter, never copied into the repository.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct words kept by a worker; beyond it the memory is emptied and filled anew, with the same results.
MEMORY_WORDS = 400_000
#: Words longer than this are encoded but not remembered.
MEMORY_LENGTH = 64


class WordEncoder:
    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.spelling = {rank: token for token, rank in self.ranks.items()}
        self.longest: dict[bytes, int] = {}
        for token in self.ranks:
            self.longest[token[:2]] = max(len(token), self.longest.get(token[:2], 1))
        self.width = max(self.spelling) + 1
        self.compatible: dict[int, bool] = {}
        self.memory: dict[str, tuple[int, ...]] = {}
        self.find = regex.compile(PATTERN).findall

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match from the left."""
        out, at, end, ranks, longest = [], 0, len(word), self.ranks, self.longest
        while at < end:
            for size in range(min(longest.get(word[at : at + 2], 1), end - at), 0, -1):
                rank = ranks.get(word[at : at + size])
                if rank is not None:
                    break
            out.append(rank)
            at += size
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the pair of lowest rank first, leftmost first among equals."""
        ranks, size = self.ranks, len(word)
        if size < 2:
            return [ranks[word]] if size else []
        after, before, ends = list(range(1, size + 1)), list(range(-1, size - 1)), list(range(1, size + 1))
        heap = [(rank, i, i + 2) for i in range(size - 1) if (rank := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * size
        while heap:
            _, left, stop = heapq.heappop(heap)
            right = after[left] if alive[left] else size
            if right >= size or ends[right] != stop:
                continue
            alive[right], ends[left], after[left] = False, stop, after[right]
            if after[left] < size:
                before[after[left]] = left
                rank = ranks.get(word[left : ends[after[left]]])
                if rank is not None:
                    heapq.heappush(heap, (rank, left, ends[after[left]]))
            if before[left] >= 0:
                rank = ranks.get(word[before[left] : stop])
                if rank is not None:
                    heapq.heappush(heap, (rank, before[left], stop))
        out, at = [], 0
        while at < size:
            out.append(ranks[word[at : ends[at]]])
            at = after[at]
        return out

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        proposals = [(rank,) if (rank := self.ranks.get(b)) is not None else tuple(self.propose(b)) for b in raw]
        counts = np.fromiter((len(p) - 1 for p in proposals), np.int64, len(proposals))
        if counts.any():
            flat = np.fromiter(chain.from_iterable(proposals), np.int64, int(counts.sum()) + len(proposals))
            starts = np.concatenate(([0], np.cumsum(counts + 1)[:-1]))
            inner = np.ones(len(flat), bool)
            inner[starts] = False
            inner = inner[1:]
            pairs = (flat[:-1] * self.width + flat[1:])[inner]
            distinct, where = np.unique(pairs, return_inverse=True)
            good = np.fromiter((self._pair(int(p)) for p in distinct), bool, len(distinct))[where]
            owner = np.repeat(np.arange(len(proposals)), counts)
            for k in np.unique(owner[~good]):
                proposals[k] = tuple(self.merge(raw[k]))
        return proposals

    def _pair(self, code: int) -> bool:
        known = self.compatible.get(code)
        if known is None:
            left, right = divmod(code, self.width)
            known = self.compatible[code] = self.merge(self.spelling[left] + self.spelling[right]) == [left, right]
        return known

    def encode_texts(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.find(t) if t else () for t in texts]
        memory = self.memory
        if len(memory) > MEMORY_WORDS:
            memory.clear()
        if len(self.compatible) > 4 * MEMORY_WORDS:
            self.compatible.clear()
        fresh = list(set(chain.from_iterable(split)).difference(memory))
        long = {}
        for word, ids in zip(fresh, self.encode_words(fresh) if fresh else ()):
            (memory if len(word) <= MEMORY_LENGTH else long)[word] = ids
        look = (lambda w: memory[w] if w in memory else long[w]) if long else memory.__getitem__
        return [list(chain.from_iterable(map(look, words))) for words in split]


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


#: Characters of text encoded at a time by a worker, so that memory does not grow with the size of a batch.
SLICE_CHARS = 1_000_000


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for at, text in enumerate(texts):
        size += len(text) if text else 0
        if size >= SLICE_CHARS:
            yield start, at + 1
            start, size = at + 1, 0
    if start < len(texts) or not texts:
        yield start, len(texts)


def encode(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids): the token ids of each text, without special tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, end in _slices(texts):
                ids = coder.encode_texts(texts[start:end])
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), pa.ListArray.from_arrays(offsets, flat)], names=[id_column, "ids"])

    kind = documents.schema[id_column].dataType.simpleString()
    return documents.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")


def token_counts(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, n_tokens): the number of tokens of each text; 0 for null and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts = [len(x) for start, end in _slices(texts) for x in coder.encode_texts(texts[start:end])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=[id_column, "n_tokens"])

    kind = documents.schema[id_column].dataType.simpleString()
    return documents.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, n_tokens long")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode(table(spark, folder, "documents"))
