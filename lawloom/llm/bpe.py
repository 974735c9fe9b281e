"""Byte-pair encoding by a tokenization automaton.

The automaton reads tokens and accepts exactly the token sequences that the merges give for some text. It starts from one
state with an arc for every byte. A merge (u, v) -> w adds its gadget: wherever u leads to a state q that has an arc v,
an arc w is laid past both, and u is redirected to a copy of q without v, so that u followed by v is no longer read. As
all arcs of one label lead to one state, the state after a token y is named y, and the finished automaton is the
relation "x may follow y". Whether that arc exists is found by playing the gadgets of y and x backwards: every step
replaces the younger of the two by the part of it that touches the other, so it takes at most as many steps as y and x
have merge levels. Laid out in full there would be 50,000 x 50,000 arcs; they're compiled the first time that a
word asks for them, and kept in the transition table of the worker.

Since the sequence for a text extends the sequences for its beginnings, one pass over a word suffices: at every byte
position exactly one token ends that may follow the token at its own beginning. Time is linear in the word, however long.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Iterable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lawloom.plans import spread_out

# Fixed value: the public pattern that splits a text before the merges of byte-level vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words and arcs that a worker keeps; beyond it the tables start anew. It bounds memory and changes no result.
TABLE = 400_000


def _byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in byte-level vocabulary files."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Merges:
    """What a vocabulary file says, in arrays small enough to send to every worker (under 1 MB for 50,000 merges)."""

    def __init__(self, pairs: np.ndarray, ids: np.ndarray) -> None:
        self.pairs, self.ids = pairs, ids  # by token in order of creation: 256 bytes, then one for each merge

    @classmethod
    def read(cls, path: str) -> Merges:
        """From a byte-level BPE file in the JSON format of the tokenizers library."""
        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        letters, vocabulary = _byte_letters(), model["vocab"]
        place = dict(letters)
        ids = [0] * 256
        for letter, byte in letters.items():
            ids[byte] = vocabulary[letter]
        pairs = []
        for pair in model["merges"]:
            u, v = pair.split(" ") if isinstance(pair, str) else pair
            if u + v in place:
                raise ValueError(f"two merges make {u + v!r}; such vocabularies aren't supported")
            place[u + v] = 256 + len(pairs)
            pairs.append((place[u], place[v]))
            ids.append(vocabulary[u + v])
        return cls(np.array(pairs, np.int32).reshape(-1, 2), np.array(ids, np.int32))


class Automaton:
    """The compiled automaton; encode() reads one word, decode() emits the labels of arcs."""

    def __init__(self, merges: Merges) -> None:
        n = 256 + len(merges.pairs)
        self.ids = merges.ids.tolist()
        self.left = [-1] * 256 + merges.pairs[:, 0].tolist()
        self.right = [-1] * 256 + merges.pairs[:, 1].tolist()
        self.gadget = {(u, v): k for k, (u, v) in enumerate(merges.pairs.tolist(), 256)}
        self.label = [bytes([b]) for b in range(256)]
        for k in range(256, n):
            self.label.append(self.label[self.left[k]] + self.label[self.right[k]])
        live = [True] * n
        for k in range(256, n):  # a merge whose two parts can't meet makes a token that no text has
            u, v = self.left[k], self.right[k]
            live[k] = live[u] and live[v] and self._arc(u, v, k - 1)
        self.token = {self.label[k]: k for k in range(n) if live[k]}
        self.longest = max(map(len, self.token))
        self.starts = {label[:size] for label in self.token for size in range(1, len(label))}  # inner nodes of the trie of labels
        self.of_id = {i: self.label[k] for k, i in enumerate(self.ids)}
        self.arcs: dict[tuple[int, int], bool] = {}

    def _arc(self, y: int, x: int, made: int) -> bool:
        """Whether x may follow y once all tokens up to number made exist."""
        while True:
            if self.gadget.get((y, x), made + 1) <= made:
                return False
            if x == y:
                if y < 256:
                    return True
                made, y, x = y - 1, self.right[y], self.left[x]
            elif x > y:
                if x < 256:
                    return True
                made, x = x, self.left[x]  # x was laid past its left part, after that part's own redirection
            else:
                if y < 256:
                    return True
                made, y = y - 1, self.right[y]  # y led where its right part led

    def encode(self, word: bytes) -> tuple[int, ...]:
        if (whole := self.token.get(word)) is not None:
            return (self.ids[whole],)
        size, token, starts, arcs = len(word), self.token, self.starts, self.arcs
        if len(arcs) > TABLE:
            arcs.clear()
        last, came, final = [-1] * (size + 1), [0] * (size + 1), len(self.ids)
        for begin in range(size):
            before = last[begin]
            for end in range(begin + 1, min(size, begin + self.longest) + 1):
                piece = word[begin:end]
                if last[end] < 0 and (x := token.get(piece)) is not None:
                    if before < 0:
                        fits = True
                    elif (fits := arcs.get((before, x))) is None:
                        fits = arcs[before, x] = self._arc(before, x, final)
                    if fits:
                        last[end], came[end] = x, begin
                if piece not in starts:
                    break
        out, end = [], size
        while end:
            out.append(self.ids[last[end]])
            end = came[end]
        return tuple(reversed(out))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(self.of_id[i] for i in ids)


class _Words(dict):
    """Ids by word; a word that's missing is encoded."""

    def __init__(self, automaton: Automaton) -> None:
        self.automaton = automaton

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.automaton.encode(word.encode("utf-8"))
        if len(word) <= 64:
            self[word] = ids
        return ids


_LOCK = threading.Lock()
_COMPILED: dict[int, _Words] = {}


def _words(merges: Merges, key: int) -> _Words:
    with _LOCK:
        if key not in _COMPILED:
            _COMPILED.clear()
            _COMPILED[key] = _Words(Automaton(merges))
    return _COMPILED[key]


def encode_texts(texts: Iterable[str | None], words: _Words, find) -> pa.ListArray:
    offsets, parts = [0], []
    for text in texts:
        ids = np.fromiter(chain.from_iterable(map(words.__getitem__, find(text))) if text else (), np.int32)
        parts.append(ids)
        offsets.append(offsets[-1] + len(ids))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(parts) if parts else np.array([], np.int32)))


def encode_corpus(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every document, without special tokens.

    Null and empty texts have an empty list of ids; blanks are text. The strings of special tokens are ordinary text.
    Rows are kept as they are, repeats and null keys too; other columns, whatever their names, aren't read. There is no
    shuffle, unless the scan has fewer partitions than the cluster has cores: the text column streams through workers that share nothing but the vocabulary.
    """
    spark: SparkSession = documents.sparkSession
    shared = spark.sparkContext.broadcast(Merges.read(path))
    split, token = SPLIT, hash((path, Path(path).stat().st_mtime_ns))
    narrow = documents.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, find = _words(shared.value, token), regex.compile(split).findall
        for batch in batches:
            if len(words) > TABLE:
                words.clear()
            ids = encode_texts(batch.column(1).to_pylist(), words, find)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["k", "ids"])

    schema = T.StructType([T.StructField("k", narrow.schema["k"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return spread_out(narrow).mapInArrow(run, schema).withColumnRenamed("k", key)
