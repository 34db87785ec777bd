"""Counts of greedy word pieces by a linear longest-match automaton."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rankweave.llm.rows import named, packed, unpacked
from rankweave.llm.scratch import received, send
from rankweave.llm.words import NOT_SPACE, split_words

#: Counts of so many words are kept by a task.
CACHE_WORDS = 500_000
#: Longer words are counted each time.
CACHE_BYTES = 64


def byte_level_pieces(path: str) -> tuple[set[bytes], set[bytes]]:
    """Pieces of a byte-level vocabulary file: those that begin a word, and those that go on.

    A piece with a leading space begins a word, others go on; any single byte may begin one.
    """
    with open(path, encoding="utf-8") as f:
        names = json.load(f)["model"]["vocab"]
    # bytes stand for themselves where they are printable, others for characters from 256 on, in order
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    first, later = {bytes([b]) for b in range(256)}, set()
    for name in names:
        if all(c in back for c in name):
            piece = bytes(back[c] for c in name)
            if piece.startswith(b" ") and piece.strip():
                first.add(piece[1:])
            else:
                later.add(piece)
    return first, later


class Automaton:
    """Trie of word-beginning and of later pieces, with failure links.

    ``edges`` maps node * 256 + byte to a node; node 0 begins a word, node 1 goes
    on after a piece.  Where no edge fits, ``fail`` leads to the node for what
    is left when the longest pieces are taken off, and ``popped`` is their
    number; -1 where no pieces do.  So a word takes linear time.
    """

    def __init__(self, first: Iterable[bytes], later: Iterable[bytes]):
        self.edges: dict[int, int] = {}
        ends: set[int] = set()
        size = 2
        for root, pieces in ((0, first), (1, later)):
            for piece in pieces:
                node = root
                for b in piece:
                    key = node * 256 + b
                    if key not in self.edges:
                        self.edges[key] = size
                        size += 1
                    node = self.edges[key]
                if piece:
                    ends.add(node)
        self.fail, self.popped = [-1] * size, [0] * size
        children: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        for key, node in self.edges.items():
            children[key // 256].append((key % 256, node))
        todo = deque((root, b, node) for root in (0, 1) for b, node in children[root])
        while todo:
            parent, b, node = todo.popleft()
            if node in ends:
                self.fail[node], self.popped[node] = 1, 1
            else:
                z, n = self.fail[parent], self.popped[parent]
                while z >= 0 and z * 256 + b not in self.edges:
                    n += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[node], self.popped[node] = self.edges[z * 256 + b], n
            todo.extend((node, c, x) for c, x in children[node])

    def count(self, word: bytes) -> int:
        """Pieces of a word; 1 (unknown) if no pieces spell it, 0 for an empty one."""
        edges, fail, popped = self.edges, self.fail, self.popped
        node, n = 0, 0
        for b in word:
            while (key := node * 256 + b) not in edges:
                n += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = edges[key]
        while node > 1:
            n += popped[node]
            node = fail[node]
            if node < 0:
                return 1
        return n


def _counter(sent):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = received(sent)
        cache: dict[bytes, int] = {}
        for batch in batches:
            words_of, tokens_of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, words in split_words(batch["text"], NOT_SPACE, lower=False):
                names, which = words.distinct()
                if len(cache) > CACHE_WORDS:
                    cache.clear()
                known = [cache.get(w) for w in names]
                for i, n in enumerate(known):
                    if n is None:
                        known[i] = n = automaton.count(names[i])
                        if len(names[i]) <= CACHE_BYTES:
                            cache[names[i]] = n
                sums = np.concatenate([[0], np.cumsum(np.array(known, np.int64)[which])])
                tokens_of.append(sums[words.first[1:]] - sums[words.first[:-1]])
                words_of.append(np.diff(words.first))
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(np.concatenate(words_of)), pa.array(np.concatenate(tokens_of))], names=["row", "n_words", "n_tokens"])

    return count


def count_tokens(docs: DataFrame, first: set[bytes], later: set[bytes], text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Add ``n_words`` and ``n_tokens`` to the columns ``carry`` of ``docs`` (all by default; equal names, in any case, are replaced).

    A word is a run of anything but ASCII white space; its pieces are the
    greedy ones: the longest of ``first`` that begins it, then again and again
    the longest of ``later``.  A word that cannot be spelled is one unknown
    token.  A null or empty text has no words and no tokens.  The automaton is
    sent to every executor; the caller holds the vocabulary in memory, so it
    fits there too.
    """
    sent = send(docs.sparkSession, Automaton(sorted(first), sorted(later)))
    work = docs.select(packed(docs, ("n_words", "n_tokens"), carry).alias("row"), named(text_col).alias("text"))
    shape = T.StructType([work.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])
    out = work.mapInArrow(_counter(sent), shape)
    return out.select(*unpacked(out), "n_words", "n_tokens")
