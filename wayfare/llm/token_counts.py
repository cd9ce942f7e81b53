"""Token counts by a linear longest-match automaton.

Greedy word-piece splitting takes, again and again, the longest token that a word's rest begins with.  The automaton
counts those pieces in one pass over the word: it walks a trie of the vocabulary, and where the trie has no edge it
pops whole tokens off the matched prefix and follows a failure link to the node of what remains.  How many tokens a
link pops is worked out beforehand, so no piece is ever built.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

from wayfare.llm.bpe import byte_letters
from wayfare.llm.common import map_texts

#: A node that has no failure link: what it stands for cannot be split into tokens.
NONE = -1


class LongestMatch:
    """A trie of byte tokens with failure links and counts of popped tokens."""

    def __init__(self, tokens: Iterable[bytes]):
        self.edges: list[dict[int, int]] = [{}]
        is_token = [False]
        for token in tokens:
            at = 0
            for byte in token:
                nxt = self.edges[at].get(byte)
                if nxt is None:
                    nxt = self.edges[at][byte] = len(self.edges)
                    self.edges.append({})
                    is_token.append(False)
                at = nxt
            is_token[at] = at > 0
        #: Where a node's failure link leads, and how many tokens following it pops.
        self.link, self.pops = [NONE] * len(self.edges), [0] * len(self.edges)
        todo = deque([0])
        while todo:
            parent = todo.popleft()
            for byte, node in self.edges[parent].items():
                todo.append(node)
                if is_token[node]:
                    self.link[node], self.pops[node] = 0, 1
                    continue
                at, popped = self.link[parent], self.pops[parent]
                while at != NONE and byte not in self.edges[at]:
                    at, popped = self.link[at], popped + self.pops[at]
                if at != NONE:
                    self.link[node], self.pops[node] = self.edges[at][byte], popped

    def count(self, word: bytes) -> int:
        """The number of greedy pieces of word; 1 (one unknown token) if it cannot be split into tokens."""
        edges, link, pops = self.edges, self.link, self.pops
        at = n = 0
        for byte in word:
            while (nxt := edges[at].get(byte)) is None:
                n += pops[at]
                at = link[at]
                if at == NONE:
                    return 1
            at = nxt
        while at:
            n += pops[at]
            at = link[at]
            if at == NONE:
                return 1
        return n


class Counted(dict):
    """The piece counts of words met so far, begun anew when there are too many."""

    MOST = 400_000

    def __init__(self, automaton: LongestMatch):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        found = self[word] = self.automaton.count(b" " + word)
        return found


def byte_tokens(path: str) -> list[bytes]:
    """The tokens of a byte-level vocabulary file as bytes, without its special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letter, special = byte_letters(), {t["content"] for t in spec.get("added_tokens", [])}
    return [bytes(letter[c] for c in s) for s in spec["model"]["vocab"] if s not in special]


_loaded: dict[str, Counted] = {}


def load(path: str) -> Counted:
    """The counter of the vocabulary at path, made once in each process."""
    if path not in _loaded:
        _loaded[path] = Counted(LongestMatch(byte_tokens(path)))
    return _loaded[path]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: its id, n_words and n_tokens.

    Words are the runs of bytes other than ASCII white space; each is split greedily with one space before it, as
    a vocabulary marks the begin of a word so.  Null and empty texts have no words and no tokens; texts of any
    length are counted whole; repeated rows and null ids stay; other columns of docs are not read.
    """

    def make() -> Callable[[bytes | None], tuple]:
        counted = load(path)

        def of_text(text: bytes | None) -> tuple:
            words = (text or b"").split()
            return len(words), sum(map(counted.__getitem__, words))

        return of_text

    return map_texts(docs, [id_col], text_col, make, "n_words long, n_tokens long")
