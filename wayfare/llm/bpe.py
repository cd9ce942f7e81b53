"""Byte-pair encoding and decoding with forced-boundary splitting.

A merge always yields a token of the vocabulary.  So if two adjacent bytes occur side by side inside no token, no
merge can ever join them: the place between them is a certain cut.  Each piece of text that the pre-tokenizer
yields is split at its certain cuts, the fragments are encoded independently of each other, and the ids are
concatenated.  Fragments recur far more often than pieces, so a bounded memory of their ids does most of the work.
"""

from __future__ import annotations

import copy
import hashlib
import heapq
import json
import struct
from collections.abc import Callable

import numpy as np
import regex
from pyspark.sql import DataFrame

from wayfare.llm.common import map_texts

#: Fixed value: the public pattern of byte-level pre-tokenizers.
PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+""")


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabulary files, and its byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class BytePairs:
    """A byte-level BPE vocabulary: its merges, its certain cuts, encoding and decoding."""

    #: Pieces and fragments whose ids are remembered; beyond that the memory starts anew.
    MEMORY = 1 << 18
    #: Longer pieces are not remembered.
    LONGEST = 64

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = byte_letters()
        as_bytes = lambda s: bytes(letter[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.id_of = {as_bytes(s): i for s, i in vocab.items()}
        self.bytes_of = {i: b for b, i in self.id_of.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        #: The rank of each pair of ids that merges, and the id that the merge of each rank makes.
        self.rank_of = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(merges)}
        self.made_by = [vocab[a + b] for a, b in merges]
        self.byte_ids = [self.id_of.get(bytes([k]), -1) for k in range(256)]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        #: The byte pairs that occur inside tokens; between the bytes of any other pair is a certain cut.
        self.inside = {pair for token in self.id_of for pair in zip(token, token[1:], strict=False)}
        self._pieces: dict[str, bytes] = {}
        self._fragments: dict[bytes, bytes] = {}

    def afresh(self) -> BytePairs:
        """The same vocabulary with a memory of its own, still empty, which goes when this one does."""
        found = copy.copy(self)
        found._pieces, found._fragments = {}, {}
        return found

    def fragments(self, piece: bytes) -> list[bytes]:
        """A piece, split at its certain cuts."""
        inside, out, begin = self.inside, [], 0
        for k, pair in enumerate(zip(piece, piece[1:], strict=False), 1):
            if pair not in inside:
                out.append(piece[begin:k])
                begin = k
        out.append(piece[begin:])
        return out

    def _merged_short(self, fragment: bytes) -> list[int]:
        """As _merged, by looking at all pairs for each merge: faster for the usual few bytes."""
        rank_of, never = self.rank_of.get, len(self.made_by)
        ids = list(map(self.byte_ids.__getitem__, fragment))
        ranks = [rank_of(pair, never) for pair in zip(ids, ids[1:], strict=False)]
        while ranks and (least := min(ranks)) < never:
            k = ranks.index(least)
            ids[k : k + 2] = [self.made_by[least]]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = rank_of((ids[k], ids[k + 1]), never)
            if k:
                ranks[k - 1] = rank_of((ids[k - 1], ids[k]), never)
        return ids

    def _merged(self, fragment: bytes) -> list[int]:
        """Ids of a fragment by repeated merging of the pair of lowest rank, leftmost first."""
        ids = list(map(self.byte_ids.__getitem__, fragment))
        n, rank_of = len(ids), self.rank_of.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, k, ids[k], ids[k + 1]) for k in range(n - 1) if (rank := rank_of((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k, left, right = heapq.heappop(heap)
            nxt = after[k]
            if ids[k] != left or nxt >= n or ids[nxt] != right:
                continue
            ids[k], ids[nxt] = self.made_by[rank], -1
            after[k] = after[nxt]
            if after[k] < n:
                before[after[k]] = k
            for a, b in ((k, after[k]), (before[k], k)):
                if 0 <= a and b < n and (rank := rank_of((ids[a], ids[b]))) is not None:
                    heapq.heappush(heap, (rank, a, ids[a], ids[b]))
        return [i for i in ids if i >= 0]

    def _fragment_ids(self, fragment: bytes) -> bytes:
        if (found := self._fragments.get(fragment)) is None:
            merged = self._merged_short if len(fragment) <= self.LONGEST else self._merged
            found = struct.pack(f"<{len(ids := merged(fragment))}I", *ids)
            if len(fragment) <= self.LONGEST:
                if len(self._fragments) >= self.MEMORY:
                    self._fragments.clear()
                self._fragments[fragment] = found
        return found

    def _piece_ids(self, piece: str) -> bytes:
        found = b"".join(map(self._fragment_ids, self.fragments(piece.encode())))
        if len(piece) <= self.LONGEST:
            if len(self._pieces) >= self.MEMORY:
                self._pieces.clear()
            self._pieces[piece] = found
        return found

    def _plain_ids(self, text: str) -> bytes:
        known = self._pieces.get
        return b"".join([known(p) or self._piece_ids(p) for p in PIECES.findall(text)])

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers; special tokens in it have their own ids."""
        if self.at_special is None or not self.at_special.search(text):
            return self._plain_ids(text)
        out, at = [], 0
        for m in self.at_special.finditer(text):
            out += [self._plain_ids(text[at : m.start()]), self.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._plain_ids(text[at:])])

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


_loaded: dict[str, BytePairs] = {}


def load(path: str) -> BytePairs:
    """The vocabulary at path, read once in each process; its memory is the caller's, so an idle worker keeps none."""
    if path not in _loaded:
        _loaded[path] = BytePairs(path)
    return _loaded[path].afresh()


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: its id and ids, the token ids as array<int>.

    Null texts count as empty: no ids.  Whole texts of any length are encoded; repeated rows and null ids stay; an empty
    table gives no rows; other columns are not read.
    """

    def make() -> Callable[[bytes | None], tuple]:
        vocab = load(path)
        return lambda text: (np.frombuffer(vocab.encode((text or b"").decode()), dtype="<u4").astype(np.int32),)

    return map_texts(docs, [id_col], text_col, make, "ids array<int>")


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: its id, n_tokens, ids_sha256 and decoded_sha256.

    The ids are those of the vocabulary file at path, the decoded text is made from the ids alone.  Null texts
    count as empty; texts of any length are encoded whole; repeated rows and null ids stay; other columns of docs
    are not read.
    """

    def make() -> Callable[[bytes | None], tuple]:
        vocab = load(path)

        def of_text(text: bytes | None) -> tuple:
            ids = vocab.encode((text or b"").decode())
            decoded = vocab.decode(ids).encode()
            return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()

        return of_text

    return map_texts(docs, [id_col], text_col, make, "n_tokens long, ids_sha256 string, decoded_sha256 string")
