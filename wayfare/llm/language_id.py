"""Language identification, words first.

A model has, for each language, the frequencies of its words and of the character n-grams in them.  A word that the
model knows is scored by its log frequency in each language.  A word it doesn't know falls back to its character
n-grams, the longest first: the first length at which the model knows any n-gram of the word scores it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import bounded_sample, id_fold, map_texts, materialize

WORD = re.compile(r"[^\W\d_]+")
#: Lengths of n-grams, in the order in which they are tried.
LENGTHS = (5, 4, 3, 2, 1)
#: What is predicted for a text without letters.
UNKNOWN = "und"


def words_of(text: bytes | None) -> list[str]:
    """The runs of letters of a text, in lower case."""
    return WORD.findall((text or b"").decode().lower())


def has_letter(words: list[str]) -> bool:
    return any(c.isalpha() for w in words for c in w)


def grams_of(word: str, n: int) -> list[str]:
    """The n-grams of a word with its ends marked; of length 1, its letters."""
    if n == 1:
        return list(word)
    marked = f"<{word}>"
    return [marked[k : k + n] for k in range(len(marked) - n + 1)]


class Frequencies:
    """How often each word (or n-gram) was seen in each language, found by its hash.

    A word's entries, its languages and numbers, lie together, in order of hashes; what it lacks there counts as 0.
    """

    def __init__(self, hashes: np.ndarray, lang: np.ndarray, n: np.ndarray, langs: int, smoothing: float):
        order = np.lexsort((lang, hashes))
        self.hashes, self.begin = np.unique(hashes[order], return_index=True)
        self.begin = np.append(self.begin, len(order))
        self.lang, self.n, self.smoothing = lang[order].astype(np.uint16), n[order].astype(np.float64), smoothing
        total = np.bincount(self.lang, weights=self.n, minlength=langs) if len(order) else np.zeros(langs)
        self.whole = np.log(total + smoothing * (len(self.hashes) + 1))

    def logs(self, wanted: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Which of wanted were seen, as places in it, and their log frequencies by language."""
        if not len(self.hashes) or not wanted:
            return np.empty(0, dtype=np.int64), np.empty((0, len(self.whole)))
        h = np.fromiter(map(hash_of, wanted), dtype=np.uint64, count=len(wanted))
        at = np.searchsorted(self.hashes, h)
        known = np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] == h)
        # the entries of all that are known, one after the other
        begin, size = self.begin[at[known]], self.begin[at[known] + 1] - self.begin[at[known]]
        row = np.repeat(np.arange(len(known)), size)
        entry = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
        seen = np.full((len(known), len(self.whole)), self.smoothing)
        seen[row, self.lang[entry]] += self.n[entry]
        return known, np.log(seen) - self.whole


def hash_of(x: str) -> int:
    """The hash that Spark's xxhash64 gives for a string, without sign."""
    return xxhash.xxh64_intdigest(x.encode(), 42)


class LanguageModel:
    """Log frequencies of words and n-grams by language."""

    #: Words whose scores are remembered; beyond that the memory starts anew.
    MEMORY = 300_000

    def __init__(self, langs: list[str], tables: dict[int, Frequencies]):
        """tables: by kind, 0 for words, else an n-gram's length."""
        self.langs, self.tables = langs, tables
        self._begin()

    @classmethod
    def of_counts(cls, langs: list[str], counts: dict[int, dict[str, Counter]], smoothing: float = 0.5) -> LanguageModel:
        """A model of counts by kind and language."""
        langs, tables = sorted(langs), {}
        for kind, by_lang in counts.items():
            rows = [(hash_of(g), langs.index(x), n) for x, c in by_lang.items() for g, n in c.items()]
            columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
            tables[kind] = Frequencies(np.array(columns[0], dtype=np.uint64), np.array(columns[1], dtype=np.int64), np.array(columns[2], dtype=np.float64), len(langs), smoothing)
        return cls(langs, tables)

    def __getstate__(self) -> dict:
        return {"langs": self.langs, "tables": self.tables}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._begin()

    def _begin(self) -> None:
        self._index: dict[str, int] = {}
        self._rows = np.zeros((1024, max(1, len(self.langs))))

    def word_scores(self, words: list[str]) -> np.ndarray:
        """The log frequency of each word in each language; zeros where not even its letters are known.

        All words are looked up at once, then the n-grams of those that were not found, the longest first.
        """
        out = np.zeros((len(words), len(self.langs)))
        left = list(range(len(words)))
        for kind in (0, *LENGTHS):
            if not left or kind not in self.tables:
                continue
            grams = [[words[k]] if kind == 0 else grams_of(words[k], kind) for k in left]
            size = [len(g) for g in grams]
            known, found = self.tables[kind].logs([x for g in grams for x in g])
            of = np.repeat(np.arange(len(left)), size)[known]
            times = np.bincount(of, minlength=len(left))
            total = np.zeros((len(left), len(self.langs)))
            np.add.at(total, of, found)
            hit = times > 0
            out[np.array(left)[hit]] = total[hit] / times[hit, None]
            left = [k for k, h in zip(left, hit.tolist(), strict=True) if not h]
        return out

    def word_score(self, word: str) -> np.ndarray:
        return self.word_scores([word])[0]

    def rows_of(self, words: list[str]) -> np.ndarray:
        """The places of the words' scores in the memory; those that are not there yet are added, all at once."""
        new = list(dict.fromkeys(w for w in words if w not in self._index))
        if new:
            begin = len(self._index)
            if begin + len(new) > len(self._rows):
                self._rows = np.concatenate([self._rows, np.zeros((max(len(self._rows), len(new)), self._rows.shape[1]))])
            self._rows[begin : begin + len(new)] = self.word_scores(new)
            self._index.update(zip(new, range(begin, begin + len(new)), strict=True))
        return np.fromiter(map(self._index.__getitem__, words), dtype=np.int64, count=len(words))

    def predict(self, text: bytes | None) -> tuple[str, float]:
        """The language of greatest posterior, the first in order of ties, and the posterior."""
        words = words_of(text)
        if not self.langs or not has_letter(words):
            return UNKNOWN, 0.0
        if len(self._index) > self.MEMORY:
            self._begin()
        which, times = np.unique(self.rows_of(words), return_counts=True)
        total = times @ self._rows[which]
        odds = np.exp(total - total.max())
        best = int(np.argmax(total))
        return self.langs[best], float(odds[best] / odds.sum())


def train(docs: DataFrame, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5) -> LanguageModel:
    """A model of the labelled rows whose id's crc32 modulo 3 is not 1.

    Fitted on at most `sample` of those rows, those of the smallest id hashes; rows without id or language, and rows of
    an id that repeats, are not taken.  All words of the sample's whole texts and all their n-grams count; null and
    empty texts have none.  What reaches the driver and the tasks is a hash, a language and a number for each, and is
    bounded by the sample.  Without labelled rows every prediction is `und`; other columns are not read.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    chosen = bounded_sample(rows.filter(F.col("lang").isNotNull() & (id_fold(F.col("doc_id"), 3) != 1)), sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(words_of(text))
            flat = [(x, w, n) for x, c in found.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*flat, strict=True) if flat else ([], [], []), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "gram", "n"])

    counted = chosen.select("lang", F.col("text").cast("binary")).mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by_word = materialize(counted, "words")
    langs = sorted(r.lang for r in by_word.select("lang").distinct().collect())
    if not langs:
        return LanguageModel([], {})
    marked = F.concat(F.lit("<"), "gram", F.lit(">"))
    parts = by_word.select(F.lit(0).cast("byte").alias("kind"), "lang", "gram", "n")
    for length in LENGTHS:
        text = F.col("gram") if length == 1 else marked
        pieces = F.transform(F.sequence(F.lit(1), F.length(text) - length + 1), lambda k: F.substring(text, k, F.lit(length)))  # noqa: B023
        parts = parts.unionByName(by_word.filter(F.length(text) >= length).select(F.lit(length).cast("byte").alias("kind"), "lang", F.explode(pieces).alias("gram"), "n"))
    number = (F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) - 1).cast("int").alias("lang")
    summed = parts.groupBy("kind", F.xxhash64("gram").alias("h"), number).agg(F.sum("n").cast("double").alias("n"))
    table = summed.toArrow()
    kind, h, lang, n = (table[c].to_numpy() for c in ("kind", "h", "lang", "n"))
    tables = {k: Frequencies(h[kind == k].view(np.uint64), lang[kind == k], n[kind == k], len(langs), smoothing) for k in (0, *LENGTHS)}
    return LanguageModel(langs, tables)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: its id, held_out, lang_pred and score.

    held_out tells that the id's crc32 modulo 3 is 1.  lang_pred is a language of the model, or `und` with score 0
    where text is null or has no letter, or the model has no language; score is the posterior.  Whole texts of any
    length count; repeated rows and null ids stay; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[bytes | None], tuple]:
        return sent.value.predict

    found = map_texts(docs, [id_col], text_col, make, "lang_pred string, score double")
    return found.withColumn("held_out", F.coalesce(id_fold(F.col(f"`{id_col}`"), 3) == 1, F.lit(False))).select(id_col, "held_out", "lang_pred", "score")
