"""Toxicity by weak supervision.

Many weak voters look at a text: whether it has a word of a lexicon, a word that begins in a suspicious way, or a
pattern such as shouting.  Lexicon words and word beginnings are found in labelled texts.  A generative label model
treats the true class as hidden and the voters, with the label as one more of them, as its noisy signs; it estimates
by expectation maximisation how often each voter speaks in either class, and from what its votes share with other
voters' beyond the class how much of its evidence is its own.  The posterior classes are what a linear classifier is
trained on, and that classifier alone scores texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import batched, bounded_sample, id_fold, map_texts, materialize

WORD = re.compile(r"[^\W\d_]+")
#: Lengths of word beginnings that may become voters.
BEGINNINGS = range(4, 9)

#: Patterns that vote besides what is found in labelled texts, by name.
PATTERNS = {
    "shouting": r"\b[A-Z]{4,}\b(?:\W+\b[A-Z]{4,}\b){2}",
    "exclaiming": r"!{3,}",
    "symbols for letters": r"\b\w*[a-z][*#@$]{2,}[a-z]?\w*\b",
    "you are": r"\b[Yy]ou(?: are|'re) (?:a|an|such|so|nothing)\b",
    "go away": r"\b(?:[Ss]hut up|[Gg]et lost|[Gg]o away)\b",
    "stretched letters": r"([A-Za-z])\1{4,}",
}


def features_of(word: str) -> list[str]:
    """What a word may be known by: itself, and its beginnings followed by a star."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if n < len(word))]


def induce(sample: DataFrame, most: int, least: int) -> list[str]:
    """At most `most` lexicon words and beginnings that tell toxic from other texts of sample (text, toxic).

    Each occurs in `least` toxic texts at least and is five times likelier there than elsewhere; the best by
    the likelihood ratio statistic stay.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set(WORD.findall((text or b"").decode().lower()))
                total[toxic].update({f for w in words for f in features_of(w)})
        flat = [(f, total[0][f], n) for f, n in total[1].items()] + [(f, n, 0) for f, n in total[0].items() if f not in total[1]]
        columns = zip(*flat, strict=True) if flat else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["f", "n0", "n1"])

    size = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = float(size.get(0, 0)), float(size.get(1, 0))
    if not n0 or not n1:
        return []
    counted = batched(sample.select(F.col("text").cast("binary"), "toxic")).mapInArrow(count, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    p0, p1, p = (F.col("n0") + 0.5) / (n0 + 1), (F.col("n1") + 0.5) / (n1 + 1), (F.col("n0") + F.col("n1")) / (n0 + n1)
    gain = 2 * (F.col("n1") * F.log(p1 / p) + F.col("n0") * F.log(p0 / p))
    best = counted.filter((F.col("n1") >= least) & (p1 > 5 * p0)).orderBy(F.desc(gain), "f").limit(most)
    return [r.f for r in best.collect()]


class Voters:
    """Votes of lexicon words, beginnings and patterns on texts, and the features of the linear classifier."""

    MEMORY = 1 << 16

    def __init__(self, lexicon: list[str]):
        self.lexicon = lexicon
        self.number = {f: k for k, f in enumerate(lexicon)}
        self.patterns = [re.compile(p) for p in PATTERNS.values()]
        self.n_votes = len(lexicon) + len(self.patterns)
        self._known: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}}

    def _of_word(self, word: str) -> tuple[int, ...]:
        found = tuple(self.number[f] for f in features_of(word) if f in self.number)
        if len(self._known) >= self.MEMORY:
            self._known.clear()
        self._known[word] = found
        return found

    def features(self, text: bytes | None) -> np.ndarray:
        """One number for each voter, 1 where it votes toxic; then how dense the words that any of them knows are."""
        string = (text or b"").decode()
        words = WORD.findall(string.lower())
        out = np.zeros(self.n_votes + 2)
        known = self._known.get
        hits = 0
        for w in words:
            own = known(w)
            if own is None:
                own = self._of_word(w)
            if own:
                hits += 1
                out[list(own)] = 1
        for k, pattern in enumerate(self.patterns, len(self.lexicon)):
            out[k] = pattern.search(string) is not None
        out[-2] = math.log1p(hits)
        out[-1] = hits / (len(words) + 20.0)
        return out


def label_posteriors(votes: np.ndarray, labels: np.ndarray, rounds: int = 200, noise: float = 0.05, trust: float = 50.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The generative label model: posterior of the toxic class for each row, accuracies, shares of own evidence, class share.

    votes is 0 or 1 by row and voter, labels 0 or 1 by row; the label is one voter more.  Expectation maximisation
    estimates how often each voter, and the label, votes toxic in the clean and in the toxic class (the accuracies), and
    how many rows are toxic.  What the voters' votes have in common within the classes is their correlation; where it is
    positive, and more than three standard errors of none, a voter's own share of its evidence is 1 over 1 plus the sum
    of its correlations.  The label's own share is 1.

    So that the hidden classes stay the clean and the toxic one with few rows, the label's accuracy has a prior: what
    `noise`, a share of wrong labels, lets expect of `trust` rows of each class.  With many rows the data outweigh it.
    """
    seen = np.column_stack([votes, labels]).astype(np.float64)
    chance = 3 / math.sqrt(max(1, len(labels)))
    post = np.where(labels > 0, 1 - noise, noise)
    own, rate, share = np.ones(seen.shape[1]), np.full((2, seen.shape[1]), 0.5), 0.5
    for _ in range(rounds):
        weight = np.stack([1 - post, post])
        size = weight.sum(axis=1, keepdims=True)
        share = float((size[1, 0] + 0.5) / (size.sum() + 1.0))
        rate = (weight @ seen + 0.5) / (size + 1.0)
        # clean rows are labelled wrongly as often as toxic ones, in numbers
        expected = np.array([min(noise, noise * share / (1 - share)), 1 - noise])
        rate[:, -1] = (weight @ seen[:, -1] + trust * expected) / (size[:, 0] + trust)
        # the covariance that is left when the classes' means are taken off
        within = (seen.T @ seen) - (rate * size).T @ rate
        scale = np.sqrt(np.maximum(np.diag(within), 1e-9))
        correlation = np.minimum(within / np.outer(scale, scale), 1.0)
        correlation[correlation < chance] = 0.0
        np.fill_diagonal(correlation, 0.0)
        correlation[-1] = correlation[:, -1] = 0.0
        own = 1.0 / (1.0 + correlation.sum(axis=1))
        spoken, silent = own * np.log(rate[1] / rate[0]), own * np.log((1 - rate[1]) / (1 - rate[0]))
        logit = np.clip(math.log(share / (1 - share)) + seen @ (spoken - silent) + silent.sum(), -30, 30)
        new = np.clip(1 / (1 + np.exp(-logit)), 1e-6, 1 - 1e-6)
        moved, post = np.abs(new - post).max(), new
        if moved < 1e-6:
            break
    return post, rate, own, share


def fit_linear(x: np.ndarray, target: np.ndarray, penalty: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Logistic regression on soft targets by Newton's method; the constant comes last and is not penalised."""
    x = np.column_stack([x, np.ones(len(x))])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    weights = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (target - p) - ridge * weights
        curve = p * (1 - p) + 1e-9
        # a slice of rows at a time, so no second copy of x is made
        hessian = sum((x[k : k + 1024].T * curve[k : k + 1024]) @ x[k : k + 1024] for k in range(0, len(x), 1024))
        step = np.linalg.solve(hessian + np.diag(ridge), slope)
        weights += step
        if np.abs(step).max() < 1e-6:
            break
    return weights


@dataclass
class ToxicityModel:
    voters: Voters
    weights: np.ndarray

    def score(self, text: bytes | None) -> tuple[float, int]:
        z = float(self.voters.features(text) @ self.weights[:-1] + self.weights[-1])
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        return p, int(p >= 0.5)


def one_text(rows: DataFrame) -> DataFrame:
    """One row (doc_id, text, toxic) for each doc_id of rows: its text of the smallest hash.

    Each task keeps one text of an id before anything is moved, however often the id repeats.
    """
    least = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least")
    return rows.groupBy("doc_id", "toxic").agg(least).select("doc_id", "least.text", "toxic")


def train(
    docs: DataFrame, labels: DataFrame, sample: int = 20_000, voters: int = 200, least: int = 3,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> ToxicityModel:
    """A model of the labelled rows whose id's crc32 modulo 5 is not 0.

    Fitted on at most `sample` of those rows, those of the smallest id hashes; their features, bounded by sample
    times voters, are what reaches the driver.  Rows whose label is null are left out; of several labels of an id
    the greatest counts, of several texts the one of the smallest hash.  Null and empty texts are texts without votes;
    texts are read whole.  Without labelled rows of both classes every text scores about 0.  Other columns are not read.
    """
    key = F.col(f"`{id_col}`")
    own = labels.filter(F.col(label_col).isNotNull() & (id_fold(key, 5) != 0)).groupBy(key.alias("doc_id")).agg((F.max(label_col) > 0).cast("int").alias("toxic"))
    chosen = bounded_sample(own, sample)
    texts = docs.select(key.alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = materialize(one_text(texts.join(F.broadcast(chosen), "doc_id")), "labelled")
    model = Voters(induce(rows, voters, least))
    if not model.lexicon:
        return ToxicityModel(model, np.concatenate([np.zeros(model.n_votes + 2), [-30.0]]))
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[bytes | None], tuple]:
        def of_text(text: bytes | None) -> tuple:
            found = sent.value.features(text)
            return found[: model.n_votes].astype(np.uint8).tobytes(), found[model.n_votes :].tolist()

        return of_text

    # a vote is a byte, on its way and in the label model
    found = map_texts(rows, ["doc_id", "toxic"], "text", make, "votes binary, dense array<double>").orderBy("doc_id").drop("doc_id").toArrow()
    votes = np.frombuffer(b"".join(found["votes"].to_pylist()), dtype=np.uint8).reshape(-1, model.n_votes)
    dense = found["dense"].combine_chunks().flatten().to_numpy().reshape(len(votes), -1)
    post, *_ = label_posteriors(votes, found["toxic"].to_numpy())
    return ToxicityModel(model, fit_linear(np.column_stack([votes, dense]), post))


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: its id, held_out, score and predicted.

    held_out tells that the id's crc32 modulo 5 is 0; score is between 0 and 1, predicted is 1 from 0.5 on.  Null
    texts count as empty; empty texts are scored as texts without votes; whole texts of any length count; repeated
    rows and null ids stay; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[bytes | None], tuple]:
        return sent.value.score

    found = map_texts(docs, [id_col], text_col, make, "score double, predicted int")
    return found.withColumn("held_out", F.coalesce(id_fold(F.col(f"`{id_col}`"), 5) == 0, F.lit(False))).select(id_col, "held_out", "score", "predicted")


def keep_clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows of docs that the model does not call toxic, all columns, whatever they are called.

    Null and empty texts are scored as texts without votes; whole texts of any length count; repeated rows and rows
    without id are judged each for itself; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = sent.value.score
            yield batch.filter(pa.array([not score(t.encode() if t is not None else None)[1] for t in batch.column(place).to_pylist()], type=pa.bool_()))

    return batched(docs).mapInArrow(keep, docs.schema)
