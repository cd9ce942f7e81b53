"""Collocations: phrases whose words occur together more often than apart, mined by pivot partitioning.

1.  Words are counted by language.  A table of fixed size adds up the counts of the words whose hashes share a cell, so
    it bounds every word's frequency from above; it orders all words by rarity, ties by their hashes, and is small
    enough to be broadcast, however many words there are.
2.  An n-gram's pivot is its rarest word, the leftmost if it occurs again.  Each occurrence of a word is rewritten to
    the fragment around it in which it is the pivot: at most `longest` - 1 words on either side, cut at the ends of the
    piece, at words that are too rare for any frequent phrase, at rarer words, and on the left at the same word.
    Fragments go to their pivot; equal ones are counted before they are sent.
3.  Each pivot's fragments are mined by themselves, and only n-grams over the pivot are counted, so each occurrence of
    an n-gram is counted once, and in one place.  A pivot that may have more than MOST occurrences is split, and its
    n-grams' counts are added up afterwards.
4.  Frequent n-grams are scored by joins with their parts, which are frequent too.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfare.llm.common import materialize

#: Words of a phrase at most, and how often it must occur.
LONGEST, LEAST = 4, 30
#: Phrases of each language, and the score's factor.
TOP, FACTOR = 2000, 2_000_000
#: A phrase goes if a longer one holds it and has so many percent of its occurrences.
PERCENT = 80
#: Cells of the table of word frequencies.
CELLS = 1 << 20
#: Occurrences that a pivot's group has about, at most.
MOST = 200_000
#: Different words or fragments that a task holds before it passes them on.
HELD = 400_000
#: Shares of a language that are ranked by themselves first.
SHARES = 64
#: Fragments that are mined together, at least.
TOGETHER = 1 << 16

#: These bytes end a piece; the others of white space that end a word.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b"\t "
_TABLE = bytes.maketrans(ENDS + BLANKS, b"\n" * len(ENDS) + b" " * len(BLANKS))


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a text; between pieces stands a line feed, which no word has; empty strings do not count."""
    return (text or b"").lower().translate(_TABLE).replace(b"\n", b" \n ").split(b" ")


class WordHashes(dict):
    """64-bit hashes of one language's words; the empty one and the line feed are 0."""

    MOST = 300_000

    def __init__(self, lang: str):
        super().__init__()
        self.seed = xxhash.xxh64_intdigest(lang.encode())

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        found = self[word] = 0 if word in (b"", b"\n") else xxhash.xxh64_intdigest(word, self.seed) | 1
        return found


class ByLang(dict):
    """WordHashes by language; begun anew where there are very many."""

    def __missing__(self, lang: str) -> WordHashes:
        if len(self) >= 64:
            self.clear()
        found = self[lang] = WordHashes(lang)
        return found


def cell_of(h: np.ndarray, cells: int) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) % cells


def _texts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, word, h (its hash) and n of texts (lang, text): how often each word occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, many = ByLang(), {}, 0

        def passed_on() -> Iterator[pa.RecordBatch]:
            for lang, counter in held.items():
                for nothing in (b"", b"\n"):
                    counter.pop(nothing, None)
                h = np.fromiter(map(hashes[lang].__getitem__, counter), dtype=np.uint64, count=len(counter))
                columns = [pa.array([lang] * len(counter), pa.string()), pa.array(list(counter), pa.binary()), pa.array(h.view(np.int64)), pa.array(list(counter.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "h", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counter = held.setdefault(lang, Counter())
                many -= len(counter)
                counter.update(words_of(text.as_py()))
                many += len(counter)
                if many >= HELD:
                    yield from passed_on()
                    many = 0
        yield from passed_on()

    found = texts.mapInArrow(run, "lang string, word binary, h long, n long")
    return found.groupBy("lang", "word", "h").agg(F.sum("n").alias("n"))


def rarity(words: DataFrame, least: int) -> Broadcast:
    """The table of word frequencies: each cell's sum of n over words (h, n); sums below least are 0.  Its size is fixed."""
    cell = F.shiftrightunsigned("h", 40) % CELLS
    sums = words.groupBy(cell.alias("cell")).agg(F.sum("n").alias("n")).filter(F.col("n") >= least).toArrow()
    table = np.zeros(CELLS, dtype=np.int64)
    table[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    return words.sparkSession.sparkContext.broadcast(table)


def spans(order: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of positions whose order is above 0 (lower is rarer): where they are, and begin and end of the fragment of each.

    A fragment goes on to the right over words that are not rarer, to the left over words that are less rare.
    """
    n = len(order)
    padded = np.concatenate([np.zeros(longest, order.dtype), order, np.zeros(longest, order.dtype)])
    own = padded[longest : longest + n]
    left, right = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    go_left = go_right = own > 0
    for k in range(1, longest):
        go_left = go_left & (padded[longest - k : longest - k + n] > own)
        go_right = go_right & (padded[longest + k : longest + k + n] >= own)
        left += go_left
        right += go_right
    at = np.flatnonzero((own > 0) & (left + right > 0))
    return at, at - left[at], at + right[at] + 1


#: What stands before a fragment's words: where its pivot is among them.
_AT = [b"%d " % k for k in range(10)]


def add_fragments(held: Counter, text: bytes | None, hashes: WordHashes, counts: np.ndarray, longest: int) -> None:
    """Count the fragments of a text in held: eight bytes of the pivot's hash, where the pivot stands, the words."""
    words = [w for w in words_of(text) if w]
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    often = np.where(h > 0, counts[cell_of(h, len(counts))], 0).astype(np.uint64)
    # rarer words first, of equal sums by hash; 0 ends a fragment
    order = np.where(often > 0, np.minimum(often, 0x7FFFFFFF) << np.uint64(32) | h & np.uint64(0xFFFFFFFF), np.uint64(0))
    at, begin, end = spans(order, longest)
    plain, sizes = b" ".join(words), np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    pivots = h.astype("<u8").tobytes()
    found = zip((8 * at).tolist(), (at - begin).tolist(), (ends - sizes)[begin].tolist(), ends[end - 1].tolist(), strict=True)
    held.update([pivots[p : p + 8] + _AT[k] + plain[i:j] for p, k, i, j in found])


def by_pivot(held: Counter) -> tuple[np.ndarray, list[bytes], list[bytes], list[int]]:
    """The fragments of held by pivot: its hash, a line for each fragment, how often each as 64-bit numbers, how many."""
    keys = list(held)
    pivots = np.frombuffer(b"".join([key[:8] for key in keys]), dtype="<u8")
    order = np.argsort(pivots, kind="stable")
    times = np.fromiter(held.values(), dtype="<i8", count=len(keys))[order]
    first = np.flatnonzero(np.diff(pivots[order], prepend=~pivots[order[:1]]))
    cuts = [*first.tolist(), len(keys)]
    order = order.tolist()
    lines, often = [], []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        lines.append(b"\n".join([keys[k][8:] for k in order[lo:hi]]))
        often.append(times[lo:hi].tobytes())
    return pivots[np.array(order, dtype=np.int64)[first]], lines, often, np.diff(cuts).tolist()


def fragments(texts: DataFrame, table: Broadcast, longest: int = LONGEST) -> DataFrame:
    """lang, pivot (a word's hash), parts (in how many groups the pivot is split), n_fragments, times and fragments of texts (lang, text).

    fragments has a line for each different one that a task has met: where its pivot stands, its words; times has how
    often, as 64-bit numbers.
    """
    names = ["lang", "pivot", "parts", "n_fragments", "times", "fragments"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, hashes, held = table.value, ByLang(), {}

        def passed_on() -> Iterator[pa.RecordBatch]:
            for lang, own in held.items():
                if not own:
                    continue
                pivots, lines, times, many = by_pivot(own)
                columns = [
                    pa.array([lang] * len(pivots), pa.string()), pa.array(pivots.view(np.int64)), pa.array(-(-counts[cell_of(pivots, len(counts))] // MOST)),
                    pa.array(many, pa.int64()), pa.array(times, pa.binary()), pa.array(lines, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)
            held.clear()

        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = held.setdefault(lang, Counter())
                size -= len(own)
                add_fragments(own, text.as_py(), hashes[lang], counts, longest)
                size += len(own)
                if size >= HELD:
                    yield from passed_on()
                    size = 0
        yield from passed_on()

    return texts.mapInArrow(run, "lang string, pivot long, parts long, n_fragments long, times binary, fragments binary")


class Numbers(dict):
    """Numbers of words in the order in which they are met; the digits are themselves."""

    def __init__(self):
        super().__init__((b"%d" % k, k) for k in range(10))

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


def mined(lines: list[bytes], times: np.ndarray, longest: int, least: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The n-grams over the pivots of fragments (lines: where the pivot stands, words) that occur least times: phrases, words of each, counts.

    An n-gram is tried only where the shorter ones inside it that hold the pivot occur least times.
    """
    ids = Numbers()
    sizes = np.fromiter((line.count(b" ") for line in lines), dtype=np.int64, count=len(lines))
    fields = b" ".join(lines).split(b" ")
    code = np.fromiter(map(ids.__getitem__, fields), dtype=np.int64, count=len(fields))
    begin = np.cumsum(sizes + 1) - sizes - 1
    at, first = code[begin], begin + 1
    phrases, lengths, sums = [], [], []
    # by how many words stand before the pivot: the fragments in which the n-gram so far is frequent
    frequent = [np.ones(len(lines), dtype=bool)]
    for m in range(2, longest + 1):
        rows = []
        for d in range(m):
            fits = (at >= d) & (at - d + m <= sizes)
            if d < m - 1:
                fits &= frequent[d]
            if d > 0:
                fits &= frequent[d - 1]
            rows.append(np.flatnonzero(fits))
        row = np.concatenate(rows)
        if not len(row):
            break
        start = first[row] + at[row] - np.repeat(np.arange(m), [len(x) for x in rows])
        # numbered from the shorter n-gram on, so that no key is longer than a pair of numbers
        key = code[start]
        for k in range(1, m):
            _, where, key = np.unique(key * len(ids) + code[start + k], return_index=True, return_inverse=True)
        total = np.bincount(key, weights=times[row]).astype(np.int64)
        kept = np.flatnonzero(total >= least)
        phrases += [b" ".join(fields[i : i + m]) for i in start[where[kept]].tolist()]
        lengths.append(np.full(len(kept), m))
        sums.append(total[kept])
        good, frequent, done = total[key] >= least, [], 0
        for x in rows:
            frequent.append(np.zeros(len(lines), dtype=bool))
            frequent[-1][x] = good[done : done + len(x)]
            done += len(x)
    none = np.empty(0, dtype=np.int64)
    return phrases, np.concatenate(lengths or [none]), np.concatenate(sums or [none])


def pivot_ngrams(found: DataFrame, least: int, longest: int = LONGEST) -> DataFrame:
    """lang, phrase, m (words) and f of the n-grams that occur least times, from fragments.

    Groups are mined one after the other, as many together as make TOGETHER fragments; of a pivot that is split all
    counts are passed on and added up.
    """
    names = ["lang", "phrase", "m", "f", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lines, times, many = None, [], [], 0

        def passed_on() -> Iterator[pa.RecordBatch]:
            if lines:
                lang, split = held[0], held[2]
                phrases, m, f = mined(b"\n".join(lines).split(b"\n"), np.frombuffer(b"".join(times), dtype="<i8"), longest, 1 if split else least)
                columns = [pa.array([lang] * len(f), pa.string()), pa.array(phrases, pa.binary()), pa.array(m), pa.array(f), pa.array([split] * len(f), pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=names)
            lines.clear()
            times.clear()

        for batch in batches:
            for lang, pivot, parts, n, often, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                group = (lang, pivot, parts > 1)
                # only whole groups are mined; those of split pivots may be mined in pieces, as they are added up anyway
                if held is not None and (group[0] != held[0] or group[2] != held[2] or many >= TOGETHER and (group != held or group[2])):
                    yield from passed_on()
                    many = 0
                held = group
                lines.append(own)
                times.append(often)
                many += n
        yield from passed_on()

    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("fragments"), F.col("parts"))).otherwise(F.lit(0)).alias("__part")
    dealt = found.select("lang", "pivot", "parts", "n_fragments", "times", "fragments", part)
    dealt = dealt.repartition("lang", "pivot", "__part").sortWithinPartitions("lang", F.col("parts") > 1, "pivot", "__part").drop("__part")
    counted = materialize(dealt.mapInArrow(run, "lang string, phrase binary, m long, f long, part boolean"), "ngrams")
    whole = counted.filter("not part").drop("part")
    split = counted.filter("part").groupBy("lang", "phrase", "m").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    return whole.unionByName(split)


def words_from(phrase: Column, begin: Column, many: Column) -> Column:
    return F.array_join(F.slice(phrase, begin, many), " ")


def scored(grams: DataFrame, words: DataFrame, least: int = LEAST, percent: int = PERCENT, longest: int = LONGEST) -> DataFrame:
    """The phrases of grams (lang, phrase, m, f) that no longer one stands for: lang, phrase, a, l, r and score.

    words (lang, word, n) has the single words.  A phrase's parts occur at least as often as it does, so all are found.
    """
    grams = grams.select("lang", F.col("phrase").cast("string").alias("phrase"), "m", "f")
    parts = grams.filter(F.col("m") < longest).select("lang", "phrase", "f")
    parts = parts.unionByName(words.filter(F.col("n") >= least).select("lang", F.col("word").cast("string").alias("phrase"), F.col("n").alias("f")))
    split = F.split("phrase", " ")
    cut = grams.select("lang", "phrase", F.col("f").alias("a"), "m", split.alias("w"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("m") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", words_from(F.col("w"), F.lit(1), F.col("k").cast("int")).alias("first"), words_from(F.col("w"), (F.col("k") + 1).cast("int"), (F.col("m") - F.col("k")).cast("int")).alias("rest"))
    of = lambda at, name: parts.select("lang", F.col("phrase").alias(at), F.col("f").alias(name))
    known = cut.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    # products may pass 64 bits
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    score = F.expr(f"(cast(a as decimal(20,0)) * cast({FACTOR} as decimal(10,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    least_cut = known.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("c"))
    # what a longer phrase holds: every run of two words or more that is not the whole
    held = grams.filter("m > 2").select("lang", "f", split.alias("w"), "m", F.explode(F.sequence(F.lit(2).cast("long"), F.col("m") - 1)).alias("k"))
    held = held.select("lang", "f", "w", "k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m") - F.col("k") + 1)).alias("s"))
    longer = held.select("lang", "f", words_from(F.col("w"), F.col("s").cast("int"), F.col("k").cast("int")).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = least_cut.select("lang", "phrase", "c.a", "c.l", "c.r", "c.score").join(longer, ["lang", "phrase"], "left")
    return left.filter(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * percent)).drop("longer")


def collocations(
    docs: DataFrame, least: int = LEAST, top: int = TOP, percent: int = PERCENT, longest: int = LONGEST, lang_col: str = "lang", text_col: str = "text",
) -> DataFrame:
    """The first `top` phrases of each language: lang, rank (from 1), phrase, a, l, r, n and score.

    A phrase has 2 to `longest` words of one piece and occurs a times, at least `least`; n is how many words the
    language has.  Cut after k words, l and r are how often its two parts occur; its score is the least
    floor(FACTOR * a / (l + r)), of ties that of the smallest k.  Phrases inside a longer one that has `percent` of
    their occurrences are left out.  Order is by falling score and a, then by phrase in bytes.

    Null and empty texts have no words; a null language is `und`, as is the language of that name.  Texts of any length
    are read whole; repeated rows count as often as they occur; an empty table gives no rows; other columns of docs are
    not read, whatever they are called.  longest is at most 10.
    """
    if not 2 <= longest <= 10:
        raise ValueError(f"longest must be 2 to 10, not {longest}")
    texts = _texts(docs, lang_col, text_col)
    words = materialize(word_counts(texts), "words")
    grams = materialize(pivot_ngrams(fragments(texts, rarity(words, least), longest), least, longest), "frequent")
    found = scored(grams, words, least, percent, longest)
    # the first of each share of a language, then the first of these, so no task sorts all of a language
    for keys in (["lang", F.pmod(F.xxhash64("phrase"), F.lit(SHARES))], ["lang"]):
        rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"), "phrase"))
        found = found.withColumn("rank", rank).filter(F.col("rank") <= top)
    whole = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return found.join(whole, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations_sql() -> str:
    """DuckDB SQL for collocations over documents: all n-grams counted, on small tables."""
    run = lambda m: " || ' ' || ".join(f"w[i + {k}]" for k in range(m))
    grams = " UNION ALL ".join(f"SELECT lang, {m} AS m, {run(m)} AS phrase FROM placed WHERE i + {m - 1} <= len(w)" for m in range(1, LONGEST + 1))
    return rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split),
grams AS ({grams}),
f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY lang, m, phrase HAVING count(*) >= {LEAST}),
wholes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM split GROUP BY lang),
cuts AS (SELECT lang, phrase, f AS a, m, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM f WHERE m > 1),
parts AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, CAST({FACTOR} * CAST(c.a AS HUGEINT) // (x.f + y.f) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')),
best AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_runs AS (SELECT lang, f, array_to_string(w[s:s + k - 1], ' ') AS phrase
  FROM (SELECT lang, f, w, k, unnest(range(1, m - k + 2)) AS s FROM (SELECT lang, f, m, string_split(phrase, ' ') AS w, unnest(range(2, m)) AS k FROM f WHERE m > 2))),
longer AS (SELECT lang, phrase, max(f) AS f FROM inner_runs GROUP BY lang, phrase),
kept AS (SELECT b.* FROM best b LEFT JOIN longer o USING (lang, phrase) WHERE o.f IS NULL OR 100 * CAST(o.f AS HUGEINT) < {PERCENT} * CAST(b.a AS HUGEINT))
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept) JOIN wholes USING (lang)
WHERE rank <= {TOP}"""
