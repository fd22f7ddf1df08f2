"""Collocations from count streams in prefix and in suffix order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairmatch.llm.text import mix
from pairmatch.operators.joins import hot_keys, shuffle_partitions
from pairmatch.session import written

#: Tokens whose sequences a task sums up before they are shuffled.
CHUNK = 1 << 20
#: Most bits (as a power of two) of the filter that keeps hopeless sequences out of the shuffle.
FILTER_BITS = 28
#: The share of the longest runs: how many tasks sort the phrases of one language.
DEALT = 64
SCALE = 1_000_000
BREAK = b"."
#: A-Z to a-z; the characters that end a piece all become ``BREAK``.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else BREAK[0] if chr(b) in ".,;:!?\n\x0b\x0c\r" else b
    for b in range(256)
)
COUNTS = "lang string, phrase string, n long"
#: A record of a stream: its words in the stream's order, its count, and what the pass in prefix
#: order found: counts of its first words and of its most frequent longer phrase.
RECORD = "lang string, words array<string>, n long, firsts array<long>, longer long"


def language_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Tokens of some texts of a language at a time, a ``BREAK`` behind each piece."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lang, text in zip(langs, batch.column(1).cast(pa.binary())):
            tokens = (text.as_py() or b"").translate(FOLD).replace(BREAK, b" . ").split()
            tokens.append(BREAK)
            held.setdefault(lang, []).extend(tokens)
            size += len(tokens)
            if size >= CHUNK:
                yield from held.items()
                held, size = {}, 0
    yield from held.items()


class Tokens:
    """The tokens of some texts as numbers."""

    def __init__(self, tokens: list[bytes]):
        coded = pa.array(tokens, pa.binary()).dictionary_encode()
        self.words = coded.dictionary
        self.codes = coded.indices.to_numpy().astype(np.int64)
        self.real = np.array([w != BREAK for w in self.words.to_pylist()])[self.codes]

    def inside(self, length: int) -> np.ndarray:
        """Where ``length`` words start that lie in one piece."""
        n = max(0, len(self.codes) - length + 1)
        good = np.ones(n, bool)
        for k in range(length):
            good &= self.real[k : k + n]
        return np.flatnonzero(good)

    def distinct(self, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First places and numbers of the different sequences at the ``starts``."""
        size, key = len(self.words), self.codes[starts]
        for k in range(1, length):
            if k > 1:  # numbers of what came so far, so that the key fits
                key = np.unique(key, return_inverse=True)[1]
            key = key * size + self.codes[starts + k]
        _, first, counts = np.unique(key, return_index=True, return_counts=True)
        return starts[first], counts

    def phrases(self, starts: np.ndarray, length: int) -> pa.Array:
        """The sequences, words joined by spaces."""
        parts = [self.words.take(pa.array(self.codes[starts + k])) for k in range(length)]
        joined = pc.binary_join_element_wise(*parts, b" ") if length > 1 else parts[0]
        return joined.cast(pa.string())

    def names(self, length: int) -> np.ndarray:
        """64-bit names of the sequences that start at each place."""
        own = np.array([xxhash.xxh64_intdigest(w) for w in self.words.to_pylist()], np.uint64)
        return sequence_names([own[self.codes[k : len(self.codes) - length + 1 + k]] for k in range(length)])


def sequence_names(words: list[np.ndarray]) -> np.ndarray:
    """One name for each row of word hashes."""
    name = mix(words[0])
    for word in words[1:]:
        name = mix(name * np.uint64(3) + word)
    return name


class Filter:
    """A set of phrases in a bit array of bounded size; it may hold more, never fewer.

    It decides what is shuffled, not the result: counts are taken over the phrases themselves.
    """

    def __init__(self, phrases: DataFrame):
        self.size = size = min(FILTER_BITS, max(16, (16 * phrases.count()).bit_length()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                rows = [p.encode().split(b" ") for p in batch.column(0).to_pylist()]
                hashes = np.array(
                    [[xxhash.xxh64_intdigest(w) for w in words] for words in rows], np.uint64
                )
                at = sequence_names(list(hashes.T)) >> np.uint64(64 - size)
                bits = np.uint64(1) << (at & np.uint64(63))
                yield pa.RecordBatch.from_arrays(
                    [pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(bits.view(np.int64))],
                    names=["word", "bit"],
                )

        words = phrases.select("phrase").mapInArrow(run, "word long, bit long")
        found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        self.bits = np.zeros(1 << (size - 6), np.uint64)
        self.bits[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)

    def has(self, names: np.ndarray) -> np.ndarray:
        at = names >> np.uint64(64 - self.size)
        word = self.bits[(at >> np.uint64(6)).astype(np.int64)]
        return (word >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def counted(
    texts: DataFrame,
    sequences: Callable[[Tokens], Iterator[tuple[pa.Array, np.ndarray]]],
) -> DataFrame:
    """``(lang, phrase, n)`` of what ``sequences`` finds; tasks add up their own texts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, tokens in language_tokens(batches):
            for phrases, counts in sequences(Tokens(tokens)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(phrases), pa.string()), phrases,
                     pa.array(counts.astype(np.int64))],
                    names=["lang", "phrase", "n"],
                )

    parts = texts.mapInArrow(run, COUNTS)
    return parts.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def count_streams(texts: DataFrame, most_words: int, least: int) -> DataFrame:
    """Counts of all phrases of 1 to ``most_words`` words that occur ``least`` times or more.

    The empty phrase has the number of all words. A phrase is counted only where the phrases
    without its first and without its last word, which occur at least as often, may be frequent:
    a filter of those found in the pass before tells.
    """

    def short(found: Tokens) -> Iterator[tuple[pa.Array, np.ndarray]]:
        words = found.inside(1)
        yield pa.array([""], pa.string()), np.array([len(words)])
        for length in range(1, min(2, most_words) + 1):
            starts, counts = found.distinct(found.inside(length), length)
            yield found.phrases(starts, length), counts

    frequent = (F.col("n") >= least) | (F.col("phrase") == "")
    streams = [written(counted(texts, short).where(frequent), "phrases")]
    for length in range(3, most_words + 1):
        shorter = streams[-1].where(F.size(F.split("phrase", " ")) == length - 1)
        sent = texts.sparkSession.sparkContext.broadcast(Filter(shorter))

        def longer(found: Tokens, sent=sent, length=length):
            starts = found.inside(length)
            if len(starts):
                good = sent.value.has(found.names(length - 1))
                starts = starts[good[starts] & good[starts + 1]]
            starts, counts = found.distinct(starts, length)
            yield found.phrases(starts, length), counts

        streams.append(written(counted(texts, longer).where(frequent), "phrases"))
    out = streams[0]
    for stream in streams[1:]:
        out = out.unionByName(stream)
    return out


def in_order(records: DataFrame) -> DataFrame:
    """Records dealt by ranges of their first word and sorted, shorter ones before longer ones.

    The records of a first word that has many are dealt once more by the second word; the record
    of the word alone goes to each of these parts (``salt`` 0 has the original).
    """
    first = F.col("words")[0]
    keyed = records.withColumn("first", first)
    counts = keyed.groupBy("lang", "first").agg(F.count("*").alias("n"))
    dealt = keyed.join(F.broadcast(hot_keys(counts, ["lang", "first"])), ["lang", "first"], "left")
    salts = F.coalesce("_salts", F.lit(1))
    own = F.pmod(F.xxhash64(F.get("words", F.lit(1))), salts).cast("int")
    to = F.when(F.size("words") == 1, F.sequence(F.lit(0), salts - 1)).otherwise(F.array(own))
    return (
        dealt.withColumn("salt", F.explode(to))
        .repartitionByRange(shuffle_partitions(records), "lang", "first", "salt")
        .sortWithinPartitions("lang", "first", "salt", "words")
        .select("lang", "words", "n", "firsts", "longer", "salt")
    )


def merged(records: DataFrame, close: Callable, schema: str) -> DataFrame:
    """Go through sorted records with the stack of those that begin each one.

    ``close(lang, words, n, firsts, longer, above, most)`` gets a record when all longer ones
    that begin with it have passed: ``above`` are the counts of its first 1, 2, ... words and
    ``most`` is the largest count among phrases of one word more. It returns a row or None. A
    task holds the records of one stack and a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[list] = []  # [lang, words, n, firsts, longer, most, counts to here, salt]
        rows: list[tuple] = []

        def pop() -> None:
            lang, words, n, firsts, longer, most, counts, salt = stack.pop()
            if len(words) > 1 or salt == 0:
                row = close(lang, words, n, firsts, longer, counts[:-1], most)
                if row is not None:
                    rows.append(row)

        for batch in batches:
            columns = (batch.column(k).to_pylist() for k in range(6))
            for lang, words, n, firsts, longer, salt in zip(*columns):
                while stack and (
                    stack[-1][0] != lang
                    or stack[-1][7] != salt
                    or stack[-1][1] != words[: len(stack[-1][1])]
                ):
                    pop()
                counts = [*(stack[-1][6] if stack else []), n]
                if stack and len(stack[-1][1]) == len(words) - 1:
                    stack[-1][5] = max(stack[-1][5], n)
                stack.append([lang, words, n, firsts, longer, 0, counts, salt])
            yield rows_of(rows)
            rows.clear()
        while stack:
            pop()
        yield rows_of(rows)

    names = [part.split()[0] for part in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}
    types = [kinds[part.split()[1]] for part in schema.split(", ")]

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(names)
        arrays = [pa.array(c, t) for c, t in zip(columns, types)]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    return in_order(records).mapInArrow(run, schema)


def with_firsts(lang, words, n, firsts, longer, above, most):
    """After the pass in prefix order: the record turned round for the one in suffix order."""
    return lang, words[::-1], n, above, most


def weakest_cut(n: int, firsts: list[int], lasts: list[int]) -> tuple[int, int, int]:
    """``(score, l, r)`` of the cut with the lowest score, the first of equals; exact."""
    cuts = zip(firsts, reversed(lasts))
    scored = [(SCALE * n * n // (left * right), k, left, right) for k, (left, right) in enumerate(cuts)]
    score, _, left, right = min(scored)
    return score, left, right


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    most_words: int = 3,
    least: int = 10,
    share: int = 50,
    keep: int = 2000,
) -> DataFrame:
    """The first ``keep`` phrases of each language by score: ``(lang, rank, phrase, a, l, r, n, score)``.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and these into
    words at spaces and tabs. Phrases of 2 to ``most_words`` words inside pieces that occur ``a >=
    least`` times are candidates. A cut after the first words gives counts ``l`` and ``r`` of both
    parts and the score ``floor(1000000 a a / (l r))`` in whole numbers of any size; the cut with
    the lowest score counts. A candidate inside a longer one with ``share`` per cent of its count
    or more is dropped; it is enough to look at phrases of one word more, since the phrases inside
    a longer one occur at least as often as it does. Order: score and ``a`` descending, phrase
    ascending by UTF-8 bytes.

    The counts are streams sorted by words. In prefix order a phrase comes after its first words
    and before its extensions to the right, in suffix order (words turned round) after its last
    words and before its extensions to the left. One pass over each, all lengths in step, finds
    counts of parts and extensions without any table of them. A word with many phrases is dealt
    over tasks by the second word.

    Null language: ``und``. Null text: no words. Repeated rows count as often as they are there;
    texts of any length are summed up in bounded tables; no rows or no candidate give no rows.
    """
    texts = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.col(text_col).cast("string").alias("text"),
    )
    counts = written(count_streams(texts, most_words, least), "streams")
    totals = counts.where("phrase = ''").select("lang", F.col("n").alias("total"))
    records = counts.where("phrase != ''").select(
        "lang", F.split("phrase", " ").alias("words"), "n",
        F.lit(None).cast("array<long>").alias("firsts"), F.lit(None).cast("long").alias("longer"),
    )
    suffixes = written(merged(records, with_firsts, RECORD), "suffix-order")

    def judged(lang, words, n, firsts, longer, above, most):
        if len(words) < 2 or 100 * max(longer, most) >= share * n:
            return None
        score, left, right = weakest_cut(n, firsts, above)
        return lang, " ".join(words[::-1]), n, left, right, score

    scored = written(
        merged(suffixes, judged, "lang string, phrase string, a long, l long, r long, score long"),
        "collocations",
    )
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(DEALT))
    best_of_part = F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))
    best = scored.withColumn("place", best_of_part).where(F.col("place") <= keep)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return (
        best.withColumn("rank", rank)
        .where(F.col("rank") <= keep)
        .join(totals, "lang")
        .select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
    )
