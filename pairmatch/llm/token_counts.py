"""Exact token counts at every prefix of a text, by dynamic programming over segments."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Segments whose counts a worker remembers; then it starts afresh.
REMEMBERED = 500_000
SPACE_MARK = "▁"


class PrefixCounter:
    """Token counts of prefixes for a byte-pair model of sentence pieces.

    The model's pieces show where no merge can happen: before a space (no piece has a space
    after another character) and around a line end (no piece but its own has one). There the
    tokens of a prefix and of the rest add up, so

        count(prefix) = count(up to the last cut) + count(segment up to the prefix's end)

    and the second term depends on the segment alone. Segments repeat, so few are encoded.
    """

    def __init__(self, model: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [
            self.processor.id_to_piece(i)
            for i in range(self.processor.get_piece_size())
            if not (self.processor.is_control(i) or self.processor.is_byte(i))
        ]
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces):
            raise ValueError("the model has pieces that cross a space")
        if any("\n" in p for p in pieces if len(p) > 1):
            raise ValueError("the model has pieces that cross a line end")
        # a segment is a run of spaces or line ends and what follows up to the next
        self.segment = re.compile(r" +[^ \n]*|\n+[^ \n]*")
        self.known: dict[str, int] = {}

    def segments(self, text: str) -> list[str]:
        """The segments of a text; the model puts a space before it."""
        return self.segment.findall(" " + text.replace(SPACE_MARK, " ")) if text else []

    def count(self, segment: str) -> int:
        """Number of tokens of a segment or of a prefix of one."""
        if segment[0] == "\n":  # without the space that the model puts first
            return len(self.processor.encode(segment)) - 1
        return len(self.processor.encode(segment[1:])) if segment != " " else 1

    def learn(self, segments: list[str]) -> None:
        """Encode the segments that are not known yet, in one call."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [s for s in dict.fromkeys(segments) if s not in self.known]
        given = [s if s[0] == "\n" else s[1:] for s in new]
        for segment, ids in zip(new, self.processor.encode(given, num_threads=1)):
            if segment[0] == "\n":
                self.known[segment] = len(ids) - 1
            else:
                self.known[segment] = len(ids) if segment != " " else 1

    def counts(self, text: str) -> tuple[list[str], list[int]]:
        """Segments and the token count of the text up to the end of each."""
        segments = self.segments(text)
        self.learn(segments)
        return segments, list(accumulate(map(self.known.__getitem__, segments)))

    def total(self, text: str) -> int:
        """Number of tokens of the whole text."""
        segments = self.segments(text)
        self.learn(segments)
        return sum(map(self.known.__getitem__, segments))

    def at(self, text: str, length: int) -> int:
        """Number of tokens of the first ``length`` characters."""
        if length <= 0 or not text:
            return 0
        segments, counts = self.counts(text)
        end, done = -1, 0  # the space in front is no character of the text
        for segment, count in zip(segments, counts):
            if end + len(segment) >= length:
                return done + self.count(segment[: length - end])
            end, done = end + len(segment), count
        return done

    def cut(self, text: str, budget: int) -> int:
        """Length of the longest prefix with at most ``budget`` tokens.

        Every segment has a token at least, so the prefix ends in the last segment that starts
        below the budget, or right before it.
        """
        segments, counts = self.counts(text)
        k = sum(c < budget for c in counts)  # segments that end below the budget
        start = sum(map(len, segments[:k])) - 1
        left = budget - (counts[k - 1] if k else 0)
        if k < len(segments):
            for length in range(len(segments[k]), 0, -1):
                if self.count(segments[k][:length]) <= left:
                    return max(0, start + length)
        return max(0, start)


_counters: dict[str, PrefixCounter] = {}


def counter(model: str) -> PrefixCounter:
    """The counter of this worker for a model."""
    if model not in _counters:
        _counters[model] = PrefixCounter(model)
    return _counters[model]


def prefix_counts(
    docs: DataFrame,
    model: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    budget: int | None = None,
    prefixes: bool = True,
) -> DataFrame:
    """Token counts of every text: ``(doc_id, n_bytes, n_tokens, ends, counts, cut)``.

    ``ends`` are the segment ends in code points and ``counts`` the tokens up to each;
    ``n_tokens`` is the last of them. With a ``budget``, ``cut`` is the length of the longest
    prefix within it, else null. Without ``prefixes`` the arrays are not returned.

    A narrow map over the rows: nothing is shuffled, and memory is bounded by a batch and the
    remembered segments. Null and empty texts have no tokens and no bytes. Rows with equal ids
    or null ids are counted each on their own; other columns are not looked at.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    numbers = T.ArrayType(T.IntegerType())
    schema = T.StructType(
        [
            T.StructField("doc_id", source.schema["doc_id"].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ends", numbers),
            T.StructField("counts", numbers),
            T.StructField("cut", T.IntegerType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model)
        for batch in batches:
            sizes, totals, ends, steps, cuts = [], [], [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                sizes.append(len(text.encode()))
                if prefixes:
                    segments, upto = count.counts(text)
                    ends.append([e - 1 for e in accumulate(map(len, segments))])
                    steps.append(upto)
                    totals.append(upto[-1] if upto else 0)
                else:
                    totals.append(count.total(text))
                    ends.append(None)
                    steps.append(None)
                cuts.append(None if budget is None else count.cut(text, budget))
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()),
                    pa.array(ends, ints), pa.array(steps, ints), pa.array(cuts, pa.int32()),
                ],
                names=schema.names,
            )

    return source.mapInArrow(run, schema)
