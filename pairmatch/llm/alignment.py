"""Alignment of two tokenizers' tokens by the byte offsets at which both end."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from pairmatch.operators.joins import lookup_join
from pairmatch.session import written

#: UTF-8 bytes of text that one Arrow table of tokens is built from; a longer text is one of its own.
CHUNK = 1 << 21
#: Pairs of ids up to which their counts are broadcast; more of them are joined with salts.
MOST_BROADCAST = 1_000_000
#: A stretch starts at a space or line end after a character that is no white space. Neither
#: tokenizer has a token over such a place: the byte-level one splits there before it merges, and
#: the other one has no piece with a space or line end behind another character.
STRETCH = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")
SPACE_MARK = "▁"
#: Fixed value: how the byte-level tokenizer splits a text before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RESULT = (
    "n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, "
    "pairs array<long>, times array<long>"
)


def byte_alphabet() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary.

    Printable bytes stand for themselves, the others for the characters from 256 on.
    """
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def byte_encoding(vocabulary: Tokenizer, entries: dict[bytes, int]) -> tiktoken.Encoding:
    """The merges of a byte-level tokenizer file as ranks, which are encoded in far less time.

    That gives the same ids where a merge makes the entry next in number, as it is checked here.
    """
    model = json.loads(vocabulary.to_str())["model"]
    alphabet = byte_alphabet()
    rank = {bytes(alphabet[c] for c in entry): k for entry, k in model["vocab"].items()}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [rank[bytes(alphabet[c] for c in a + b)] for a, b in merges]
    if made != sorted(made) or sorted(rank.values()) != list(range(len(rank))):
        raise ValueError("the entries are not numbered in the order of their merges")
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=entries, special_tokens={})


class Pair:
    """The two tokenizers of a worker, and the bytes of all their tokens."""

    def __init__(self, byte_model: str, piece_model: str):
        vocabulary = Tokenizer.from_file(byte_model)
        self.b = b = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        alphabet = byte_alphabet()
        entries = vocabulary.get_vocab(with_added_tokens=False)
        a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, number in entries.items():
            a_bytes[number] = bytes(alphabet[c] for c in entry)
        self.a = byte_encoding(vocabulary, {x: k for k, x in enumerate(a_bytes)})
        b_bytes = []
        for number in range(b.get_piece_size()):
            piece = b.id_to_piece(number)
            b_bytes.append(
                bytes([int(piece[3:5], 16)])
                if b.is_byte(number)
                else piece.replace(SPACE_MARK, " ").encode()
            )
        pieces = [b.id_to_piece(k) for k in range(len(b_bytes)) if not b.is_byte(k)]
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) or ("\n" in p and len(p) > 1) for p in pieces):
            raise ValueError("the model has pieces over a space or line end")
        self.a_bytes = pa.array(a_bytes, pa.large_binary())
        self.b_bytes = pa.array(b_bytes, pa.large_binary())
        self.space = b.piece_to_id(SPACE_MARK)

    def encode(self, stretches: list[str]) -> tuple[pa.ListArray, pa.ListArray]:
        """The ids of each stretch by both; a stretch starts with a space or a line end."""
        a = list(map(self.a.encode_ordinary, stretches))
        # the model puts a space first: it stands for that of the stretch, or goes
        given = [s[1:] if s[0] == " " else s for s in stretches]
        b = self.b.encode(given, num_threads=1)
        for k, s in enumerate(stretches):
            if s[0] != " ":
                b[k] = b[k][1:]
            elif s == " ":
                b[k] = [self.space]
        kind = pa.list_(pa.int32())
        return pa.array(a, kind), pa.array(b, kind)


_pairs: dict[tuple[str, str], Pair] = {}


def tokenizer_pair(byte_model: str, piece_model: str) -> Pair:
    """The tokenizers of this worker."""
    key = (byte_model, piece_model)
    if key not in _pairs:
        _pairs[key] = Pair(*key)
    return _pairs[key]


def same_bytes(ids: pa.ListArray, of: pa.Array, stretches: list[bytes]) -> np.ndarray:
    """Whether the tokens of each stretch join to its bytes."""
    joined = pc.take(of, ids.flatten())
    ends = np.append(0, np.cumsum(pc.binary_length(joined).to_numpy()))
    cuts = ends[np.asarray(ids.offsets)]
    data = joined.buffers()[2].to_pybytes()  # one after the other
    return np.array(
        [data[i:j] == s for i, j, s in zip(cuts[:-1], cuts[1:], stretches)], dtype=bool
    )


def token_table(
    per_stretch: pa.ListArray, stretch: pa.Array, doc: np.ndarray, of: pa.Array
) -> pa.Table:
    """``(doc, end, id, at)`` of every token: its document, end byte, id, and row.

    ``end`` holds the document in its upper half, so it is the key of both.
    """
    lists = pc.take(per_stretch, stretch)
    ids = lists.flatten()
    docs = doc[pc.list_parent_indices(lists).to_numpy()]
    lengths = pc.take(pc.binary_length(of), ids).to_numpy().astype(np.int64)
    ends = np.cumsum(lengths)
    # segmented: minus what was reached before the document
    first = np.flatnonzero(np.diff(docs, prepend=-1))
    base = np.repeat(ends[first] - lengths[first], np.diff(np.append(first, len(docs))))
    ends += (docs << 32) - base
    at = np.arange(len(docs), dtype=np.int32)
    return pa.table({"doc": docs, "end": ends, "id": ids, "at": at})


def joined_ids(ids: pa.Array, cuts: np.ndarray) -> pa.Array:
    """The decimal ids of each group, with commas; groups end before the ``cuts``."""
    texts = pc.cast(ids, pa.string()).combine_chunks().cast(pa.large_string())
    groups = pa.ListArray.from_arrays(pa.array(np.append(0, cuts), pa.int32()), texts)
    return pc.binary_join(groups, pa.scalar(",", pa.large_string()))


def align(texts: list[str], pair: Pair, keep_groups: bool = False) -> dict[str, pa.Array]:
    """The columns of ``RESULT`` for some texts that are not empty."""
    parts = [STRETCH.findall(" " + text) for text in texts]
    sizes = np.array([len(p) for p in parts])
    coded = pa.array([s for p in parts for s in p], pa.large_string()).dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    a_lists, b_lists = pair.encode(distinct)
    given = [s.encode() for s in distinct]
    good = same_bytes(a_lists, pair.a_bytes, given) & same_bytes(b_lists, pair.b_bytes, given)
    codes = coded.indices.to_numpy()
    doc = np.repeat(np.arange(len(texts)), sizes)
    bad = np.unique(doc[~good[codes]])
    keep = ~np.isin(doc, bad)
    stretch, doc = pa.array(codes[keep]), doc[keep]
    a = token_table(a_lists, stretch, doc, pair.a_bytes)
    b = token_table(b_lists, stretch, doc, pair.b_bytes)
    links = a.join(
        b.drop(["doc"]), keys="end", join_type="inner", right_suffix="_b", use_threads=False
    ).sort_by("at")

    n = len(texts)

    def per_doc(column) -> np.ndarray:
        return np.bincount(column.to_numpy(), minlength=n)

    n_links = per_doc(links["doc"])
    # every token has bytes, so at an end at most one token of each ends: a link ends a group
    groups = pc.binary_join_element_wise(
        joined_ids(a["id"], links["at"].to_numpy() + 1),
        joined_ids(b["id"], np.sort(links["at_b"].to_numpy()) + 1),
        pa.scalar("|", pa.large_string()),
    )
    cuts = pa.array(np.append(0, np.cumsum(n_links)), pa.int32())
    grouped = pa.ListArray.from_arrays(cuts, groups)
    whole = pc.binary_join(grouped, pa.scalar(";", pa.large_string())).to_pylist()
    digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in whole]
    code = pc.bit_wise_or(
        pc.shift_left(pc.cast(links["id"], pa.int64()), 32), pc.cast(links["id_b"], pa.int64())
    )
    counted = (
        pa.table({"doc": links["doc"], "pair": code})
        .group_by(["doc", "pair"], use_threads=False)
        .aggregate([("pair", "count")])
        .sort_by([("doc", "ascending"), ("pair", "ascending")])
    )
    edges = pa.array(np.append(0, np.cumsum(per_doc(counted["doc"]))), pa.int32())
    return {
        "n_a": pa.array(per_doc(a["doc"])),
        "n_b": pa.array(per_doc(b["doc"])),
        "n_groups": pa.array(n_links),
        "n_links": pa.array(n_links),
        "groups": pa.array(whole if keep_groups else [None] * n, pa.string()),
        "groups_sha256": pa.array(digests, pa.string()),
        "pairs": pa.ListArray.from_arrays(edges, counted["pair"].combine_chunks()),
        "times": pa.ListArray.from_arrays(edges, counted["pair_count"].combine_chunks()),
    }


def nothing(n: int) -> dict[str, pa.Array]:
    """The columns of ``RESULT`` for texts without tokens."""
    zeros, none = pa.array(np.zeros(n, np.int64)), pa.array([[]] * n, pa.list_(pa.int64()))
    numbers = {c: zeros for c in ("n_a", "n_b", "n_groups", "n_links")}
    empty = pa.array([""] * n, pa.string())
    return numbers | {
        "groups": empty, "groups_sha256": empty, "pairs": none, "times": none,
    }


def aligned(
    docs: DataFrame,
    byte_model: str,
    piece_model: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_groups: bool = False,
) -> DataFrame:
    """Token groups and links of every text, ``(doc_id, n_a, ..., pairs, times)``.

    The text with a space in front is encoded by the byte-level tokenizer ``byte_model`` (A), the
    text by the sentence-piece model ``piece_model`` (B), which puts a space first itself. Byte
    offsets at which a token of A and one of B end cut both into groups, and link these two.
    ``groups`` (with ``keep_groups``, else null) lists the ids, ``a1,a2|b1;a3|b2,b3``;
    ``pairs`` are the distinct linked ids as ``a * 2 ** 32 + b`` and ``times`` how often the text
    holds each.

    Each Arrow table holds the tokens of about ``CHUNK`` bytes of text: the distinct stretches
    between spaces are encoded once, their lists taken for every occurrence and flattened, ends
    are running sums of token lengths within a document, and an Arrow join on document and end
    finds the links. Nothing is shuffled, and memory is bounded by a chunk or one longer text.

    Null and empty texts, and those that the tokens of A or B don't join to (U+2581, which B
    reads as a space), have no tokens: zeros, and empty strings and lists. Repeated and null ids
    are rows of their own; other columns are not looked at. No rows give no rows.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([source.schema["doc_id"]])
    schema = T.StructType([*schema.fields, *T.StructType.fromDDL(RESULT).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizer_pair(byte_model, piece_model)
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
            part = np.cumsum(lengths.astype(np.int64)) // CHUNK
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lengths)]
            for start, stop in zip(edges[:-1], edges[1:]):
                if start < stop:
                    yield block(batch.slice(start, stop - start), pair)

    def block(batch: pa.RecordBatch, pair: Pair) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        full = [k for k, text in enumerate(texts) if text]
        out = nothing(len(texts) - len(full))
        if full:
            found = align([texts[k] for k in full], pair, keep_groups)
            out = {c: pa.concat_arrays([found[c], out[c]]) for c in out}
        # back to the order of the rows: texts first, the others behind
        place = np.argsort(np.array(full + [k for k, text in enumerate(texts) if not text]))
        columns = [pc.take(out[c], pa.array(place)) for c in schema.names[1:]]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    return source.mapInArrow(run, schema)


def pair_counts(links: DataFrame) -> DataFrame:
    """``(pair, n, rows, best)``: how many links and rows of ``aligned`` hold a pair of ids.

    ``best``: no other pair with the same B id has more links. The tasks have summed up each
    text, partial sums follow before the shuffle. A table with a row per B id is no larger than
    that vocabulary.
    """
    counts = written(
        links.select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
        .groupBy(F.col("x.pairs").alias("pair"))
        .agg(F.sum("x.times").alias("n"), F.count("*").alias("rows")),
        "pair-counts",
    ).withColumn("b", F.col("pair").bitwiseAND((1 << 32) - 1))
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), "b").select(
        "pair", "n", "rows", (F.col("n") == F.col("most")).alias("best")
    )


def link_counts(
    docs: DataFrame,
    byte_model: str,
    piece_model: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    most: int = MOST_BROADCAST,
) -> DataFrame:
    """``aligned`` with ``n_best`` and ``count_sum`` for each row.

    ``count_sum`` adds the corpus-wide count of the pair of each link, ``n_best`` counts the links
    whose pair is the most frequent of its B id. Counts are sent to the tasks up to ``most``
    pairs and joined with salts beyond, so frequent pairs never meet in one task.
    """
    links = written(
        aligned(docs, byte_model, piece_model, id_col, text_col).withColumn(
            "row", F.monotonically_increasing_id()
        ),
        "links",
    )
    counts = written(pair_counts(links), "pairs")
    held = links.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(
        "row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times")
    )
    found = lookup_join(
        held, counts.drop("rows"), ["pair"], counts, F.col("row"), most=most, n="rows"
    )
    sums = found.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(F.lit(0))).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"),
    )
    zero = F.lit(0).cast("long")
    return links.join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"),
        "groups_sha256", "pairs", "times",
    )
