"""Best-fit packing of tokenised documents into sequences of fixed length.

Documents become pieces (only those beyond the limit are cut).  Each partition
packs its own pieces best-fit, longest first.  Bins that are nearly full are
emitted; the underfull ones go on as single items to fewer partitions, where
best-fit runs again, up a tree.  A level never gives one task more than about
``TASK_BINS`` bins, so the tree stops merging where the rest is too large for
that; nothing is dropped, such bins are emitted as they are.

Defined cases: a null or empty text is the end id alone; rows with equal or null
ids are packed like any others; an empty table gives no rows; columns other than
the id and the text are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpisleuth.llm.common import worker_memory, written
from kpisleuth.llm.wordhash import chunks, columns

CAPACITY = 4096
END_ID = 1
NEARLY_FULL = 4  # free tokens up to which a bin is emitted at once
FAN_IN = 8
TASK_BINS = 20_000
CACHED_WORDS = 600_000
TEXT_BYTES = 4 << 20  # texts made distinct together

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# The steps of a tokenizer whose ids are those of its words between
# white space, with letters and a tail of stops or commas in runs of their own.
BY_WORD_NORMALIZER = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    {"type": "Lowercase"},
]
BY_WORD_SPLIT = {
    "type": "Split", "behavior": "Removed", "invert": True,
    "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
}
PLAIN_WORD = "^(?P<core>[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)(?P<tail>[.,]*)$"


def spread(flat: np.ndarray, ends: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``order`` of ``flat``, one after the other, and where each ends (from 0)."""
    lengths = np.diff(ends)[order]
    out = np.concatenate([[0], np.cumsum(lengths)])
    return flat[np.arange(out[-1]) + np.repeat(ends[:-1][order] - out[:-1], lengths)], out


class WordTokens:
    """Token ids of texts, by distinct word where the tokenizer allows it.

    Words are split and made distinct by Arrow.  Lower-cased letters with a tail
    of commas or stops are two runs whatever the letters are, so the letters are
    looked up alone.  The memory has two generations: when the recent one is half
    of ``CACHED_WORDS`` it becomes the older one, and what is met again moves on.
    A tokenizer with other steps encodes whole texts.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            steps = json.load(file)
        self.by_word = (
            (steps["normalizer"] or {}).get("normalizers") == BY_WORD_NORMALIZER
            and (steps["pre_tokenizer"] or {}).get("pretokenizers", [None])[0] == BY_WORD_SPLIT)
        self.recent: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.asarray(encoding.ids, dtype="<u4").tobytes() for encoding in found]

    def codes(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after the other, and where each word's end."""
        words = words.cast(pa.large_binary()).to_pylist()
        recent, older, new = self.recent, self.older, []
        for word in words:
            if word not in recent:
                kept = older.get(word)
                if kept is None:
                    new.append(word)
                else:
                    recent[word] = kept
        recent.update(zip(new, self.encode(new), strict=True))
        found = [recent[w] for w in words]
        if 2 * len(recent) > CACHED_WORDS:
            self.older, self.recent = recent, {}
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return np.frombuffer(b"".join(found), "<u4"), np.concatenate([[0], np.cumsum(lengths)])

    def ids(self, texts: list[bytes]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text, the end id included."""
        end = np.asarray([END_ID], dtype="<u4")
        if not self.by_word:
            yield from (coded + end.tobytes() for coded in self.encode(texts))
            return
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
        words = lists.values.dictionary_encode()
        plain = pc.extract_regex(words.dictionary, PLAIN_WORD)
        cores = pc.coalesce(pc.utf8_lower(pc.struct_field(plain, "core")), words.dictionary).dictionary_encode()
        tails = pc.fill_null(pc.struct_field(plain, "tail"), "").dictionary_encode()
        # The parts of a word are its letters and its tail, the parts of a text its words and the end.
        flat, ends = self.codes(pa.concat_arrays([cores.dictionary, tails.dictionary]))
        pairs = np.stack([cores.indices.to_numpy(), tails.indices.to_numpy() + len(cores.dictionary)], axis=1)
        flat, ends = spread(flat, ends, pairs.ravel())
        flat, ends = np.concatenate([flat, end]), np.append(ends[::2], ends[-1] + 1)
        offsets = lists.offsets.to_numpy()
        flat, ends = spread(flat, ends, np.insert(words.indices.to_numpy(), offsets[1:], len(words.dictionary)))
        bounds = ends[offsets + np.arange(len(offsets))]
        for first, last in zip(bounds[:-1], bounds[1:], strict=True):
            yield flat[first:last].tobytes()


def _pieces(path: str, capacity: int, id_column: str, text_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = worker_memory(f"tokens:{path}", lambda: WordTokens(path))
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                            ("length", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offsets = columns(batch.column(1))
            view = memoryview(data)
            out: list[tuple] = []
            for first, last in chunks(offsets, TEXT_BYTES):
                texts = [bytes(view[offsets[i]: offsets[i + 1]]) for i in range(first, last)]
                for doc, coded in zip(ids[first:last], tokens.ids(texts), strict=True):
                    total = len(coded) // 4
                    for piece, start in enumerate(range(0, total, capacity)):
                        part = coded[4 * start: 4 * (start + capacity)]
                        out.append((doc, piece, start, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)]
                if out else [pa.array([], f.type) for f in schema], schema=schema)

    return run


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """One row per piece: id, piece number, its first token, its length and the crc32 of its ids."""
    frame = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return frame.mapInArrow(_pieces(tokenizer, capacity, "doc_id", "text"), PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each item and its place there; items are taken in the order given.

    The fullest bin that still holds the item wins.  Free space is an integer up
    to ``capacity``, so the search is one bit scan over the sizes in use.
    """
    bins, places = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, fills = 0, []
    for i, length in enumerate(lengths.tolist()):
        fitting = used >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            at = free[room].pop()
            if not free[room]:
                used &= ~(1 << room)
        else:
            room, at = capacity, len(fills)
            fills.append(0)
        bins[i], places[i] = at, fills[at]
        fills[at] += length
        room -= length
        if room:
            free[room].append(at)
            used |= 1 << room
    return bins, places


def _pack_level(level: int, capacity: int):
    """Pack the bins of a partition: each gets a new sequence and a shift of its pieces."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        items = [f for f in frames if len(f)]
        if not items:
            return
        items = pd.concat(items, ignore_index=True).sort_values(["fill", "seq"], ascending=[False, True], kind="stable")
        bins, places = best_fit(items["fill"].to_numpy(), capacity)
        fills = np.bincount(bins, weights=items["fill"]).astype(np.int64)
        items["into"] = (level << 56) | (task << 32) | bins
        items["shift"], items["new_fill"] = places, fills[bins]
        yield items[["seq", "into", "shift", "new_fill"]]

    return run


def _pack_leaves(capacity: int):
    """Pack the pieces of a partition.  Rows keep all columns and gain seq, at and fill."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        rows = [f for f in frames if len(f)]
        if not rows:
            return
        rows = pd.concat(rows, ignore_index=True)
        rows = rows.sort_values(["length", "doc_id", "piece", "start"], ascending=[False, True, True, True], kind="stable")
        bins, places = best_fit(rows["length"].to_numpy(), capacity)
        rows["seq"], rows["at"] = (task << 32) | bins, places
        rows["fill"] = np.bincount(bins, weights=rows["length"]).astype(np.int64)[bins]
        yield rows

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Place every piece: adds ``sequence_id`` and ``offset``, gapless within a sequence.

    ``pieces`` should be a written table, as its partitions are the leaves.  Above
    the leaves only (bin, fill) pairs of underfull bins move.
    """
    spark = pieces.sparkSession
    schema = pieces.schema.simpleString()[len("struct<"):-1]
    leaves = written(pieces.mapInPandas(_pack_leaves(capacity), f"{schema},seq:bigint,at:bigint,fill:bigint"), "pack-leaves")
    open_bins = leaves.where(F.col("fill") < capacity - NEARLY_FULL).groupBy("seq").agg(F.first("fill").alias("fill"))
    moved, width, level = None, leaves.rdd.getNumPartitions(), 0
    while True:
        open_bins = written(open_bins, "pack-open")
        count = open_bins.count()
        narrower = max(-(-width // FAN_IN), -(-count // TASK_BINS))
        if count < 2 or (level and narrower >= width):
            break
        width, level = narrower, level + 1
        # By hash, not round robin: the same bins meet again if a task is repeated.
        step = written(
            open_bins.repartition(width, F.xxhash64("seq")).mapInPandas(
                _pack_level(level, capacity), "seq long, into long, shift long, new_fill long"), "pack-level")
        joined = step.groupBy("into").agg(F.first("new_fill").alias("fill"))
        open_bins = joined.where(F.col("fill") < capacity - NEARLY_FULL).withColumnRenamed("into", "seq")
        if moved is None:
            moved = step.select("seq", "into", "shift")
        else:
            later = step.select(F.col("seq").alias("into"), F.col("into").alias("next"), F.col("shift").alias("more"))
            moved = moved.join(later, "into", "left").select(
                "seq", F.coalesce("next", "into").alias("into"),
                (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
        if width == 1:
            break
    placed = leaves.drop("fill")
    if moved is None:
        return placed.withColumnsRenamed({"seq": "sequence_id", "at": "offset"})
    return placed.join(moved, "seq", "left").select(
        *pieces.columns, F.coalesce("into", "seq").alias("sequence_id"),
        (F.col("at") + F.coalesce("shift", F.lit(0))).alias("offset"))


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut and pack."""
    return pack(written(token_pieces(docs, tokenizer, capacity), "pack-pieces"), capacity)
