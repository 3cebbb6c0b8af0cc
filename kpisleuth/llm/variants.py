"""Spelling variants of words, found by blocked Gram matrices of letter counts.

Words one edit apart have letter counts at a squared distance of at most two, and
lengths at most one apart.  Words are laid in cells by how many of their letters fall
in each of ``GROUPS`` fixed groups of letters; the counts of a cell add up to a length,
so a cell is a part of one length block, and a word one edit away lies in the same
cell, in one with a letter moved to another group, or in one with a letter more.  Each
cell is cut into blocks of bounded size.  For every two blocks of such neighbouring
cells NumPy multiplies their letter-count matrices, which gives all squared distances;
what is at most two apart is verified letter by letter.

A word's form is its near word met most often, if that is met at least twice as often;
forms lead on to a root, found by pointer doubling.

Words and their counts come from all texts: every task adds up its own before the
shuffle.  Blocks are met by an equi-join on (cell, block), so no task holds more than
two blocks at a time, whatever the size of a cell.

Defined cases: a null text has no words; a null id is written as an empty one; rows
with equal ids are read like any others, so a repeated row counts twice; an empty table
gives no rows; columns other than the id and the text are ignored; runs of any length
are words (long ones fill a block alone).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpisleuth.llm.common import written

MISSPELT_EVERY = 97
SHORTEST = 5
FEWEST = 3
FACTOR = 2

FREQUENT_FIRST = "etaoinshrdlucmfwygpbvkxjqz"  # so that the groups are met about equally often
GROUPS = 6
BLOCK_WORDS = 1024
BLOCK_LETTERS = 1 << 20
BATCH_WORDS = 1 << 15
KEPT_COUNTS = 300_000
LETTERS = 26 + 64  # a to z, U+00C0 to U+00FF

RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")


def _deleted(run: bytes, at: int) -> bytes:
    word = run.decode("utf-8")
    at %= len(word)
    return (word[:at] + word[at + 1:]).encode("utf-8")


def word_counts(docs: DataFrame, misspelt_every: int = MISSPELT_EVERY, shortest: int = SHORTEST, fewest: int = FEWEST,
                id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word, n): lower-cased runs of letters of all texts, some of them with a letter left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Counter[bytes] = Counter()

        def drained() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(totals), pa.binary()).cast(pa.string()), pa.array(list(totals.values()), pa.int64())],
                                             ["word", "n"])
            totals.clear()
            return out

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for i, doc in enumerate(batch.column(0).to_pylist()):
                head = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in Counter(RUN.findall((texts[i].as_py() or b"").lower())).items():
                    if len(word) < shortest:
                        continue
                    mark = zlib.crc32(word, head)
                    if mark % misspelt_every == 0:
                        word = _deleted(word, mark)
                    if len(word) - word.count(b"\xc3") >= shortest:
                        totals[word] += n
                if len(totals) > KEPT_COUNTS:
                    yield drained()
        yield drained()

    frame = docs.select(F.col(id_column).cast("string").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return frame.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest)


def cell_of(word: Column) -> Column:
    """How many letters of the word fall in each group."""
    groups = ["".join(FREQUENT_FIRST[g::GROUPS]) + "".join(chr(c) for c in range(0xC0, 0x100) if c % GROUPS == g) for g in range(GROUPS)]
    return F.array(*[(F.length(word) - F.length(F.translate(word, letters, ""))).cast("int") for letters in groups])


def _moves() -> list[list[int]]:
    """Steps from a cell to itself and to its neighbours, one of each two opposite steps."""
    unit = np.eye(GROUPS, dtype=int)
    return [[0] * GROUPS, *unit.tolist(), *[(unit[g] - unit[h]).tolist() for g in range(GROUPS) for h in range(g)]]


class Letters:
    """Letters, lengths and letter counts of many words at once."""

    def __init__(self, words: pa.Array):
        words = words.cast(pa.large_binary())
        _, offsets, data = words.buffers()
        offsets = np.frombuffer(offsets, np.int64)[words.offset: words.offset + len(words) + 1]
        data = np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]]
        single = data != 0xC3  # the first byte of two
        self.starts = np.concatenate(([0], np.cumsum(single)))[offsets - offsets[0]]
        data = data[single]
        self.letters = np.where(data < 0x80, data - ord("a"), data - (0x80 - 26)).astype(np.int64)
        owner = np.repeat(np.arange(len(words)), np.diff(self.starts))
        counts = np.bincount(owner * LETTERS + self.letters, minlength=len(words) * LETTERS).reshape(-1, LETTERS)
        exact = np.float32 if np.diff(self.starts).max(initial=0) < 2048 else np.float64
        self.counts = counts[:, counts.any(axis=0)].astype(exact)
        self.squares = np.einsum("nc,nc->n", self.counts, self.counts)

    def spelt(self, first: int, last: int) -> np.ndarray:
        """Words of one length as rows of letters."""
        return self.letters[self.starts[first]: self.starts[last]].reshape(last - first, -1)


def _edited(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of ``a`` that become those of ``b`` by one replaced or one inserted letter."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    ahead, behind = a == b[:, :-1], (a == b[:, 1:])[:, ::-1]
    n = a.shape[1]
    head = np.where(ahead.all(axis=1), n, ahead.argmin(axis=1))
    tail = np.where(behind.all(axis=1), n, behind.argmin(axis=1))
    return head + tail >= n


def near_in_blocks(left: Letters, right: Letters, a: tuple[int, int], b: tuple[int, int], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of near words of two blocks."""
    gram = left.counts[a[0]: a[1]] @ right.counts[b[0]: b[1]].T
    squared = left.squares[a[0]: a[1], None] + right.squares[None, b[0]: b[1]] - 2 * gram
    i, j = np.nonzero(squared <= 2)
    if same:
        i, j = i[i < j], j[i < j]
    kept = _edited(left.spelt(*a)[i], right.spelt(*b)[j])
    return a[0] + i[kept], b[0] + j[kept]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        same, sides = batch.column(0).to_pylist(), [batch.column(1), batch.column(2)]
        at = [np.concatenate(([0], np.cumsum(s.value_lengths().to_numpy(zero_copy_only=False)))) for s in sides]
        held, first = at[0] + at[1], 0
        while first < len(same):
            last = max(first + 1, int(np.searchsorted(held, held[first] + BATCH_WORDS, side="right")) - 1)
            flat = [s.slice(first, last - first).flatten() for s in sides]
            words = [f.field("word") for f in flat]
            together = Letters(pa.concat_arrays(words))
            shift = len(words[0])
            hits = []
            for row in range(first, last):
                a = tuple(at[0][row: row + 2] - at[0][first])
                b = tuple(at[1][row: row + 2] - at[1][first] + shift)
                hits.append(near_in_blocks(together, together, a, b, same[row]))
            i, j = (pa.array(np.concatenate(side)) for side in zip(*hits, strict=True))
            both, n = pa.concat_arrays(words), pa.concat_arrays([f.field("n") for f in flat])
            yield pa.RecordBatch.from_arrays([both.take(i), n.take(i), both.take(j), n.take(j)], ["word", "n", "near", "near_n"])
            first = last


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n) of every two words one edit apart, once each."""
    placed = words.withColumn("cell", cell_of(F.col("word")))
    size = F.least(F.lit(BLOCK_WORDS), F.greatest(F.lit(1), F.floor(F.lit(BLOCK_LETTERS) / F.length("word"))))
    cells = written(placed.groupBy("cell").agg(F.ceil(F.count("*") / F.min(size)).cast("int").alias("blocks")), "variant-cells")
    blocks = written(placed.join(cells, "cell").withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")).groupBy(
        "cell", "block").agg(F.collect_list(F.struct("word", "n")).alias("words")), "variant-blocks")
    moves = F.array(*[F.array(*map(F.lit, m)) for m in _moves()])
    asked = blocks.select("cell", "block", F.col("words").alias("left"), F.explode(moves).alias("move")).withColumn(
        "to_cell", F.zip_with("cell", "move", lambda c, m: c + m))
    met = asked.join(cells.withColumnRenamed("cell", "to_cell"), "to_cell").withColumn(
        "to_block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where(
        (F.col("cell") != F.col("to_cell")) | (F.col("block") <= F.col("to_block")))
    other = blocks.select(F.col("cell").alias("to_cell"), F.col("block").alias("to_block"), F.col("words").alias("right"))
    same = (F.col("cell") == F.col("to_cell")) & (F.col("block") == F.col("to_block"))
    return met.join(other, ["to_cell", "to_block"]).select(same.alias("same"), "left", "right").mapInArrow(
        _near, "word string, n long, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: each round doubles the steps that are followed."""
    found = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("changed")), "variant-roots")
    while not found.where("changed").isEmpty():
        ahead = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        found = written(found.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("changed")), "variant-roots")
    return found.select("word", "root")


def grouped(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    words = words.select("word", "n")
    near = near_words(words)
    both = F.array(F.struct("word", F.col("near").alias("other"), F.col("near_n").alias("other_n")),
                   F.struct(F.col("near").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = near.select(F.inline(both)).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("rank"), F.col("other"))).alias("best"))
    frequent = -F.col("best.rank") >= factor * F.col("n")
    told = written(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(frequent, F.col("best.other")).alias("form"), F.when(frequent, -F.col("best.rank")).alias("form_n")), "variant-forms")
    return told.join(roots(told.where("form IS NOT NULL")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, misspelt_every: int = MISSPELT_EVERY, shortest: int = SHORTEST, fewest: int = FEWEST,
             factor: int = FACTOR, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    return grouped(written(word_counts(docs, misspelt_every, shortest, fewest, id_column, text_column), "variant-words"), factor)


def variants_sql() -> str:
    """The same with a crc32 of its own, and near words by what is left without one letter."""
    return f"""WITH RECURSIVE
crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]),
         lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS t),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc,
         unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS raw FROM documents),
met AS MATERIALIZED (
  SELECT doc, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs
  GROUP BY 1, 2 HAVING length(run) >= {SHORTEST}),
marked AS MATERIALIZED (
  SELECT run, n, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT,
         list_transform(range(1, strlen(doc || ':' || run) + 1), lambda i: ('0x' || substr(hex(doc || ':' || run), (2 * i - 1)::BIGINT, 2))::UBIGINT)),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1]))) AS h
  FROM met, crc_table),
spelt AS (
  SELECT CASE WHEN h % {MISSPELT_EVERY} = 0
              THEN substr(run, 1, (h % length(run)::UBIGINT)::BIGINT) || substr(run, (h % length(run)::UBIGINT)::BIGINT + 2) ELSE run END AS word, n
  FROM marked),
words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(n) >= {FEWEST}),
shorter AS MATERIALIZED (
  SELECT word, n, place, substr(word, 1, place - 1) || substr(word, place + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS place FROM words)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n AS other_n FROM shorter a JOIN shorter b ON a.place = b.place AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM shorter a JOIN words b ON b.word = a.rest
  UNION SELECT b.word, a.word, a.n FROM shorter a JOIN words b ON b.word = a.rest),
best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
told AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.other_n >= {FACTOR} * w.n THEN b.other END AS form,
         CASE WHEN b.other_n >= {FACTOR} * w.n THEN b.other_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
chain AS (
  SELECT word, form AS reached, 1 AS steps FROM told WHERE form IS NOT NULL
  UNION ALL SELECT c.word, t.form, c.steps + 1 FROM chain c JOIN told t ON t.word = c.reached WHERE t.form IS NOT NULL),
last AS (SELECT word, arg_max(reached, steps) AS root FROM chain GROUP BY word)
SELECT t.word, t.form, coalesce(l.root, t.word) AS root, t.n, t.n_near, t.form_n FROM told t LEFT JOIN last l USING (word)"""
