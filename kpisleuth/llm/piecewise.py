"""Encoding and decoding with a merge-type piece vocabulary.

A merge vocabulary encodes every text in one way only, and so does it every prefix
of that text.  The encoder keeps one table over the prefixes: the last token of
each.  An automaton over all pieces gives the pieces that end at a place; the one
that belongs there is the one that stays apart from the last token of the prefix
before it when the two are merged on their own.  Exactly one passes.  From the
text's end the table then leads back through all tokens.

A text is cut where no piece can reach across (before a run of word marks, around
characters that no piece holds, between a letter and a sign that follows a letter in
no piece), so words met before are looked up.  Characters outside the vocabulary
become their UTF-8 bytes.

Defined cases: a null text counts as empty and has the begin and end ids alone; rows
with equal or null ids are encoded like any others; an empty table gives no rows;
columns other than the id and the text are ignored; texts of any length are encoded
whole, in time linear in their length.  Null ids decode to a null text.  A vocabulary
without byte pieces is refused; user-defined pieces are not supported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpisleuth.llm.common import worker_memory

MARK = "▁"  # stands for a space
KEPT_WORDS = 300_000  # a memory that is full gives up what was not met since it was last full
KEPT_PAIRS = 300_000
CHUNK_CHARS = 1 << 21
APART = float("-inf")  # the score of two symbols that make no piece
START = -1  # nothing before, or a character that no piece holds

ENCODED = "doc_id long, ids binary"
DECODED = "doc_id long, ids binary, text string"


class Vocabulary:
    """Pieces, their merge order, and the prefix-table encoder."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = model = sentencepiece.SentencePieceProcessor(model_file=path)
        numbers = range(model.get_piece_size())
        if not any(model.is_byte(i) for i in numbers):
            raise ValueError("the vocabulary has no byte pieces")
        merged = [i for i in numbers if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in merged}
        self.byte_id = {int(model.id_to_piece(i)[1:-1], 16): i for i in numbers if model.is_byte(i)}
        self.alphabet = set().union(*self.score)
        # A token is a piece, or a character that only occurs inside pieces.
        self.tokens = list(self.score) + sorted(self.alphabet - set(self.score))
        self.number = {token: n for n, token in enumerate(self.tokens)}
        self.code = [self._packed([i]) for i in merged] + [self._bytes(t) for t in self.tokens[len(merged):]]
        self.automaton = ahocorasick.Automaton()
        for token, n in self.number.items():
            self.automaton.add_word(token, (n, len(token)))
        self.automaton.make_automaton()
        self.lengths = [len(token) for token in self.tokens]
        self.longest = max(self.lengths)
        self.stretches = self._stretches()
        self.first, self.last = self._packed([model.bos_id()]), self._packed([model.eos_id()])
        self.words, self.older_words = {}, {}
        self.pairs, self.older_pairs = {}, {}

    def _stretches(self):
        """Splits a text at places where no piece reaches across."""
        if any(re.search(f"[^{MARK}]{MARK}", token) for token in self.tokens):
            return re.compile(r"(?s).+").findall
        ascii_ = list(map(chr, range(128)))
        letters = "a-zA-Z"
        foreign = "".join(re.escape(c) for c in ascii_ if c not in self.alphabet)
        behind = {b for token in self.tokens for a, b in zip(token, token[1:], strict=False) if a.isascii() and a.isalpha()}
        signs = "".join(re.escape(c) for c in ascii_ if c in self.alphabet and not c.isalpha() and c not in behind)
        other = f"[^{MARK}{foreign}{letters}]*"
        # Letters go on to a character that is no such sign, and that to more letters.
        text = f"{MARK}*{other}(?:[{letters}]+(?:[^{MARK}{foreign}{letters}{signs}]{other})?)*"
        return re.compile(f"[{foreign}]|{text}" if foreign else text).findall

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return np.asarray(ids, dtype="<u4").tobytes()

    def _bytes(self, character: str) -> bytes:
        return self._packed([self.byte_id[b] for b in character.encode("utf-8")])

    def merge(self, text: str) -> list[str]:
        """Tokens of a short text by its definition: best score first, leftmost of equal ones."""
        symbols, score = list(text), self.score
        gains = [score.get(a + b, APART) for a, b in zip(symbols, symbols[1:], strict=False)]
        while gains and (best := max(gains)) != APART:
            at = gains.index(best)
            symbols[at: at + 2] = [symbols[at] + symbols[at + 1]]
            del gains[at]
            if at:
                gains[at - 1] = score.get(symbols[at - 1] + symbols[at], APART)
            if at < len(gains):
                gains[at] = score.get(symbols[at] + symbols[at + 1], APART)
        return symbols

    def compatible(self, before: int, token: int) -> bool:
        """Whether the two stay apart, or the token stays whole where nothing is before it."""
        key = (before + 1) * len(self.tokens) + token
        known = self.older_pairs.get(key)
        if known is None:
            parts = [self.tokens[token]] if before == START else [self.tokens[before], self.tokens[token]]
            known = self.merge("".join(parts)) == parts
        if len(self.pairs) >= KEPT_PAIRS:
            self.older_pairs, self.pairs = self.pairs, {}
        self.pairs[key] = known
        return known

    def extend(self, table: list[int], known: int, stretch: str) -> list[int]:
        """For each length of ``stretch``, the last token of that prefix (``START`` behind a foreign character).

        ``table`` holds the first ``known`` lengths already; they are those of a
        stretch with the same beginning.
        """
        table = table[: known + 1] + [None] * (len(stretch) - known)
        if not self.alphabet.issuperset(stretch):
            for i, character in enumerate(stretch, 1):
                if character not in self.alphabet:
                    table[i] = START
        size, pairs = len(self.tokens), self.pairs
        for end, (token, length) in self.automaton.iter(stretch, max(0, known + 1 - self.longest)):
            if table[end + 1] is None:
                before = table[end + 1 - length]
                apart = pairs.get((before + 1) * size + token)
                if self.compatible(before, token) if apart is None else apart:
                    table[end + 1] = token
        return table

    def recover(self, table: list[int], stretch: str) -> bytes:
        """The ids of the whole stretch, from its end backwards."""
        at, out = len(stretch), []
        while at:
            token = table[at]
            if token == START:
                at -= 1
                out.append(self._bytes(stretch[at]))
            else:
                out.append(self.code[token])
                at -= self.lengths[token]
        out.reverse()
        return b"".join(out)

    def learn(self, words: set[str]) -> None:
        """Encode words; in their order each shares the table of the beginning it has in common with the last."""
        if len(self.words) + len(words) > KEPT_WORDS:
            self.older_words, self.words = self.words, {}
        known, older = self.words, self.older_words
        table, last = [START], ""
        for word in sorted(words - known.keys()):
            coded = older.get(word)
            if coded is None:
                shared = len(commonprefix((last, word)))
                table, last = self.extend(table, shared, word), word
                coded = self.recover(table, word)
            known[word] = coded

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text, with the begin and end ids."""
        split = [self.stretches(self.library.normalize(text)) for text in texts]
        self.learn(set().union(*split))
        known = self.words
        for words in split:
            yield b"".join([self.first, *[known[w] for w in words], self.last])

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, dtype="<u4").tolist())


def vocabulary(path: str) -> Vocabulary:
    return worker_memory(f"pieces:{path}", lambda: Vocabulary(path))


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose sizes together stay near ``CHUNK_CHARS``."""
    first, held = 0, 0
    for i, size in enumerate(sizes):
        held += size
        if held >= CHUNK_CHARS:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(sizes):
        yield first, len(sizes)


def encoded(docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of every whole text as little-endian unsigned 32-bit integers, begin and end included."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces, texts = vocabulary(model), batch.column(1).fill_null("").to_pylist()
            for first, last in _slices([len(t) for t in texts]):
                ids = list(pieces.encode(texts[first:last]))
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, ENCODED)


def decoded(codes: DataFrame, model: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """(doc_id, ids, text): what the ids spell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces, codes = vocabulary(model), batch.column(1).to_pylist()
            for first, last in _slices([len(c or b"") for c in codes]):
                texts = [None if c is None else pieces.decode(c) for c in codes[first:last]]
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], batch.column(1)[first:last], pa.array(texts, pa.string())],
                                                 ["doc_id", "ids", "text"])

    return codes.select(F.col(id_column).cast("long").alias("doc_id"), F.col(ids_column).cast("binary").alias("ids")).mapInArrow(run, DECODED)
