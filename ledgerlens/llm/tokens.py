"""Problem 7: the corpus as ids of a public byte-level BPE tokenizer."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from ledgerlens.plans.runtime import ship_code, table

#: Folder of the public vocabularies.
TOKENIZERS = os.environ.get("LEDGERLENS_TOKENIZERS", "/opt/tokenizers")
#: Entries that a worker keeps of words and of lines; beyond that it starts anew.
KEPT = 400_000
#: Longest line, in characters, that is kept.
KEPT_LINE = 160

# The public splitting pattern of this vocabulary: contractions, letters, numbers, other marks, blanks. White space is
# spelled out, because the libraries that publish the ids do not count U+001C to U+001F.
BLANK = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_parts = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^{S}{LN}]+|[{S}]+(?![^{S}])|[{S}]+"
ANY_WORD = regex.compile(_parts.replace("{LN}", r"\p{L}\p{N}").replace("{L}", r"\p{L}").replace("{N}", r"\p{N}").replace("{S}", BLANK))
ASCII_WORD = re.compile(_parts.replace("{LN}", "A-Za-z0-9").replace("{L}", "[A-Za-z]").replace("{N}", "[0-9]").replace("{S}", r"\t-\r\x20"))


def printable_bytes() -> dict[str, int]:
    """The characters that stand for bytes in the public file: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class ByteBPE:
    """Exact byte-pair encoding by backtracking from the longest matches.

    Words are bytes mapped to Latin-1, so that the automaton sees one character a byte. A token may follow another if the
    merges, applied to both together, would never join across their border; that is memoised for each pair. The
    encoder takes the longest match, falls back to the next shorter one where the pair is impossible, and gives up a
    position at most once, so a word takes linear time.
    """

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        to_byte = printable_bytes()
        latin = lambda s: "".join(chr(to_byte[c]) for c in s)
        vocab, merges = model["vocab"], model["merges"]
        self.word = {i: latin(s) for s, i in vocab.items() if all(c in to_byte for c in s)}
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        for rank, m in enumerate(merges):
            a, b = m if isinstance(m, list) else m.split(" ")
            i, pair = vocab[a + b], (vocab[a], vocab[b])
            if i not in self.halves:
                self.halves[i], self.rank[i] = pair, rank + 1
            self.joined.setdefault(pair, i)
        reachable = {i: w for i, w in self.word.items() if len(w) == 1 or i in self.halves}
        ids = {w: i for i, w in reachable.items()}
        self.automaton = ahocorasick.Automaton()
        for w, i in ids.items():
            self.automaton.add_word(w, (len(w), i))
        self.automaton.make_automaton()
        self.size = {i: len(w) for i, w in reachable.items()}
        # The next shorter token that begins a token.
        self.shorter = {i: next((ids[w[:n]] for n in range(len(w) - 1, 0, -1) if w[:n] in ids), -1) for i, w in reachable.items()}
        self.allowed: dict[tuple[int, int], bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave a border between the two tokens."""
        pair = (left, right)
        known = self.allowed.get(pair)
        if known is None:
            known = self.allowed[pair] = self._compatible(left, right)
            if len(self.allowed) > 4 * KEPT:
                self.allowed.clear()
        return known

    def _compatible(self, left: int, right: int) -> bool:
        # Walk back in time: undo the later of the two last merges, and see if a merge across the border came earlier.
        rank, joined, halves = self.rank, self.joined, self.halves
        limit = 1 << 60
        while True:
            across = joined.get((left, right))
            if across is not None and rank[across] < limit:
                return False
            at_left, at_right = rank.get(left, 0), rank.get(right, 0)
            if not at_left and not at_right:
                return True
            if at_left > at_right:
                # Merges run from the left, so one across the border of the same rank would come after it.
                limit, left = at_left, halves[left][1]
            else:
                limit, right = at_right + 1, halves[right][0]

    def encode(self, word: str) -> list[int]:
        """Ids of one word given as Latin-1."""
        n = len(word)
        longest = [-1] * n
        for end, (size, i) in self.automaton.iter(word):
            start = end - size + 1
            if longest[start] < 0 or size > self.size[longest[start]]:
                longest[start] = i
        if longest[0] >= 0 and self.size[longest[0]] == n:
            return [longest[0]]
        size, shorter, compatible = self.size, self.shorter, self.compatible
        usable = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + size[token]
            if usable[end] and (not out or compatible(out[-1], token)):
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
                continue
            token_shorter = shorter[token]
            if token_shorter >= 0:
                token = token_shorter
                continue
            usable[at] = 0
            token = out.pop()
            at -= size[token]


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes; keeps words and short lines that come again."""

    def __init__(self, path: str):
        self.bpe = ByteBPE(path)
        self.words: dict[str, bytes] = {}
        self.lines: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        ids = np.array(self.bpe.encode(word.encode("utf-8", "surrogatepass").decode("latin-1")), "<i4").tobytes()
        if len(self.words) >= KEPT:
            self.words.clear()
        if len(word) <= KEPT_LINE:
            self.words[word] = ids
        return ids

    def _line(self, line: str) -> bytes:
        words, one = self.words, self._word
        found = (ASCII_WORD if line.isascii() else ANY_WORD).findall(line)
        return b"".join([words.get(w) or one(w) for w in found])

    def encode(self, text: str) -> bytes:
        # No word crosses from a mark, letter or number into a line feed, so texts are cut there and the pieces kept.
        lines, out, keep = self.lines, [], ""
        for k, line in enumerate(text.split("\n")):
            piece = "\n" + line if k else line
            if keep:
                piece = keep + piece
            if not piece or piece[-1].isspace() or "\x1c" <= piece[-1] <= "\x1f":
                keep = piece
                continue
            keep = ""
            ids = lines.get(piece)
            if ids is None:
                ids = self._line(piece)
                if len(piece) <= KEPT_LINE:
                    if len(lines) >= KEPT:
                        lines.clear()
                    lines[piece] = ids
            out.append(ids)
        if keep:
            out.append(self._line(keep))
        return b"".join(out)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker for a file; made once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def ids_task(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            coded = [enc.encode(t) if t else b"" for t in batch.column(1).to_pylist()]
            ends = np.zeros(len(coded) + 1, "<i4")
            np.cumsum([len(c) // 4 for c in coded], out=ends[1:])
            values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(coded))])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])

    return task


def sizes_task(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            sizes = [len(enc.encode(t)) // 4 if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["doc_id", "tokens"])

    return task


def _path(folder: str | None, name: str) -> str:
    return os.path.join(folder or TOKENIZERS, f"{name}.json")


def encode_documents(documents: DataFrame, tokenizers: str | None = None, name: str = "byte_bpe_50k") -> DataFrame:
    """``(doc_id, ids ARRAY<INT>)`` of whole texts, without special tokens.

    A null or empty text gives an empty list; strings that look like special tokens are ordinary text; repeated rows
    come out as often as they go in; other columns are not read. Unpaired surrogates can't occur in Spark strings.
    No shuffle: one narrow pass over ``doc_id`` and ``text``.
    """
    ship_code(documents.sparkSession)
    return documents.select("doc_id", "text").mapInArrow(ids_task(_path(tokenizers, name)), "doc_id bigint, ids array<int>")


def document_sizes(documents: DataFrame, tokenizers: str | None = None, name: str = "byte_bpe_50k") -> DataFrame:
    """``(doc_id, tokens BIGINT)``; 0 for null and empty texts."""
    ship_code(documents.sparkSession)
    return documents.select("doc_id", "text").mapInArrow(sizes_task(_path(tokenizers, name)), "doc_id bigint, tokens bigint")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as ids of byte_bpe_50k."""
    return encode_documents(table(spark, folder, "documents"))
