"""Problem 6: token ids by a public byte-level BPE vocabulary.

A byte string's encoding is a chain in which every two neighbours would also be
encoded as themselves, and every prefix has exactly one valid last token.  So the
encoder keeps, per byte prefix, only that token: the next prefixes follow from it
in time linear in the bytes, an append continues at the end, and an edit starts
again at the edited place.  Texts are first cut by the vocabulary's pattern; every
distinct piece is encoded once per worker.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct pieces, and pairs of tokens, remembered per worker; the memo is emptied beyond it.
MAX_PIECES, MAX_PAIRS = 1_000_000, 2_000_000
#: Pieces of more bytes are encoded each time and not remembered.
LONG_PIECE = 256
#: White space of the Unicode standard (not the same as Python's).
WHITE_SPACE = "\t-\r \x85\xa0  -     　"


def default_vocabulary() -> str:
    """Path of the default vocabulary file."""
    try:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.json")
    except ImportError:
        return "/opt/tokenizers/byte_bpe_50k.json"


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _ranges(letters: str) -> str:
    """A character class for ``re`` of the characters that the property matches."""
    import regex

    found = regex.findall(letters, "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000)))))
    out, begin, last = [], None, None
    for c in map(ord, found):
        if begin is None:
            begin = last = c
        elif c == last + 1:
            last = c
        else:
            out.append((begin, last))
            begin = last = c
    out.append((begin, last))
    return "".join(f"\\U{a:08x}" + (f"-\\U{b:08x}" if b > a else "") for a, b in out)


def piece_pattern() -> re.Pattern:
    """The pattern that cuts a text into pieces."""
    letter, number, space = _ranges(r"\p{L}"), _ranges(r"\p{N}"), WHITE_SPACE
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


class Vocabulary:
    """Tokens, how each was merged, and the memo of pieces."""

    def __init__(self, content: bytes | str):
        model = json.loads(content)["model"]
        letters = _byte_letters()
        vocab, spelled = model["vocab"], {}
        for token, i in vocab.items():
            if all(c in letters for c in token):
                spelled[token] = bytes(map(letters.__getitem__, token))
        self.merges: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left, right, both = vocab[a], vocab[b], vocab[a + b]
            self.merges[left << 20 | right] = both
            self.halves[both] = (left, right)
        #: only single bytes and merged tokens can come out of merging
        self.ids = {spelled[t]: i for t, i in vocab.items() if t in spelled and (i in self.halves or len(spelled[t]) == 1)}
        self.sizes = {i: len(t) for t, i in self.ids.items()}
        self.longest = max(self.sizes.values())
        self.prefixes = {t[:n] for t in self.ids for n in range(1, len(t) + 1)}
        self.pairs: dict[int, bool] = {}
        self.pattern = piece_pattern()
        self.pieces = _Pieces(self)

    def stays(self, left: int, right: int) -> bool:
        """Whether left and right side by side are encoded as just these two."""
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > MAX_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._stays(left, right)
        return known

    def _stays(self, left: int, right: int) -> bool:
        """Undoes the merges of both sides from the latest one back, looking for an earlier one across the border."""
        limit, merges, halves = 1 << 30, self.merges, self.halves
        while True:
            across = merges.get(left << 20 | right)
            if across is not None and across < limit:
                return False
            # of merges equal in rank the left one comes first
            undo_left = left in halves and (left > right or right not in halves)
            if undo_left:
                limit, left = left, halves[left][1]
            elif right in halves:
                limit, right = right + 1, halves[right][0]
            else:
                return True

    def prefix_table(self, data: bytes, last: array | None = None, begin: int = 0) -> array:
        """last[i]: the unique valid last token of data[:i]; entries up to ``begin`` are taken from ``last``.

        Tokens that reach beyond ``begin`` from before it are found again from the longest token's length back.
        """
        n = len(data)
        table = array("i", [-1]) * (n + 1)
        if last is not None and begin:
            table[: begin + 1] = last[: begin + 1]
        ids, prefixes, stays = self.ids, self.prefixes, self.stays
        for j in range(max(0, begin - self.longest) if begin else 0, n):
            before = table[j]
            end = j + 1
            while end <= n and (part := data[j:end]) in prefixes:
                if table[end] < 0 and (t := ids.get(part)) is not None and (j == 0 or stays(before, t)):
                    table[end] = t
                end += 1
        return table

    def walk_back(self, table: array) -> list[int]:
        """The encoding that a prefix table stands for."""
        sizes = self.sizes
        out, i = [], len(table) - 1
        while i > 0:
            t = table[i]
            out.append(t)
            i -= sizes[t]
        out.reverse()
        return out

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.ids.get(data)
        if whole is not None:
            return (whole,)
        return tuple(self.walk_back(self.prefix_table(data)))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; none for a null or empty text."""
        if not text:
            return []
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.pattern.findall(text))))

    def append(self, text: str, ids: list[int], more: str) -> list[int]:
        """Ids of text + more from those of text: only the last pieces are encoded again."""
        cuts = [m.start() for m in self.pattern.finditer(text)]
        if len(cuts) < 3:
            return self.encode(text + more)
        at = cuts[-2]
        if text[at] == " " or text[at].isspace():
            at = cuts[-3]
        gone = sum(len(self.pieces[p]) for p in self.pattern.findall(text, at))
        return ids[: len(ids) - gone] + self.encode(text[at:] + more)

    def edit(self, text: str, ids: list[int], begin: int, end: int, new: str) -> list[int]:
        """Ids after text[begin:end] became ``new``: encodes from before the edit until the pieces fall together again."""
        cuts = [m.start() for m in self.pattern.finditer(text)] + [len(text)]
        first = max(0, sum(c <= begin for c in cuts) - 3)
        changed, shift = text[:begin] + new + text[end:], len(new) - (end - begin)
        old = {c: k for k, c in enumerate(cuts) if c >= end}
        head = list(chain.from_iterable(map(self.pieces.__getitem__, (text[cuts[k] : cuts[k + 1]] for k in range(first)))))
        out, at = head, cuts[first]
        for m in self.pattern.finditer(changed, at):
            if m.start() > begin + len(new) + 1 and (k := old.get(m.start() - shift)) is not None:
                rest = [text[cuts[i] : cuts[i + 1]] for i in range(k, len(cuts) - 1)]
                return out + list(chain.from_iterable(map(self.pieces.__getitem__, rest)))
            out = out + list(self.pieces[m[0]])
        return out


class _Pieces(dict):
    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece):
        ids = self.vocabulary.encode_piece(piece)
        if len(piece) <= LONG_PIECE:
            if len(self) > MAX_PIECES:
                self.clear()
            self[piece] = ids
        return ids


_LOADED: dict[int, Vocabulary] = {}


def loaded(content: bytes) -> Vocabulary:
    """The worker's vocabulary of this file content."""
    key = hash(content)
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(content)
    return _LOADED[key]


def _file(path: str | None) -> bytes:
    path = path or default_vocabulary()
    if os.path.getsize(path) > 64 << 20:
        raise ValueError(f"{path}: a vocabulary file of over 64 MB isn't broadcast")
    with open(path, "rb") as f:
        return f.read()


def token_ids(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids) of each row of ``documents`` (doc_id, text); other columns play no part.

    ``vocabulary`` is the path of a byte-level BPE file (default: the 50k one); its content, under
    64 MB, is broadcast.  Null and empty texts have the empty list; strings of special tokens are
    ordinary text; repeated doc_ids come out each.
    """
    content = documents.sparkSession.sparkContext.broadcast(_file(vocabulary))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = loaded(content.value)
        pieces, find = v.pieces.__getitem__, v.pattern.findall
        for b in batches:
            flat, offsets = array("i"), array("i", [0])
            for text in b.column(1).to_pylist():
                if text:
                    flat.extend(chain.from_iterable(map(pieces, find(text))))
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.Array.from_buffers(pa.int32(), len(offsets), [None, pa.py_buffer(offsets)]), pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)]))
            yield pa.record_batch([b.column(0), ids], names=["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, "doc_id bigint, ids array<int>")


def token_counts(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens): the lengths of ``token_ids`` without the lists; 0 for null and empty texts."""
    content = documents.sparkSession.sparkContext.broadcast(_file(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = loaded(content.value)
        pieces, find = v.pieces.__getitem__, v.pattern.findall
        for b in batches:
            n = [sum(map(len, map(pieces, find(text)))) if text else 0 for text in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, "doc_id bigint, n_tokens bigint")
