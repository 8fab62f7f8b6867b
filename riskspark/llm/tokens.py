"""Token ids of whole texts with public tokenizers, each distinct word of a task encoded once.

Both kinds of tokenizer used here never join a character with a space that
follows it, so a text may be cut before a space: the ids of the parts, joined,
are the ids of the whole. A part is called a word (``" the"``). Words repeat, so
a task looks them up in a table of those it has met; a text is never held as a
list of tokenizer objects, however long it is. A text without spaces is one word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from riskspark.llm.arrays import text_pieces

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"
#: Bytes of words and results that a task keeps before it starts a new table; a word costs some more.
MOST_BYTES, WORD_BYTES = 80 << 20, 160

# Before a space a cut is safe if the character before it is visible ASCII, or if it is no space
# and the next one is surely no white space: visible ASCII or a letter block without any.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_NO_SPACE = _VISIBLE.copy()
_NO_SPACE[0xC3:0xE0] = True
_NO_SPACE[0xE4:0xF5] = True


def tokenizer_file(name: str, folder: str | None = None) -> str:
    """Where a tokenizer's file lies: in ``folder``, else where the installed package has it."""
    if folder is not None:
        return f"{folder.rstrip('/')}/{name}"
    import public_tokenizers
    return public_tokenizers.path(name)


@cache
def byte_bpe(path: str, special_as_text: bool):
    """The byte-level tokenizer; ``special_as_text``: strings of special tokens in a text are plain text."""
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is its share
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = special_as_text
    return tokenizer


@cache
def piece_bpe(path: str):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path)


@cache
def byte_bpe_bytes(path: str) -> list[bytes]:
    """The bytes of each id of the byte-level tokenizer.

    An entry is written with one character per byte: bytes that print stand for
    themselves, the others take the code points from 256 on, in order.
    """
    printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printing)]
    byte_of = {chr(b): b for b in printing} | {chr(256 + k): b for k, b in enumerate(others)}
    vocabulary = byte_bpe(path, True).get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocabulary.values()) + 1)
    for entry, i in vocabulary.items():
        out[i] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
    return out


@cache
def piece_bpe_bytes(path: str) -> list[bytes]:
    """The bytes of each id of the piece tokenizer: U+2581 is a space, ``<0xHH>`` a byte."""
    model = piece_bpe(path)
    return [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i)
            else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size())]


@dataclass
class WordRun:
    """Rows ``lo`` to ``hi`` of a column as words: row k has ``codes[first[k]:first[k + 1]]``,
    positions in the list ``words`` of the distinct ones."""

    lo: int
    hi: int
    words: list[bytes]
    codes: np.ndarray
    first: np.ndarray


def word_runs(column: pa.Array | pa.ChunkedArray, before: str = "", max_bytes: int = 4 << 20) -> Iterator[WordRun]:
    """Cut the texts of a column (null: empty) into words, whole texts of about ``max_bytes`` at a time.
    ``before`` is put before each text that is not empty."""
    if before:
        column, empty = column.cast(pa.large_string()), pa.scalar("", pa.large_string())
        some = pc.greater(pc.binary_length(column), 0)
        column = pc.if_else(some, pc.binary_join_element_wise(pa.scalar(before, pa.large_string()), column, empty), empty)
    for piece in text_pieces(column, max_bytes, separator=0):
        data, n = piece.data, len(piece.data)
        space = np.flatnonzero(data[1:-1] == 32) + 1 if n > 2 else np.empty(0, np.int64)
        prev, following = data[space - 1], data[space + 1] if len(space) else space
        edge = np.zeros(n, bool)
        edge[piece.end] = True
        cut = space[(_VISIBLE[prev] & ~edge[space + 1]) | ((prev != 32) & _NO_SPACE[following])]
        # a text's end (its separator) is a part of its own, left out below
        edge[cut] = True
        edge[piece.start] = True
        starts = np.flatnonzero(edge)
        parts = pa.Array.from_buffers(pa.large_binary(), len(starts), [
            None, pa.py_buffer(np.append(starts, n).astype(np.int64)), pa.py_buffer(data)])
        keep = np.ones(n, bool)
        keep[piece.end] = False
        coded = parts.filter(pa.array(keep[starts])).dictionary_encode()
        starts = starts[keep[starts]]
        first = np.searchsorted(starts, np.append(piece.start, n))
        yield WordRun(piece.lo, piece.hi, coded.dictionary.to_pylist(),
                      coded.indices.to_numpy(zero_copy_only=False), first)


class WordTable:
    """What a task knows about the words it has met; ``make(words)`` gives a list of results
    and their sizes in bytes. Bounded: it starts anew when it is full."""

    def __init__(self, make: Callable[[list[bytes]], tuple[list, int]]):
        self.make, self.known, self.size = make, {}, 0

    def get(self, words: list[bytes]) -> list:
        """The results of ``words`` (distinct), in order."""
        if self.size > MOST_BYTES:
            self.known, self.size = {}, 0
        new = [w for w in words if w not in self.known]
        if new:
            results, size = self.make(new)
            self.known.update(zip(new, results))
            self.size += size + sum(map(len, new)) + WORD_BYTES * len(new)
        return [self.known[w] for w in words]


#: Words that are encoded as one text.
JOINED = 100


@cache
def id_sizes(path: str, of: Callable[[str], list[bytes]]) -> np.ndarray:
    """The bytes of each id."""
    return np.array([len(b) for b in of(path)], np.int64)


def byte_bpe_ids(path: str, words: list[bytes], special_as_text: bool) -> list[np.ndarray]:
    """The ids of each word by the byte-level tokenizer.

    Words that start with a space and a visible character are joined, which the cut rule allows, and encoded
    together; their ids are told apart by their bytes. All others are encoded one by one.
    """
    tokenizer, sizes = byte_bpe(path, special_as_text), id_sizes(path, byte_bpe_bytes)

    def encode(texts):
        return [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    joined, alone = [], []
    for k, w in enumerate(words):
        (joined if len(w) > 1 and w[0] == 32 and w[-1] != 32 and _NO_SPACE[w[1]] else alone).append(k)
    out: list = [None] * len(words)
    parts = [joined[lo:lo + JOINED] for lo in range(0, len(joined), JOINED)]
    for part, ids in zip(parts, encode([b"".join([words[k] for k in part]).decode() for part in parts])):
        ends = np.cumsum(sizes[ids])
        bounds = [0, *(np.searchsorted(ends, np.cumsum([len(words[k]) for k in part])) + 1).tolist()]
        for k, a, b in zip(part, bounds, bounds[1:]):
            out[k] = ids[a:b]
    for k, ids in zip(alone, encode([words[k].decode() for k in alone])):
        out[k] = ids
    return out


def piece_bpe_ids(path: str, words: list[bytes]) -> list[list[int]]:
    """The ids of each word (it starts with a space, which the piece tokenizer adds itself)."""
    return piece_bpe(path).encode([w[1:].decode() for w in words], num_threads=1)
