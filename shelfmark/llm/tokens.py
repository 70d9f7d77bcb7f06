"""Token ids of whole texts with a public tokenizer, piece by piece.

The byte-level vocabulary never merges across the start of white space that follows a visible
character, so a text can be cut into lines and a line at its spaces. Equal pieces have equal ids,
and each distinct piece is encoded once as long as it stays in the cache. Texts with other runs of
white space (where the cuts would not be safe) are encoded whole. ``tests/llm`` compares with the
encoding of whole texts.
"""

from __future__ import annotations

import os
import re
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import large_text

DEFAULT_FILE = "byte_bpe_50k.json"
CACHED_PIECES = 600_000  # a bound on memory only: pieces that are dropped are encoded again
JOINED_PIECES = 256
PART_BYTES = 8 << 20
# white space other than single spaces, single or double line breaks; and the mark for a line break
_UNSAFE = (r"  | \n|\n |\n\n\n|\n\n\z| \z|[\t\r\f\x0b\x1c-\x1f\x01]|"
           r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


_unsafe = re.compile(_UNSAFE.replace(r"\z", r"\Z").replace(r"\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}",
                     "\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000")).search


def vocabulary_file(name: str = DEFAULT_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary_size(file: str) -> int:
    return worker_encoder(file).tokenizer.get_vocab_size(with_added_tokens=True)


def worker_encoder(file: str) -> PieceEncoder:
    """One encoder for each Python worker and file: later tasks of the worker find its cache filled."""
    kept = sys.modules.setdefault("_shelfmark_worker", types.ModuleType("_shelfmark_worker"))
    encoders = kept.__dict__.setdefault("encoders", {})
    if file not in encoders:
        encoders[file] = PieceEncoder(file)
    return encoders[file]


class PieceEncoder:
    """Encodes batches of texts; ids are little-endian unsigned 32-bit integers as bytes."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)  # ids whose token starts with a space
        self.spaced[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        self.cache: dict[str, bytes] = {}  # the part after the space -> ids of space and part
        self.firsts: dict[str, bytes] = {}  # starts of lines
        self.stops = {c: self.whole(c) for c in ".,"}
        self.newline = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, parts: set[str]) -> None:
        # a full stop or comma after a letter is a piece of its own: only the word before it is looked up
        ended = [p for p in parts if p[-1:] in ".," and p[-2:-1].isalpha()]
        words = parts.difference(ended).union([p[:-1] for p in ended]).difference(self.cache)
        odd = [p for p in words if not p or p[0].isspace()]
        self._encode(list(words.difference(odd)))
        self.cache.update((p, self.whole(" " + p)) for p in odd)
        look = self.cache.__getitem__
        self.cache.update([(p, look(p[:-1]) + self.stops[p[-1]]) for p in ended])

    def _encode(self, words: list[str]) -> None:
        """Many pieces as one text; the tokens that start with a space tell them apart again."""
        groups = [words[i:i + JOINED_PIECES] for i in range(0, len(words), JOINED_PIECES)]
        for start in range(0, len(groups), 64):
            part = groups[start:start + 64]
            coded = self.tokenizer.encode_batch_fast([" " + " ".join(g) for g in part], add_special_tokens=False)
            for group, code in zip(part, coded):
                ids = np.array(code.ids, "<u4")
                at = np.flatnonzero(self.spaced[ids])
                if len(at) != len(group) or at[0] != 0:  # a token of another make: piece by piece
                    self.cache.update((p, self.whole(" " + p)) for p in group)
                    continue
                raw, cut = ids.tobytes(), [*(at * 4).tolist(), 4 * len(ids)]
                self.cache.update(zip(group, [raw[a:b] for a, b in zip(cut, cut[1:])]))

    def _piece(self, piece: str) -> bytes:
        if piece[:1] == "\x01":
            return self.newline + self._first(piece[1:])
        return self.cache[piece]

    def _first(self, word: str) -> bytes:
        if word not in self.firsts:
            self.firsts[word] = self.whole(word)
        return self.firsts[word]

    def _bound(self) -> None:
        if len(self.cache) + len(self.firsts) > CACHED_PIECES:
            self.cache.clear()
            self.firsts.clear()

    def count(self, text: str) -> int:
        """Number of ids of a short text, without the arrays that ``encode`` makes."""
        self._bound()
        if _unsafe(text):
            return len(self.whole(text)) // 4
        first, *rest = text.replace("\n", " \x01").split(" ")
        missing = {p for p in rest if p[:1] != "\x01" and p not in self.cache}
        if missing:
            self._learn(missing)
        return (len(self._first(first)) + sum([len(self._piece(p)) for p in rest])) // 4

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of a column of texts, the same as encoding each whole text; null is empty."""
        if column.nbytes > PART_BYTES and len(column) > 1:  # parts of bounded bytes, to bound memory
            half = len(column) // 2
            (ids, ends), (more, further) = self.encode(column.slice(0, half)), self.encode(column.slice(half))
            return np.concatenate([ids, more]), np.concatenate([ends, further[1:] + ends[-1]])
        self._bound()
        text = large_text(column)
        unsafe = pc.match_substring_regex(text, _UNSAFE)
        marked = pc.replace_substring(pc.if_else(unsafe, "", text), "\n", " \x01")
        pieces = pc.split_pattern(marked, " ")
        bounds = pieces.offsets.to_numpy().astype(np.int64)
        values = pieces.values.slice(bounds[0], bounds[-1] - bounds[0])
        bounds -= bounds[0]
        coded = values.dictionary_encode()
        known = coded.dictionary.to_pylist()
        self._learn({p for p in known if p[:1] != "\x01"}.difference(self.cache))
        entries = [self._piece(p) for p in known]
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # a text's first piece has no space before it; an unsafe text is one piece, encoded whole
        code[bounds[:-1]] = np.arange(len(entries), len(entries) + len(text))
        first = pc.if_else(unsafe, text, values.take(pa.array(bounds[:-1]))).to_pylist()
        entries += [self.whole(f) if whole else self._first(f)
                    for f, whole in zip(first, unsafe.to_numpy(zero_copy_only=False))]
        size = np.fromiter(map(len, entries), np.int64, len(entries)) // 4
        start = np.concatenate([[0], np.cumsum(size)])
        store = np.frombuffer(b"".join(entries), "<u4")
        each = size[code]
        ends = np.concatenate([[0], np.cumsum(each)])
        source = np.repeat(start[code] - ends[:-1], each)
        source += np.arange(len(source))
        return store[source], ends[bounds]
