"""Token identifiers of texts as the tokenizers library gives them: Arrow cuts texts into words, of which each is looked up once a piece in a cache."""

from __future__ import annotations

import json
import re
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .token_counts import byte_symbols

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Bytes of words whose identifiers a worker keeps in each of two generations; each entry counts ENTRY more, for its objects.
KEPT, ENTRY = 150 << 20, 140
#: A longer word is not kept: texts without spaces are one word.
LONGEST = 1000
#: Bytes of texts that are cut into words at a time; a longer text is by itself.
PIECE = 4 << 20

_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SYMBOLS = {i: c for i, c in byte_symbols().items() if chr(i) != c and i != 10}
_SPACE = byte_symbols()[32]
#: White space other than single spaces and line feeds between other characters.
_WIDE = "[" + "".join(f"\\x{{{c:x}}}" for c in range(0x110000) if chr(c).isspace() and chr(c) not in " \n") + r"]|[ \n][ \n]|\A[ \n]|[ \n]\z"


class _Words(dict):
    """Identifiers by word; a word that isn't there is taken from the generation before, or asked of its owner."""

    def __init__(self, owner: Encoder, before: dict[bytes, bytes]):
        self.owner, self.before, self.held = owner, before, 0

    def __missing__(self, word: bytes) -> bytes:
        if len(word) > LONGEST:
            return self.owner.learned(word)
        found = self.before.pop(word, None)
        if found is None:
            found = self.owner.learned(word)
        self.held += len(word) + len(found) + ENTRY
        self[word] = found
        return found


class Encoder:
    """encode(texts) gives each text's identifiers as little-endian bytes of dtype, without added special tokens.

    Byte-level pieces never cross the place before a single white space, so where a text's white space is only single
    spaces and line feeds between other characters, it is cut there and every word met before comes from the cache. New words of
    letters and marks go to the library's model, other words and texts to the library as they are.
    """

    def __init__(self, path: str = VOCABULARY):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.cuts = spec["normalizer"] is None and pre["type"] == "ByteLevel" and not pre["add_prefix_space"] and not any(t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
        #: What keeps a text from being cut.
        self.uncut = "|".join([_WIDE, *(re.escape(t["content"]) for t in spec["added_tokens"])]) if self.cuts else ""
        self.model = self.library.model
        self.raw = [np.array([i], dtype=self.dtype).tobytes() for i in range(self.library.get_vocab_size())]
        self.line = self._whole("\n")
        self.marks: dict[bytes, bytes] = {}
        self.known = _Words(self, {})

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def learned(self, w: bytes) -> bytes:
        """A word stands for itself after a space, or after a line feed where it begins with one."""
        if w.isalpha():  # letters of ASCII
            return b"".join([self.raw[t.id] for t in self.model.tokenize(_SPACE + w.decode())])
        line, stem = w[:1] == b"\n", w.rstrip(_MARKS)
        letters = stem[1:] if line else stem
        if not (letters.isalpha() or letters.decode().isalpha()):
            return self._whole((w if line else b" " + w).decode())
        if len(stem) == len(w):
            # A space is part of the piece; a line feed is one by itself. The model takes byte symbols.
            symbols = letters.decode() if letters.isascii() else letters.decode("latin-1").translate(_SYMBOLS)
            ids = b"".join([self.raw[t.id] for t in self.model.tokenize(symbols if line else _SPACE + symbols)])
            return self.line + ids if line else ids
        # Letters and nothing else, then marks: two pieces, of which only the first begins with the space.
        tail = w[len(stem) :]
        if (end := self.marks.get(tail)) is None:
            end = self._whole(tail.decode())
            if len(tail) <= LONGEST and len(self.marks) < 100_000:
                self.marks[tail] = end
        return self.known[stem] + end

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        column = pc.fill_null((texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).cast(pa.large_string()), "")
        pieces = np.cumsum(pc.binary_length(column).to_numpy()) // PIECE
        bounds = [0, *(np.flatnonzero(np.diff(pieces)) + 1).tolist(), len(column)]
        return [ids for a, b in pairwise(bounds) for ids in self._encoded(column.slice(a, b - a))]

    def _encoded(self, column: pa.LargeStringArray) -> list[bytes]:
        if self.known.held > KEPT:
            self.known = _Words(self, dict(self.known))
            self.marks.clear()
        out: list = [b""] * len(column)
        uncut = pc.match_substring_regex(column, self.uncut).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(uncut).tolist():
            out[i] = self._whole(column[i].as_py())
        cut = np.flatnonzero(~uncut)
        if len(cut):
            # A line feed before each text makes its first word one of a line; its identifier is left out again.
            lines = pc.replace_substring(column.take(pa.array(cut)), "\n", " \n")
            words = pc.split_pattern(pc.binary_join_element_wise(pa.scalar("\n", column.type), lines, pa.scalar("", column.type)), " ")
            coded = words.values.dictionary_encode()
            each = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
            ids = pa.array(map(self.known.__getitem__, each), pa.large_binary(), size=len(each)).take(coded.indices)
            _, places, raw = ids.buffers()
            ends, raw = np.frombuffer(places, dtype=np.int64)[words.offsets.to_numpy()].tolist(), raw.to_pybytes()
            for i, (a, b) in zip(cut.tolist(), pairwise(ends)):
                out[i] = raw[a + len(self.line) : b]
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
