"""Token counts by byte-pair merging with a heap and a linked list.

A text is cut where the vocabulary's library cuts it: at the strings of special tokens, each one token, and else into pieces
by the pattern. Within a piece the symbols are a linked list, all adjacent pairs with a rank are in a heap, and the lowest
rank, leftmost first, is popped and merged until none is left. The count is the initial symbols less the merges; no
identifiers are made. Pieces repeat, so each worker keeps the counts of those it has met, up to KEPT bytes of them.
"""

from __future__ import annotations

import json
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, map_batches, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LIMIT = 1024
#: Bytes of pieces, and of words, whose counts a worker keeps (each entry counts ENTRY more); beyond that it starts anew.
KEPT, ENTRY = 48 << 20, 100


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Kept(dict):
    """Counts by string, which hold at most a number of bytes."""

    held = 0

    def keep(self, text: str, n: int) -> int:
        size = len(text) + ENTRY
        if self.held + size > KEPT:
            self.clear()
            self.held = 0
        if size <= KEPT:
            self.held += size
            self[text] = n
        return n


class Counter:
    """Counts the tokens of texts as the vocabulary file's library does."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("only plain byte-level vocabularies are supported")
        self.merge = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self.first = [vocab[c] for _, c in sorted(byte_symbols().items())]
        self.pieces = regex.compile(public_tokenizers.PATTERN)
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(spec["added_tokens"], key=lambda t: -len(t["content"])))) if spec["added_tokens"] else None
        self.known, self.words = Kept(), Kept()

    def piece(self, text: str) -> int:
        """Tokens of one piece."""
        merge = self.merge
        sym = [self.first[b] for b in text.encode()]
        n = count = len(sym)
        if n < 2:
            return n
        left, right = [*range(-1, n - 1)], [*range(1, n + 1)]
        heap = [(m[0], i, sym[i], sym[i + 1], m[1]) for i in range(n - 1) if (m := merge.get((sym[i], sym[i + 1])))]
        heapify(heap)
        while heap:
            _, i, a, b, to = heappop(heap)
            j = right[i]
            if sym[i] != a or j >= n or sym[j] != b:  # the pair is gone since it was pushed
                continue
            sym[i], sym[j] = to, -1
            right[i] = k = right[j]
            count -= 1
            if k < n:
                left[k] = i
                if m := merge.get((to, sym[k])):
                    heappush(heap, (m[0], i, to, sym[k], m[1]))
            if (h := left[i]) >= 0 and (m := merge.get((sym[h], to))):
                heappush(heap, (m[0], h, sym[h], to, m[1]))
        return count

    def _pieces(self, text: str) -> int:
        """Tokens of a text without special strings."""
        total, known = 0, self.known
        for p in self.pieces.findall(text):
            n = known.get(p)
            if n is None:
                n = known.keep(p, self.piece(p))
            total += n
        return total

    def _word(self, word: str) -> int:
        return self.words.keep(word, self._pieces(word))

    def _plain(self, text: str) -> int:
        # Where white space is single spaces and line feeds between other characters, no piece crosses the place before
        # it, so every word with the white space before it can be counted by itself.
        if not text or " ".join(text.split()) != text.replace("\n", " "):
            return self._pieces(text)
        get, total, lines = self.words.get, 0, text.split("\n")
        first = True
        for line in lines:
            head, *rest = line.split(" ")
            if not first:
                total += 1  # the line feed
            first = False
            for w in (head, *[" " + r for r in rest]):
                n = get(w)
                total += self._word(w) if n is None else n
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not (found := self.special.search(text)):
            return self._plain(text)
        parts = self.special.split(text)
        return sum(map(self._plain, parts)) + len(parts) - 1


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row; null and empty texts have none of either. Nothing is shuffled; repeated rows repeat, null ids stay, other columns play no part, an empty table gives no rows."""
    schema = pa.schema([("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches):
        count = counter(vocabulary).count
        for b in batches:
            n = np.fromiter(map(count, b.column(1).to_pylist()), dtype=np.int64, count=b.num_rows)
            made = batch(schema, b.column(2), n, n > limit)
            yield pa.RecordBatch.from_arrays([b.column(0), *made.columns], [id_col, *schema.names])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return map_batches(rows, run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def op4(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))
