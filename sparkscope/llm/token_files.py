"""Token identifiers in binary files, compressed by a Re-Pair grammar for each shard.

Documents are tokenised where they lie; the identifiers, not the texts, are range-sorted by doc_id and written as shards of
about SHARD_TOKENS tokens. In a shard frequent pairs of adjacent symbols are replaced by new symbols, again and again, until no
pair is left that occurs LEAST_USES times; pairs never cross the end of a document. The file stores the shard's distinct
identifiers, which are its first symbols, the rules, the expanded length of each, the symbols, and for each document where its
symbols and its tokens begin, so that one document is decoded from its own symbols and the rules they name. Shards get their
names only when complete; a written manifest lists them.

File: magic, the header's length (4 bytes, little-endian), the header in JSON (dtype and counts), then arrays in this order:
identifiers, rules (two symbols each), expanded lengths, doc_ids, flags of null doc_ids, first symbols, first tokens, symbols.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, map_batches, table
from .encode import VOCABULARY, encoder
from .files import committed, made_dir, read_bytes
from .packing import part_starts, tokenised

MAGIC = b"RPTK"
END_ID = 2
SHARD_TOKENS = 500_000
#: Uses from which a rule is shorter than what it replaces.
LEAST_USES = 5
#: Shards that a task writes or reads, one after the other, once there are tasks enough for all cores.
SHARDS_A_TASK = 8
#: While a round shortens the symbols by this share, rounds run over all of them.
MUCH = 0.04
_BITS = 17


def _half(kind) -> np.integer:
    return kind(4 * np.dtype(kind).itemsize)


def repair(symbols: np.ndarray, last: np.ndarray, base: int, least: int = LEAST_USES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, last, rules): last marks the final symbol of each document; symbols are below base, new ones count from it.

    A round counts pairs and replaces, of the frequent ones, every occurrence that overlaps with none of a more frequent pair.
    First rounds run over all symbols. Then the symbols are a linked list, and a round looks only at pairs that may still be
    frequent: pairs of old symbols only get rarer, so a rare one is looked at again only where a new symbol appears. The rounds
    end when no pair has `least` occurrences that don't overlap.
    """
    seq, last, rules = _dense_rounds(symbols.astype(np.uint32), last, base, least)
    n = len(seq)
    seq, last = np.append(seq, np.uint32(0)), np.append(last, True)
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    before[0] = n
    alive, open_, weight = np.ones(n, dtype=bool), ~last, np.zeros(n + 2, dtype=np.int64)
    n_rules, rounds = sum(map(len, rules)), 1000
    while True:
        rounds += 1
        live = np.flatnonzero(open_).astype(np.int32)
        kind = np.uint32 if base + n_rules <= 1 << 16 else np.uint64
        keys = seq[live].astype(kind, copy=False) << _half(kind)
        keys |= seq[after[live]]
        slot = _slots(keys, rounds)
        kept = (np.bincount(slot, minlength=1 << _BITS) >= least)[slot]
        live, keys, slot = live[kept], keys[kept], slot[kept]
        open_[:] = False
        open_[live] = True
        apart = _apart(live, keys, after[live])
        # One pair for each hash; others with the same hash wait, as the next round's hash parts them.
        pairs = np.zeros(1 << _BITS, dtype=kind)
        pairs[slot] = keys
        ok = (pairs[slot] == keys) & apart
        at, of = live[ok], slot[ok]
        uses = np.bincount(of, minlength=1 << _BITS)
        if uses.max() < least:
            pairs, of = np.unique(keys[apart], return_inverse=True)
            at, uses = live[apart], np.bincount(of)
            if uses.max(initial=0) < least:
                break
        own = _ranks(uses, least)[of]
        at, of, own = at[own > 0], of[own > 0], own[own > 0]
        weight[at] = own
        first = (weight[after[at]] <= own) & (weight[before[at]] <= own)
        weight[at] = 0
        at, of, made = _numbered(at[first], of[first], pairs, least)
        rules.append(made)
        gone = after[at]
        seq[at] = base + n_rules + of
        last[at], after[at] = last[gone], after[gone]
        before[after[at]] = at
        alive[gone] = open_[gone] = False
        open_[at] = ~last[at]
        open_[before[at]] = ~last[before[at]]
        n_rules += len(made)
    return seq[:n][alive], last[:n][alive], np.concatenate(rules) if rules else np.zeros((0, 2), dtype=np.uint32)


def _dense_rounds(seq: np.ndarray, last: np.ndarray, base: int, least: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(symbols, last, rules) after the rounds that shorten the symbols much."""
    rules, n_rules, rounds = [], 0, 0
    while len(seq) > 1:
        rounds += 1
        kind = np.uint32 if base + n_rules <= 1 << 16 else np.uint64
        keys = seq[:-1].astype(kind, copy=False) << _half(kind)
        keys |= seq[1:]
        slot = _slots(keys, rounds)
        pairs = np.zeros(1 << _BITS, dtype=kind)
        pairs[slot] = keys
        own = _ranks(np.bincount(slot, minlength=1 << _BITS), least)[slot]
        own[last[:-1] | (pairs[slot] != keys)] = 0
        doubled = np.flatnonzero(seq[:-1] == seq[1:])
        doubled = doubled[own[doubled] > 0]
        own[doubled[~_apart(doubled, keys[doubled], doubled + 1)]] = 0
        first = own > 0
        first[1:] &= own[1:] >= own[:-1]
        first[:-1] &= own[:-1] >= own[1:]
        at = np.flatnonzero(first)
        at, of, made = _numbered(at, slot[at], pairs, least)
        if not len(made):
            break
        rules.append(made)
        seq[at] = base + n_rules + of
        last = last.copy() if rounds == 1 else last
        last[at] = last[at + 1]
        keep = np.ones(len(seq), dtype=bool)
        keep[at + 1] = False
        seq, last, n_rules = seq[keep], last[keep], n_rules + len(made)
        if len(at) < MUCH * len(seq):
            break
    return seq, last, rules


def _ranks(uses: np.ndarray, least: int) -> np.ndarray:
    """Different numbers that grow with the uses, for those that reach least; 0 for the others."""
    ranks, good = np.zeros(len(uses), dtype=np.int64), np.flatnonzero(uses >= least)
    ranks[good] = uses[good] * len(uses) + good
    return ranks


def _numbered(at: np.ndarray, of: np.ndarray, pairs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, number of each place's rule, rules) of the pairs with at least that many places; of names pairs."""
    good = np.flatnonzero(np.bincount(of, minlength=len(pairs)) >= least)
    number = np.full(len(pairs), -1, dtype=np.int32)
    number[good] = np.arange(len(good), dtype=np.int32)
    of = number[of]
    enough = of >= 0
    made, kind = pairs[good], pairs.dtype.type
    return at[enough], of[enough], np.stack((made >> _half(kind), made & kind((1 << int(_half(kind))) - 1)), axis=1).astype(np.uint32)


def _slots(keys: np.ndarray, rounds: int) -> np.ndarray:
    """A hash of each pair, another one every round."""
    kind, bits = keys.dtype.type, 8 * keys.dtype.itemsize
    factor = ((0x9E3779B97F4A7C15 >> 64 - bits) + 2 * 0x5851F42D * rounds | 1) & (1 << bits) - 1
    return ((keys * kind(factor)) >> kind(bits - _BITS)).astype(np.intp)


def _apart(at: np.ndarray, keys: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Marks of the occurrences that count: of those of a doubled symbol that overlap every other one, from the first. after: the place behind each."""
    ok, half = np.ones(len(at), dtype=bool), _half(keys.dtype.type)
    doubled = np.flatnonzero(keys >> half == keys & keys.dtype.type((1 << int(half)) - 1))
    if len(doubled):
        p = at[doubled]
        starts = np.flatnonzero(np.concatenate(([True], after[doubled[:-1]] != p[1:])))
        ok[doubled] = (np.arange(len(p)) - np.repeat(starts, np.diff(np.append(starts, len(p))))) % 2 == 0
    return ok


def lengths_of(rules: np.ndarray, base: int) -> np.ndarray:
    """Tokens that each rule stands for."""
    out, (left, right) = np.zeros(len(rules), dtype=np.int64), rules.T.astype(np.int64) - base
    length = lambda s: np.where(s < 0, 1, out[np.maximum(s, 0)])
    while len(todo := np.flatnonzero(out == 0)):  # a rule names earlier rules only, so each pass settles some
        a, b = length(left[todo]), length(right[todo])
        ready = (a > 0) & (b > 0)
        if not ready.any():
            raise ValueError("the rules name each other in a circle")
        out[todo[ready]] = (a + b)[ready]
    return out.astype(np.uint32)


def unfolded(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The first symbols that symbols stand for: all rules among them are replaced at once, a level at a time. Only rules that they name are read."""
    flat = symbols.astype(np.uint32)
    while (folded := flat >= base).any():
        ends = np.cumsum(1 + folded)
        wider, at = np.empty(int(ends[-1]), dtype=np.uint32), ends[folded] - 2
        wider[ends[~folded] - 1] = flat[~folded]
        pair = rules[flat[folded] - base]
        wider[at], wider[at + 1] = pair[:, 0], pair[:, 1]
        flat = wider
    return flat


def expand(symbols: np.ndarray, rules: np.ndarray, base: int, lengths: np.ndarray | None = None, identifiers: np.ndarray | None = None) -> np.ndarray:
    """As unfolded, for many symbols: what each symbol stands for is laid out once, as identifiers if given, and then copied."""
    lengths = lengths_of(rules, base) if lengths is None else lengths
    first = np.arange(base, dtype=np.uint32) if identifiers is None else identifiers
    flat = np.concatenate((first, first[unfolded(np.arange(base, base + len(rules), dtype=np.uint32), rules, base)]))
    size = np.concatenate((np.ones(base, dtype=np.int32), lengths.astype(np.int32)))
    places = np.concatenate(([0], np.cumsum(size, dtype=np.int64) * flat.itemsize))
    each = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(places), pa.py_buffer(flat)])
    _, places, raw = each.take(pa.array(symbols)).buffers()
    return np.frombuffer(raw, dtype=flat.dtype, count=int(np.frombuffer(places, dtype=np.int64)[len(symbols)]) // flat.itemsize)


def shard_bytes(docs: list[tuple[int | None, np.ndarray]], vocabulary: int) -> tuple[bytes, dict]:
    """The file of some (doc_id, tokens below vocabulary), each with at least one token, and its counts."""
    n_tokens = np.array([len(t) for _, t in docs], dtype=np.int64)
    last = np.zeros(int(n_tokens.sum()), dtype=bool)
    last[np.cumsum(n_tokens) - 1] = True
    tokens = np.concatenate([t for _, t in docs])
    used = np.zeros(vocabulary, dtype=bool)
    used[tokens] = True
    identifiers, symbol = np.flatnonzero(used), (np.cumsum(used) - 1).astype(np.uint32)
    seq, last, rules = repair(symbol[tokens], last, len(identifiers))
    base = len(identifiers)
    dtype = "<u2" if base + len(rules) <= 1 << 16 else "<u4"
    header = {"base": base, "symbols": len(seq), "rules": len(rules), "docs": len(docs), "tokens": int(n_tokens.sum()), "dtype": dtype}
    head = json.dumps(header).encode()
    arrays = [
        identifiers.astype("<u4"), rules.astype(dtype), lengths_of(rules, base).astype("<u4"), np.array([d or 0 for d, _ in docs], dtype="<i8"), np.array([d is None for d, _ in docs], dtype="u1"),
        np.concatenate(([0], np.flatnonzero(last)[:-1] + 1)).astype("<i8"), np.concatenate(([0], np.cumsum(n_tokens)[:-1])).astype("<i8"), seq.astype(dtype),
    ]
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *(a.tobytes() for a in arrays)]), header


class Shard:
    """Reads a shard; document i is decoded from its own symbols."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a token file")
        n = int.from_bytes(raw[4:8], "little")
        h = self.header = json.loads(raw[8 : 8 + n])
        at, arrays = 8 + n, []
        for dtype, count in (("<u4", h["base"]), (h["dtype"], 2 * h["rules"]), ("<u4", h["rules"]), ("<i8", h["docs"]), ("u1", h["docs"]), ("<i8", h["docs"]), ("<i8", h["docs"]), (h["dtype"], h["symbols"])):
            arrays.append(np.frombuffer(raw, dtype=dtype, count=count, offset=at))
            at += arrays[-1].nbytes
        if at != len(raw):
            raise ValueError("the token file is cut short")
        self.identifiers, rules, self.lengths, self.doc_ids, self.null, self.first_symbol, self.first_token, self.symbols = arrays
        self.rules = rules.reshape(-1, 2)

    def tokens(self, i: int) -> np.ndarray:
        end = self.first_symbol[i + 1] if i + 1 < len(self.doc_ids) else len(self.symbols)
        return self.identifiers[unfolded(self.symbols[self.first_symbol[i] : end], self.rules, self.header["base"])]

    def all_tokens(self) -> np.ndarray:
        return expand(self.symbols, self.rules, self.header["base"], self.lengths, self.identifiers)

    def token_at(self, place: int) -> int:
        """The shard's token at a place, by the expanded lengths of the symbols before it."""
        i = int(np.searchsorted(self.first_token, place, side="right")) - 1
        place -= int(self.first_token[i])
        base, at = self.header["base"], int(self.first_symbol[i])
        length = lambda s: int(self.lengths[s - base]) if s >= base else 1
        while place >= (n := length(s := int(self.symbols[at]))):
            place, at = place - n, at + 1
        while s >= base:
            left, right = (int(x) for x in self.rules[s - base])
            if place < (n := length(left)):
                s = left
            else:
                s, place = right, place - n
        return int(self.identifiers[s])


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes the shards into folder and returns their written manifest (part, seq, file, start, docs, tokens, symbols, rules, bytes), also kept at folder/_manifest.

    Ascending doc_id, null ones first; rows with the same id are neighbours. Null and empty texts are the end id alone. An empty table gives no shards.
    """
    spark = docs.sparkSession
    tokens = tokenised(docs, id_col, text_col, vocabulary, end_id, "token-files")
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(1, round(total / (SHARDS_A_TASK * shard_tokens)), min(spark.sparkContext.defaultParallelism, total // 100_000))
    made_dir(folder)

    def run(batches):
        code, part = encoder(vocabulary), TaskContext.get().partitionId()
        base, seq, start, held, size = code.library.get_vocab_size(), 0, 0, [], 0

        def flush():
            raw, h = shard_bytes(held, base)
            name = f"shard-{part:06d}-{seq:05d}.rptk"
            with committed(folder, name) as out:
                out.write(raw)
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "file": name, "start": start, "docs": h["docs"], "tokens": h["tokens"], "symbols": h["symbols"], "rules": h["rules"], "bytes": len(raw)}], schema=schema)

        for b in batches:
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.frombuffer(raw, dtype=code.dtype)
                if held and size + len(ids) > shard_tokens:
                    yield flush()
                    seq, start, held, size = seq + 1, start + size, [], 0
                held.append((doc, ids))
                size += len(ids)
        if held:
            yield flush()

    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), *((c, pa.int64()) for c in ("start", "docs", "tokens", "symbols", "rules", "bytes"))])
    ordered = tokens.select(F.col("id").cast("long").alias("id"), "ids").repartitionByRange(parts, "id").sortWithinPartitions("id", "ids")
    made = map_batches(ordered, run, "part int, seq int, file string, start long, docs long, tokens long, symbols long, rules long, bytes long")
    made.write.parquet(f"{folder}/_manifest")
    return spark.read.schema(made.schema).parquet(f"{folder}/_manifest")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the manifest's shards, decoded from the files."""
    starts = part_starts(manifest.select("part", F.col("tokens").alias("n_tokens")))

    def run(batches):
        for b in batches:
            for part, name, start in zip(*(c.to_pylist() for c in b.columns)):
                shard = Shard(read_bytes(folder, name))
                raw, ends = shard.all_tokens().astype("<u4").tobytes(), [*shard.first_token[1:].tolist(), shard.header["tokens"]]
                begins = shard.first_token.tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard.doc_ids.astype(np.int64), mask=shard.null.astype(bool)), pa.array([starts[part] + start + s for s in begins], pa.int64()),
                        pa.array([e - s for s, e in zip(begins, ends)], pa.int64()), pa.array([zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(begins, ends)], pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    files, n = manifest.select("part", "file", "start"), manifest.count()
    tasks = max(1, -(-n // SHARDS_A_TASK), min(n, 2 * manifest.sparkSession.sparkContext.defaultParallelism))
    return map_batches(files.repartition(tasks, "file"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10(spark, sf_dir):
    folder = fresh_path(spark, "token-files")
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), folder), folder)
