"""SimHash near-duplicates by an inverted index over byte positions with count filtering.

A fingerprint has eight bytes. Two that differ in at most two bits share at least six of the eight positional bytes, the
guaranteed minimum. A posting list of one positional byte would hold one row in 256, so its pairs grow with the square of the
corpus; the index is therefore keyed by several positional bytes at a time. The bytes form four neighbouring couples, two
differing bits spoil two couples at most, so some two couples are whole: each fingerprint is filed under the six choices of two
couples and, where it has company there, under those four bytes and one more. In these lists of five positional bytes the
pairs are tallied: a pair that meets in n of the four lists of its couples shares 4 + n positional bytes, and goes on from six.

Rows with equal fingerprints are one posting. A list with more than HOT postings is not paired as it stands but split by a sixth
byte: a partner shares one more of the other three, so the pair meets in one of the parts and has its six shared bytes there.
A part still larger is split by a seventh byte, and by the bits of both bytes left for pairs that share neither of them, of which
each byte then differs in one bit. Every split is exact, no list is dropped, and pairs are formed only within lists up to HOT or
the 256 postings that seven bytes allow.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, free_name, map_batches, staged
from .components import connected_components

SHINGLE_WORDS, SEED = 3, 42
BYTES, COUPLES, MAX_BITS = 8, 4, 2
LEAST_SHARED = BYTES - MAX_BITS
#: Postings in a list up to which its pairs are formed; larger ones are split by a further byte.
HOT = 64
#: Shingles whose bits are unpacked at a time.
CHUNK = 8192


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint; zero for null and for texts without words."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only \\x20 and \\x09-\\x0D part words
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, n = np.concatenate(([0], ends[:-1])).tolist(), max(1, len(words) - SHINGLE_WORDS + 1)
    stops = (ends[-n:] - 1).tolist()
    h = np.fromiter((xxhash.xxh64_intdigest(whole[i:j], SEED) for i, j in zip(starts, stops)), dtype=">u8", count=n)
    ones = sum(np.unpackbits(h[i : i + CHUNK].view(np.uint8).reshape(-1, BYTES), axis=1).sum(axis=0, dtype=np.int64) for i in range(0, n, CHUNK))
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, text_hash): fp holds the fingerprint's bits as a signed long. One row for each row of docs."""
    schema = pa.schema([(id_col, pa.int64()), ("fp", pa.int64()), ("text_hash", pa.int64())])

    def run(batches):
        for b in batches:
            fps = np.fromiter(map(fingerprint, b.column(1).to_pylist()), dtype=np.uint64, count=b.num_rows)
            yield batch(schema, b.column(0), fps.view(np.int64), b.column(2))

    text = F.col(text_col).cast("string")
    return map_batches(docs.select(F.col(id_col).cast("long").alias(id_col), text.alias("text"), F.xxhash64(text).alias("text_hash")), run, f"`{id_col}` long, fp long, text_hash long")


def _long(bits: int) -> Column:
    """A 64-bit pattern as a signed long."""
    return F.lit(bits - (1 << 64) if bits >= 1 << 63 else bits).cast("long")


def _mask(of: tuple[int, ...]) -> int:
    """The bits of some byte positions."""
    return sum(0xFF << (8 * i) for i in of)


def _filed(postings: DataFrame, under: dict[int, list[int]]) -> DataFrame:
    """Postings (bytes, fp, ...) once for each further mask that `under` names for their bytes, with the list's key k."""
    ways = F.create_map(*[x for mask, further in under.items() for x in (_long(mask), F.array(*map(_long, further)))])
    others = [c for c in postings.columns if c != "bytes"]
    return postings.select(*others, F.explode(F.element_at(ways, F.col("bytes"))).alias("bytes")).withColumn("k", F.col("fp").bitwiseAND(F.col("bytes")))


def _sized(rows: DataFrame) -> DataFrame:
    """The rows of lists with company, and n, the postings of their list."""
    return rows.join(rows.groupBy("bytes", "k").agg(F.count("*").alias("n")).where("n > 1"), ["bytes", "k"])


def _pairs(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, a, b) with a < b of the postings that share the keys."""
    of = F.flatten(F.transform("fs", lambda a: F.transform(F.filter("fs", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return rows.groupBy(*keys).agg(F.collect_set("fp").alias("fs")).select(*keys, F.inline(of))


def candidates(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b) with a < b of distinct fingerprints in column fp: the pairs that share LEAST_SHARED positional bytes or more, as counted, some more than once.

    Of lists of more than hot postings of six bytes, only those that can still pass: they share a seventh byte, or each byte left differs in one bit.
    """
    more = lambda of: [_mask((*of, i)) for i in range(BYTES) if i not in of]
    couples = [(2 * c, 2 * c + 1, 2 * d, 2 * d + 1) for c, d in combinations(range(COUPLES), 2)]
    five, six = ([*combinations(range(BYTES), n)] for n in (5, LEAST_SHARED))
    whole = fps.select("fp", F.lit(0).cast("long").alias("bytes"))
    fours = _sized(_filed(whole, {0: [*map(_mask, couples)]})).select("fp", "bytes", F.col("bytes").alias("couples"))
    fives = staged(_sized(_filed(staged(fours, "postings-of-four"), {_mask(of): more(of) for of in couples})), "postings-of-five")
    met = _pairs(fives.where(F.col("n") <= hot), "couples", "bytes", "k")
    tallied = met.groupBy("couples", "a", "b").agg((4 + F.count("*")).alias("shared")).where(F.col("shared") >= LEAST_SHARED)
    sixes = staged(_sized(_filed(fives.where(F.col("n") > hot).select("fp", "bytes"), {_mask(of): more(of) for of in five}).distinct()), "postings-of-six")
    large = sixes.where(F.col("n") > hot).select("fp", "bytes")
    sevens = _filed(large, {_mask(of): more(of) for of in six}).distinct()
    left = {of: [i for i in range(BYTES) if i not in of] for of in six}
    but_two_bits = {_mask(of): [(1 << 64) - 1 - (1 << 8 * i + p) - (1 << 8 * j + q) for p in range(8) for q in range(8)] for of, (i, j) in left.items()}
    found = [tallied, _pairs(sixes.where(F.col("n") <= hot), "bytes", "k"), _pairs(sevens, "bytes", "k"), _pairs(_filed(large, but_two_bits).distinct(), "bytes", "k")]
    return reduce(DataFrame.unionAll, [x.select("a", "b") for x in found])


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b) of the candidates whose bits differ in at most MAX_BITS places: every such pair."""
    return candidates(fps, hot).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp, text_hash, g, component_id) for each row: g is the group's smallest fingerprint, component_id its smallest id."""
    fps = staged(fingerprints(docs, id_col, text_col), "fingerprints")
    reps = staged(fps.groupBy("fp").agg(F.min(id_col).alias("rep")), "distinct-fingerprints")
    groups = connected_components(links(reps.select("fp")))
    named = reps.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("g"))
    least = named.groupBy("g").agg(F.min("rep").alias("component_id"))
    return fps.join(named.join(least, "g").select("fp", "g", "component_id"), "fp")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for each row: the smallest id reachable over links of at most MAX_BITS bits.

    Null and empty texts have fingerprint zero and link like any other. Rows with the same id and text give equal rows; null
    ids keep their rows and count only if a group has no other. Other columns of docs play no part. An empty table gives none.
    """
    return _grouped(docs, id_col, text_col).select(id_col, "fp", "component_id")


def near_duplicates_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with docs' columns: one of each group, that with the smallest id (null ids last), fingerprint and hash of the text, and of several such rows the one whose other columns come first as JSON."""
    first = F.min(F.struct(F.col(id_col).isNull(), F.col(id_col).alias("id"), "fp", "text_hash")).alias("first")
    keep = _grouped(docs, id_col, text_col).groupBy("g").agg(first).select(F.col("first.id").alias("_keep"), F.col("first.text_hash").alias("_keep_hash"))
    own = free_name(docs, "text_hash")
    rows = docs.withColumn(own, F.xxhash64(F.col(text_col).cast("string")))
    kept = rows.join(keep, rows[id_col].eqNullSafe(keep["_keep"]) & (rows[own] == keep["_keep_hash"]), "left_semi")
    others = F.to_json(F.struct(*[docs[c] for c in docs.columns if c not in (id_col, text_col)], F.lit(0).alias("_")))
    return kept.groupBy(id_col, own).agg(F.min_by(F.struct(*[docs[c] for c in docs.columns]), others).alias("_row")).select("_row.*")


def op9(spark, sf_dir):
    from .common import table

    return simhash_components(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
