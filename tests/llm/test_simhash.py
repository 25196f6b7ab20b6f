import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from sparkscope.llm import simhash
from sparkscope.llm.components import connected_components

SCHEMA = "doc_id long, text string, fp string, component_id int, _keep int"


def components(n, links):
    up = {i: i for i in n}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {i: root(i) for i in n}


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_components_of_chains_hubs_and_self_links(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200), (160, 159)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([*links, (None, 5)], "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == components(nodes, links)


def test_fingerprints_match_bit_by_bit():
    r = random.Random(1)
    for text in [None, "", " \t", "one", "One TWO", "a b c", "é É ñ", "a\x0bb\x1cc d", *(" ".join(r.choices("the of and to a in", k=r.randint(3, 60))) for _ in range(50))]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)
    assert simhash.fingerprint("the cat sat " * 20_000) == plain_fingerprint("the cat sat " * 20_000)


def bits_apart(a, b):
    return ((a ^ b) & (1 << 64) - 1).bit_count()


def shared_bytes(a, b):
    return sum((a ^ b) >> 8 * i & 255 == 0 for i in range(8))


def balls(r):
    fps = {int(x) for x in r.integers(-(1 << 63), (1 << 63) - 1, size=200)}
    for centre in list(fps)[:6]:
        for _ in range(60):  # dense balls: many postings share their bytes
            x = centre & (1 << 64) - 1
            for bit in r.integers(0, 64, size=r.integers(1, 4)):
                x ^= 1 << int(bit)
            fps.add(x - (1 << 64) if x >= 1 << 63 else x)
    centre = list(fps)[7]
    fps |= {centre ^ int(x) for x in r.integers(0, 1 << 16, size=200)}  # all in one list of six bytes
    return fps | {centre ^ (1 << 8) ^ 1, centre ^ 3, centre}


def test_the_tally_alone_decides_candidates_and_splits_lose_no_link(spark):
    fps = balls(np.random.default_rng(5))
    pairs = [(a, b) for a in fps for b in fps if a < b]
    near = {(a, b) for a, b in pairs if bits_apart(a, b) <= 2}
    enough = {(a, b) for a, b in pairs if shared_bytes(a, b) >= 6}
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    assert {tuple(r) for r in simhash.candidates(df, 10_000).collect()} == enough
    for hot in (1, 8, 10_000):
        found = {tuple(r) for r in simhash.candidates(df, hot).collect()}
        assert near <= found <= enough
        assert {tuple(r) for r in simhash.links(df, hot).collect()} == near


def test_documents_with_nulls_copies_and_clashing_columns(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base), (3, base), (3, base), (9, base.upper()), (1, None), (2, ""), (7, " \n"), (11, "short"), (None, base), (12, "x " * 200_000)]
    df = spark.createDataFrame([(a, b, "f", 1, 2) for a, b in rows], SCHEMA)
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.simhash_components(df).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (9, 3), (None, 3), (1, 1), (2, 1), (7, 1), (11, 11), (12, 12)], key=str)
    kept = simhash.near_duplicates_removed(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 11, 12]
    assert simhash.simhash_components(df.limit(0)).collect() == []


def test_each_group_keeps_one_document_whatever_its_id(spark):
    texts = {k: " ".join(f"{k}{i}" for i in range(300)) for k in "abcdef"}
    rows = [(None, texts["a"]), (None, texts["b"]), (None, texts["b"]), (7, texts["c"]), (7, texts["d"]), (7, texts["d"]), (9, texts["c"]), (3, texts["e"]), (7, texts["e"]), (None, texts["e"]), (7, texts["f"]), (7, texts["f"].upper())]
    kept = simhash.near_duplicates_removed(spark.createDataFrame([(a, b, "f", 1, 2) for a, b in rows], SCHEMA)).collect()
    assert sorted(r["text"].lower() for r in kept) == sorted(texts.values())
    assert {r["text"][0].lower(): r["doc_id"] for r in kept} == {"a": None, "b": None, "c": 7, "d": 7, "e": 3, "f": 7}


def test_query_on_documents_matches_all_pairs(spark, sf_dir):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op9(spark, sf_dir).collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    fp = {i: plain_fingerprint(t) for i, t in docs.items()}
    want = components(docs, [(a, b) for a in docs for b in docs if a < b and (fp[a] ^ fp[b]).bit_count() <= 2])
    assert got == {i: (f"{fp[i]:016x}", want[i]) for i in docs}
    assert F.lit(1) is not None


def test_of_rows_that_differ_in_other_columns_the_first_stays(spark):
    text = "one text that several rows share, with words enough for shingles"
    rows = [(1, text, p, n) for p in ("q", "p", "r") for n in (3, 2)] + [(2, text + " and more words that differ from the first in many places at once", "a", 1), (None, None, None, None), (None, "", "x", 1)]
    for parts in (1, 4):
        df = spark.createDataFrame(rows, "doc_id long, text string, p string, text_hash int").repartition(parts)
        got = simhash.near_duplicates_removed(df)
        assert got.columns == df.columns
        found = {r["doc_id"]: (r["p"], r["text_hash"]) for r in got.collect()}
        assert found[1] == ("p", 2) and found[2] == ("a", 1) and got.count() == 3
