import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkscope.llm import encode, packing, token_files
from sparkscope.llm.token_counts import Counter, token_counts

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
COUNTER, ENCODER = Counter(), encode.Encoder()
ODD = [
    None, "", " ", "\n", "a", " a", "a ", "a  b", "a\n b", "x\n\ny", "don't stop", "it's a\ntest's", "'s 't ''ll", "<|endoftext|>", "a <|endoftext|>b<|endoftext|>", "é'é ñ. ¿q", "日本 語テキスト", "1,5 2.5% a9 9a",
    "a&&& b### c***\nd", "tab\tb  c", "\x1cx y", "a b c", "emoji 👩‍👩‍👧 x", "A" * 3000, "word " * 5000, "é a‍b", "² ½ Ⅷ",
]
TEXTS = st.text(st.sampled_from(" \n\t'abzAZ019.,!&#éñß日² ́") | st.characters(codec="utf-8"), max_size=60)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_counts_and_identifiers_match_the_library(text):
    assert COUNTER.count(text) == len(ids(text))
    assert np.frombuffer(ENCODER.encode([text])[0], ENCODER.dtype).tolist() == ids(text)


def test_odd_texts_and_a_small_cache(monkeypatch):
    monkeypatch.setattr(encode, "KEPT", 3 * encode.ENTRY)
    small = encode.Encoder()
    for _ in range(2):
        assert [np.frombuffer(x, small.dtype).tolist() for x in small.encode(ODD)] == [ids(t) for t in ODD]
    assert [COUNTER.count(t) for t in ODD] == [len(ids(t)) for t in ODD]


def test_a_word_is_looked_up_once_however_often_it_comes():
    class Library:
        calls = 0

        def encode(self, *a, **b):
            self.calls += 1
            return LIBRARY.encode(*a, **b)

    class Words(encode._Words):
        asked = 0

        def __getitem__(self, word):
            self.asked += 1
            return super().__getitem__(word)

    code, texts = encode.Encoder(), [f"Lorem ipsum, dolor{mark}\nSit amet {i % 7}" for i in range(500) for mark in ("", ".")]
    code.library, code.known = Library(), Words(code, {})
    assert [np.frombuffer(x, code.dtype).tolist() for x in code.encode(texts)] == [ids(t) for t in texts]
    # Six words and seven numbers, and the words before two marks; seven numbers and two marks go to the library as they are.
    assert code.known.asked <= 15 and code.library.calls <= 9


def test_texts_in_arrow_arrays_and_small_pieces(monkeypatch):
    texts = [*ODD, "Ünd so\nwéiter. 9a\n日本 x", "\u2028a b", "a b\u3000", "x\x85y z", "<|endoftext|", "one\n<|endoftext|> two", "\n", "a\n", "'s a\n's b", "½a\n½ ²b\n日"]
    for piece in (1, 40, 4 << 20):
        monkeypatch.setattr(encode, "PIECE", piece)
        for kind in (pa.string(), pa.large_string()):
            column = pa.array([None, "left out", *texts, "left out"], kind)[2:-1]
            assert [np.frombuffer(x, ENCODER.dtype).tolist() for x in ENCODER.encode(column)] == [ids(t) for t in texts]
    assert ENCODER.encode([]) == [] and ENCODER.encode([None, None]) == [b"", b""]


def frame(spark):
    rows = [(i if i != 4 else None, t) for i, t in enumerate(ODD)] + [(6, "a "), (6, "a ")]
    return rows, spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id long, text string, part int, ids string").repartition(3)


def test_token_counts_of_a_table(spark):
    rows, df = frame(spark)
    want = sorted(((d, len((t or "").encode()), len(ids(t)), len(ids(t)) > 1024) for d, t in rows), key=str)
    assert sorted((tuple(r) for r in token_counts(df).collect()), key=str) == want
    assert token_counts(df.limit(0)).collect() == []


def check_packing(pieces, rows, context):
    by_doc = {}
    for r in pieces:
        by_doc.setdefault((r["sequence_id"] * context + r["offset"] - r["start"]), []).append(r)
    docs, at = [], 0
    for begin in sorted(by_doc):
        own, done = sorted(by_doc[begin], key=lambda r: r["start"]), 0
        assert begin == at
        for r in own:
            assert r["start"] == done and 0 < r["length"] and r["offset"] + r["length"] <= context
            done += r["length"]
        assert done == own[0]["doc_tokens"]
        at += done
        docs.append((own[0]["doc_id"], tuple((r["start"], r["length"], r["ids_crc32"]) for r in own)))
    for d, parts in docs:
        options = [np.array([*ids(t), 0], dtype="<u4") for i, t in rows if i == d]
        assert any(all(zlib.crc32(o[s : s + n]) == c for s, n, c in parts) and sum(n for _, n, _ in parts) == len(o) for o in options)
    assert len(docs) == len(rows)


def test_packing_fills_every_sequence_but_the_last(spark, sf_dir):
    rows, df = frame(spark)
    for context in (7, 1024):
        check_packing(packing.pack(df, context=context).collect(), rows, context)
    assert packing.pack(df.limit(0)).collect() == []
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check_packing(packing.op2(spark, sf_dir).collect(), docs, 1024)


def without_overlaps(seq, last):
    """Occurrences of each pair within documents that don't overlap, counted from the left."""
    counts, taken = {}, {}
    for i in range(len(seq) - 1):
        pair = seq[i], seq[i + 1]
        if not last[i] and taken.get(pair, -2) < i - 1:
            taken[pair] = i
            counts[pair] = counts.get(pair, 0) + 1
        elif last[i]:
            continue
    return counts


def test_grammars_give_back_what_they_got_and_leave_no_frequent_pair():
    r = np.random.default_rng(2)
    for base, n, least in ((50_257, 20_000, 5), (70_000, 20_000, 2), (8, 3_000, 5), (2, 3_000, 2), (65_530, 30_000, 3)):
        tokens = r.zipf(1.3, size=n).clip(1, base) - 1
        tokens[100:900] = np.tile([1, 1, 1, 0], 200)
        last = r.random(n) < 0.01
        last[-1] = True
        seq, ends, rules = token_files.repair(tokens, last, base, least)
        assert len(rules) and len(seq) < n and ends.sum() == last.sum()
        assert max(without_overlaps(seq.tolist(), ends.tolist()).values()) < least
        assert (token_files.expand(seq, rules, base) == tokens).all() and (token_files.unfolded(seq, rules, base) == tokens).all()
        assert (token_files.lengths_of(rules, base) == [len(token_files.expand(np.array([base + i]), rules, base)) for i in range(len(rules))]).all()


def test_shards_decode_single_documents_and_tokens():
    r = np.random.default_rng(3)
    docs = [(None if i == 2 else i, np.append(r.integers(0, 40, size=r.integers(0, 300)), 2)) for i in range(50)]
    raw, _ = token_files.shard_bytes(docs, 50_257)
    shard = token_files.Shard(raw)
    assert all((shard.tokens(i) == t).all() for i, (_, t) in enumerate(docs))
    whole = np.concatenate([t for _, t in docs])
    assert (shard.all_tokens() == whole).all()
    assert all(shard.token_at(p) == whole[p] for p in range(0, len(whole), 37))
    for bad in (raw[:-1], b"no" + raw[2:]):
        try:
            token_files.Shard(bad)
        except ValueError:
            continue
        raise AssertionError("a damaged file was read")


def test_token_files_round_trip(spark, sf_dir, tmp_path):
    rows, df = frame(spark)
    folder = f"file://{tmp_path}/odd"
    got = sorted((tuple(r) for r in token_files.read_token_files(token_files.write_token_files(df, folder, shard_tokens=500), folder).collect()), key=lambda r: r[1])
    want, start = [], 0
    for d, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        v = np.array([*ids(t), 2], dtype="<u4")
        want.append((d, start, len(v), zlib.crc32(v)))
        start += len(v)
    assert [r[0] for r in got] == [r[0] for r in want]
    assert {r for r in got if r[0] != 6} == {r for r in want if r[0] != 6}  # rows of one id may change places
    empty = f"file://{tmp_path}/empty"
    assert token_files.read_token_files(token_files.write_token_files(df.limit(0), empty), empty).collect() == []
    start = 0
    own = {r["doc_id"]: tuple(r)[1:] for r in token_files.op10(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect():
        v = np.array([*ids(r["text"]), 2], dtype="<u4")
        assert own[r["doc_id"]] == (start, len(v), zlib.crc32(v))
        start += len(v)
