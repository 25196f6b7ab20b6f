import hashlib
import re

from sparkscope.llm.decontaminate import clean_documents, decontaminate, words

DOCS = "doc_id long, text string, carried string, id int, n_hit int"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(docs, items, n=13):
    cut = lambda t: WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = [(i, w[k : k + n]) for i, t in items if (w := cut(t)) for k in range(max(1, len(w) - n + 1))]
    out = []
    for d, t in docs:
        ws, hit, ids = cut(t), set(), set()
        for i, win in windows:
            for k in range(len(ws) - len(win) + 1):
                if ws[k : k + len(win)] == win:
                    hit.update(range(k, k + len(win)))
                    ids.add(i)
        ids = sorted(str(i) for i in ids if i is not None)
        out.append((d, len(ws), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws)))
    return sorted(out, key=str)


def case(spark):
    long_item = " ".join(f"item{i}" for i in range(30))
    items = [(1, long_item), (2, "Two words"), (2, "two, WORDS!"), (10, "Überfluß ñandú two"), (3, None), (4, ""), (5, "  ...  "), (None, "null id item"), (6, "two words here")]
    docs = [
        (1, None), (2, ""), (3, "nothing at all"), (4, f"before {long_item} after"), (5, long_item.upper().replace(" ", ", ")), (6, "Two words two words here"), (7, "x " * 100_000 + long_item), (7, "x " * 100_000 + long_item),
        (8, "überfluß ÑANDÚ two"), (9, "Überfluß ñandú two"), (None, "null id item"), (11, " ".join(f"item{i}" for i in range(12))), (12, "pad " * 60 + "two words"),
    ]
    df = spark.createDataFrame([(a, b, "c", 1, 2) for a, b in docs], DOCS)
    return docs, items, df, spark.createDataFrame(items, "item_id long, text string")


def test_words_are_ascii_letters_digits_and_all_else():
    assert words("A-b_c 9é Z\x7f!") == [b"a", b"b", b"c", "9é z".encode()]


def test_matches_brute_force_in_one_part_and_in_many(spark):
    docs, items, df, bench = case(spark)
    want = brute([d for d in docs if d[0] != 7], items)
    for most in (500_000, 10):
        got = [tuple(r)[:6] for r in decontaminate(df, bench, most_words=most).collect()]
        assert sorted((r for r in got if r[0] != 7), key=str) == want
        assert [(r[1], r[2], r[3], r[5]) for r in got if r[0] == 7] == [(100_030, 30, 1, False)] * 2


def test_spans_point_into_the_original(spark):
    docs, _, df, bench = case(spark)
    spans = {r["doc_id"]: r["spans"] for r in decontaminate(df, bench).collect()}
    text = dict(docs)
    assert [text[4][s["start"] : s["end"]] for s in spans[4]] == [" ".join(f"item{i}" for i in range(30))]
    assert [text[9][s["start"] : s["end"]] for s in spans[9]] == ["Überfluß ñandú two"]


def test_clean_documents_keep_their_columns(spark):
    docs, items, df, bench = case(spark)
    kept = clean_documents(df, bench)
    assert kept.columns == df.columns
    bad = {r[0] for r in brute([d for d in docs if d[0] != 7], items) if r[5]}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(d) for d, _ in docs if d not in bad)
    assert clean_documents(df, bench.limit(0)).count() == len(docs)
    assert decontaminate(df.limit(0), bench).collect() == []
