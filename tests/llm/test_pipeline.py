import corpus_pipeline
from sparkscope.llm import quality, toxicity
from tests.llm.test_decontaminate import brute
from tests.llm.test_simhash import components, plain_fingerprint
from tests.llm.test_tokens import check_packing

DATA = "/root/testdata/sf0.001"


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "toxicity", "simhash_near_dedup", "benchmark_decontamination", "packing"]
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = texts(docs)
        made = stage(spark, docs, DATA)
        if k == 4:
            check_packing(made.collect(), [*before.items()], 1024)
            break
        assert made.columns == docs.columns
        after = texts(made)
        if k < 2:
            score, good = (quality.quality, 1) if k == 0 else (toxicity.toxicity, 0)
            want = {r["doc_id"] for r in score(docs, labels).where(f"predicted = {good}").collect()}
        elif k == 2:
            fp = {i: plain_fingerprint(t) for i, t in before.items()}
            groups = components(before, [(a, b) for a in before for b in before if a < b and (fp[a] ^ fp[b]).bit_count() <= 2])
            want = {*groups.values()}
        else:
            want = {r[0] for r in brute([*before.items()], bench) if not r[5]}
        assert after == {i: before[i] for i in want}
        docs = spark.createDataFrame(made.collect(), made.schema)


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, DATA)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and rows.count() > 0
