"""The pipeline's stages, each held against brute force on its own input."""

import corpus_pipeline
from test_llm_operators import brute_repeats, classes, shingles

from plumbline.llm import bpe, toxicity


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = {r.doc_id: r for r in docs.collect()}
        kept[name] = len(after)
        if name == "toxicity":
            model = toxicity.learnt(spark, sf)
            scores = {r.doc_id: r.score for r in toxicity.scored(spark.createDataFrame(list(before.values())), model).collect()}
            assert set(after) == {i for i in before if scores[i] < toxicity.TOXIC_AT}
        elif name == "minhash_near_dedup":
            want = classes([(i, r.text) for i, r in before.items()], 5)
            assert set(after) == {i for i in before if want[i][1] == i}
        elif name == "suffix_array_dedup":
            sizes = brute_repeats([(i, r.text) for i, r in before.items()])
            assert set(after) == set(before)
            for i, r in after.items():
                whole, gone = sizes[i][:2]
                assert r.n_chars == len(r.text) and 0 <= whole - gone - len(r.text.encode()) < 8 * max(1, sizes[i][2]) and (gone or r.text == before[i].text)
        elif name == "decontamination":
            items = [shingles(r.text, 5) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            leaky = lambda s: any(q and 100 * len(s & q) >= 80 * len(q) for q in items)
            assert set(after) == {i for i, r in before.items() if not leaky(shingles(r.text, 5))}
        else:
            own = bpe.public_bpe()
            assert {i: r.n_tokens for i, r in after.items()} == {i: len(own.encode(r.text)) for i, r in before.items()}
        if name != "byte_bpe":
            assert docs.columns == columns
    assert kept["byte_bpe"] == kept["decontamination"] > 0.7 * 200


def test_empty_and_odd_input(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "x y z", "en", "a", 5), (2, "", "en", "a", 0), (2, "", "en", "a", 0)], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, sf).count() == 4, name
