"""The pipeline's stages, each held against a brute-force version on its own input."""

from collections import Counter, defaultdict

import pytest
from corpus import lower, near_components, words

from quarry.llm import mixing, quality, store, vocab
from quarry.llm.queries import queries, word_tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "exact dedup", "minhash near-dedup", "mixing sources to target weights", "bpe encoding and decoding",
    ]
    assert {int(q[2:].split("_")[0]) for q in queries()} == set(range(1, 11))


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, inputs, outputs = docs.columns, [], []
    for name, stage in corpus_pipeline.STAGES:
        inputs.append([tuple(r) for r in docs.collect()])
        docs = store.materialise(stage(spark, docs, small), name.replace(" ", "-"))
        outputs.append([tuple(r) for r in docs.collect()])
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns

    source = spark.read.parquet(f"{small}/documents.parquet")
    model = quality.train(source, spark.read.parquet(f"{small}/labels.parquet"))
    kept = {r["doc_id"] for r in quality.classify(source, model).collect() if r["kept"]}
    assert Counter(outputs[0]) == Counter(r for r in inputs[0] if r[0] in kept)

    best = {}
    for r in inputs[1]:
        best[lower(r[1])] = max(best.get(lower(r[1]), r), r, key=lambda x: x[0])
    assert Counter(outputs[1]) == Counter(best.values())

    top = near_components(inputs[2], 80)
    assert Counter(outputs[2]) == Counter(r for r in inputs[2] if top[r[0]] == r[0])

    sizes, taken = defaultdict(int), defaultdict(int)
    texts, of = {r[0]: r for r in inputs[3]}, Counter()
    for r in inputs[3]:
        sizes[r[3]] += len(words(r[1]))
    for r in outputs[3]:
        whole = texts[r[0]]
        assert r[2:] == whole[2:] and (r[1] == whole[1] or " ".join(words(r[1])) in " ".join(words(whole[1])))
        taken[r[3]] += len(words(r[1]))
        of[r[0]] += len(words(r[1]))
    names = sorted(sizes)
    for name, target in zip(names, mixing.water_fill([sizes[n] for n in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))]), strict=True):
        assert abs(taken[name] - target) <= max(3, 0.01 * target)
    assert all(n <= 2 * len(words(texts[d][1])) for d, n in of.items())

    library = vocab.load(word_tokenizer())
    want = Counter((r[0], tuple(library.encode(r[1], add_special_tokens=False).ids)) for r in inputs[4])
    assert Counter((r[0], tuple(r[2])) for r in outputs[4]) == want
    assert all(r[1] == len(r[2]) for r in outputs[4])

    whole = sorted(map(str, corpus_pipeline.run(spark, small).collect()))
    assert len(whole) == len(outputs[4])


@pytest.mark.parametrize("name", ["op2_licences", "op3_exact_dedup", "op5_near_dedup", "op6_top_k"])
def test_query_equals_sql(spark, small, name):
    from oracle import assert_same, duck

    from quarry.llm.queries import oracle_sql

    assert_same(queries()[name](spark, small), duck(small).sql(oracle_sql()[name]))
