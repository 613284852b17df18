"""The pipeline against the same stages in plain Python."""

import hashlib

import corpus_pipeline
import __spark_entry__
from millrace.llm import toxicity
from millrace.llm._tables import read
from millrace.llm.queries import tokenizer_bytes

from test_texts import brute_components, brute_hits


def test_pipeline_against_plain_python(spark, sf):
    import sentencepiece

    docs = [(r.doc_id, r.text) for r in read(spark, sf, "documents").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in read(spark, sf, "benchmark").collect()]
    score = toxicity.train(read(spark, sf, "documents"), read(spark, sf, "labels")).scorer().score
    kept = [(i, t) for i, t in docs if score(t) < 0.5]
    last = {}
    for i, t in kept:
        last[t] = max(i, last.get(t, i))
    kept = [(i, t) for i, t in kept if last[t] == i]
    groups = brute_components(kept, 5, 80)
    kept = [(i, t) for i, t in kept if groups[i][1] == i]
    kept = [(i, t) for i, t in kept if not brute_hits(t, items)[1]]
    sp = sentencepiece.SentencePieceProcessor(model_proto=tokenizer_bytes("piece_bpe_32k.model"))
    want = {}
    for i, t in kept:
        ids = [*sp.encode(t), 2]
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256) for r in out} == want and len(out) == len(want) > 0


def test_stages_keep_columns_and_are_registered(spark, sf):
    docs = read(spark, sf, "documents").filter("doc_id < 0")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.count() == 0, name
    known = __spark_entry__.queries()
    assert "pipeline" in known and {n.split("_")[0] for n in known if n.startswith("op")} == {f"op{k}" for k in range(1, 11)}
