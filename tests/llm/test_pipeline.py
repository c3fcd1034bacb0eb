import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from tallyvox.llm import toxicity
from tallyvox.llm.common import read, tokenizer_path
from tests.llm.test_packing import check
from tests.llm.test_simhash import brute_components, brute_print

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark, sf_dir, documents):
    texts = dict(documents)
    docs = read(spark, sf_dir, "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "near dedup", "packing"]
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["toxicity"](spark, docs, sf_dir)
    assert kept.schema == docs.schema
    judged = toxicity.judge(docs, read(spark, sf_dir, "labels")).where("predicted = 0").collect()
    clean = {r.doc_id for r in judged}
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows) == sorted(clean) and 0 < len(clean) < len(texts)
    assert all(r.text == texts[r.doc_id] for r in rows)
    labels = {r.doc_id: r.toxic for r in read(spark, sf_dir, "labels").collect()}
    assert sum(labels.get(k) == 0 for k in texts if k not in clean) == 0

    kept = stages["exact dedup"](spark, kept, sf_dir)
    last = {}
    for key in sorted(clean):
        last[texts[key]] = key
    single = set(last.values())
    assert kept.columns == COLUMNS and {r.doc_id for r in kept.collect()} == single

    kept = stages["near dedup"](spark, kept, sf_dir)
    groups = brute_components({key: brute_print(texts[key]) for key in single})
    firsts = {key for key, group in groups.items() if key == group}
    assert kept.columns == COLUMNS and {r.doc_id for r in kept.collect()} == firsts

    pieces = stages["packing"](spark, kept, sf_dir)
    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    ids = {
        key: np.array(tokenizer.encode(texts[key], add_special_tokens=False).ids + [1], "<u4") for key in firsts
    }
    found = [tuple(r) for r in pieces.collect()]
    padding, tokens = check(found, ids)
    assert padding < 0.05 * tokens

    whole = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in whole.collect()} == firsts


def test_odd_rows(spark, sf_dir, odd_documents, no_documents):
    """Nulls, clashing columns and repeats pass through every stage; so does an empty table."""
    for docs in (odd_documents, no_documents):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            if name != "packing":
                assert out.schema == docs.schema
            docs = spark.createDataFrame(out.collect(), out.schema)
        assert (docs.count() > 0) == (docs.columns[0] == "doc_id" and out.count() > 0)
