"""The pipeline against its stages worked out one by one, by brute force where there is one."""

import pytest
import sentencepiece
from test_secrets import brute as secret_spans
from test_simhash import brute_groups

import corpus_pipeline
from sparcel.llm import decontaminate, pieces, toxicity


def redacted(text):
    out, at = [], 0
    for start, _, _, end in secret_spans(text, every=True):
        if end > at:
            if start >= at:
                out += [text[at:start], "[SECRET]"]
            at = end
    return "".join(out) + text[at:]


@pytest.fixture(scope="module")
def final(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir).collect()


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "sentencepiece"]


def test_run(spark, sf_dir, final):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit_toxicity(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    index = decontaminate.build([(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])
    rows = {r.doc_id: r for r in documents.collect()}

    def toxic(text):
        clean = 1.0
        for _, _, words in toxicity.sentences(text):
            clean *= 1 - 1 / (1 + 2.718281828459045 ** -(model.bias + sum(model.weights.get(w, 0) for w in words)))
        return 1 - clean >= 0.5

    kept = [i for i, r in rows.items() if not toxic(r.text)]
    kept = sorted({g for _, _, g in brute_groups([(i, rows[i].text) for i in kept])})
    kept = [i for i, found in zip(kept, decontaminate.matches([rows[i].text for i in kept], index)) if not found]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert sorted(r.doc_id for r in final) == kept and 0 < len(kept) < len(rows)
    for r in final:
        text = redacted(rows[r.doc_id].text)
        assert r.text == text and r.n_chars == len(text) and r.round_trip and (r.lang, r.source) == (rows[r.doc_id].lang, rows[r.doc_id].source)
        assert r.pieces == library.encode(text)


def test_every_stage_but_the_last_keeps_the_columns(spark, sf_dir):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "some words", "en", "b", 10), (3, "word " * 50_000, "en", "c", 250_000)]
    for table in (rows, []):
        docs = spark.createDataFrame(table, columns)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.schema.simpleString() == docs.schema.simpleString(), name
            got = {(r.doc_id, r.text) for r in out.collect()}
            # of NULL and empty texts, which are one group, the smallest id stays
            want = {(i, t) for i, t, *_ in table} - ({(2, "")} if name == "near_duplicates" else set())
            assert got == want, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == len(table)
