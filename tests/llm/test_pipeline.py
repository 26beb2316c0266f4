"""The pipeline's stages one by one on the smallest tables, against the operators' own verdicts and the library."""

import public_tokenizers
import sentencepiece

import corpus_pipeline as pipeline
from braidline.llm.common import settle, sha_hex
from braidline.llm.decontaminate import decontaminate
from braidline.llm.line_dedup import line_verdicts
from braidline.llm.ngram_join import ngram_join

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in pipeline.STAGES] == ["quality", "line_dedup", "ngram_join", "decontaminate", "sentencepiece"] and pipeline.ORACLE_SQL is None
    source = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    docs, seen = source, [source]
    for name, stage in pipeline.STAGES[:-1]:
        docs = settle(stage(spark, docs, FOLDER), f"test-{name}")
        assert docs.columns == source.columns
        seen.append(docs)
    rows = [{r.doc_id: r for r in d.collect()} for d in seen]
    gone = set(rows[0]) - set(rows[1])
    clean = [k for k in rows[0] if k in labels and labels[k].quality == 1 and labels[k].toxic == 0]
    assert gone and sum(k in gone for k in clean) <= 0.05 * len(clean)
    removed = {r.doc_id: {int(n) for n in r.removed.split(",") if n} for r in line_verdicts(seen[1]).collect()}
    for k, r in rows[1].items():
        text = None if r.text is None else "\n".join(x for n, x in enumerate(r.text.split("\n")) if n not in removed[k])
        assert rows[2][k].text == text and (text == r.text or rows[2][k].n_chars == len(text))
    assert set(rows[3]) == {r.doc_id for r in ngram_join(seen[2]).collect() if r.doc_id == r.component_id}
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    assert set(rows[4]) == {r.doc_id for r in decontaminate(seen[3], bench).collect() if not r.contaminated}
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    last = pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert {r.doc_id for r in last} == set(rows[4])
    for r in last:
        ids = lib.encode(rows[4][r.doc_id].text or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha_hex(",".join(map(str, ids))), sha_hex(lib.decode(ids)))


def test_near_copies_with_two_changed_words_go(spark):
    words = [f"w{k}" for k in range(100)]
    changed = ["x" if k in (30, 70) else w for k, w in enumerate(words)]  # 86 of 106 on five words, 92 of 104 on three
    more = ["x" if k in (20, 50, 80) else w for k, w in enumerate(words)]  # 81 of 111
    texts = [" ".join(words), " ".join(changed), " ".join(more), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in pipeline.near_copies(spark, docs, FOLDER).collect()} == {0, 2, 3}


def test_stages_begin_with_memory_given_back(spark, monkeypatch):
    import corpus_pipeline

    asked = []
    monkeypatch.setattr(corpus_pipeline, "give_back", asked.append)
    docs = spark.createDataFrame([(1, "a b c", "en", "web", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    assert dict(corpus_pipeline.STAGES)["sentencepiece"](spark, docs, "/nowhere").count() == 1
    assert asked == [spark]


def test_lines_run_no_python_and_find_memory_given_back(spark, monkeypatch):
    """Line dedup is for DataFrame functions alone: the stage before gives back what its Python workers took."""
    import corpus_pipeline

    asked, scored = [], corpus_pipeline.score_quality

    def score(*args):
        asked.append("scored")
        return scored(*args)

    monkeypatch.setattr(corpus_pipeline, "score_quality", score)
    monkeypatch.setattr(corpus_pipeline, "give_back", lambda _: asked.append("given back"))
    stages, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = stages["quality"](spark, docs, FOLDER)
    assert asked == ["scored", "given back"]
    assert stages["line_dedup"](spark, kept, FOLDER).count() == kept.count() and asked == ["scored", "given back"]
