"""The pipeline against a composition of brute-force stages."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from kinetra.llm import tokens
from tests.llm.conftest import prose
from tests.llm.test_dedup import WORD, LOWER

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    shared, exam = prose(901, 60), prose(902, 40)
    rows, labels = [], []
    for k in range(120):
        text = prose(1000 + k, 70)
        if k % 6 == 0:
            text = text.replace(" ", " idiot moron ", 1)
        if k in (11, 13, 17):
            text += " " + shared
        if k in (21, 22):
            text += "\n" + exam + "\nafter"
        rows.append((k, text, "en", "s", len(text)))
        labels.append((k, 1, int(k % 6 == 0)))
    rows += [(200, rows[1][1], "en", "s", 1), (201, rows[2][1] + " tail", "en", "s", 1), (202, None, "en", "s", None), (203, "", "en", "s", 0)]
    out = f"{tmp_path_factory.mktemp('sf')}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(5, exam)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out, dict((r[0], r[1]) for r in rows), exam


def without_repeats(texts, span=100):
    seen, out = {}, {}
    for d in sorted(texts):
        raw = (texts[d] or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - span + 1):
            if seen.setdefault(raw[k : k + span], (d, k)) != (d, k):
                gone[k : k + span] = True
        out[d] = np.frombuffer(raw, np.uint8)[~gone].tobytes().decode(errors="ignore")
    return out


def without_exam(text, exam, window=10):
    wins = [w.translate(LOWER) for w in WORD.findall(exam)]
    wins = {tuple(wins[k : k + window]) for k in range(len(wins) - window + 1)}
    found = list(WORD.finditer(text.translate(LOWER)))
    hit = set()
    for k in range(len(found) - window + 1):
        if tuple(m.group() for m in found[k : k + window]) in wins:
            hit |= set(range(k, k + window))
    out, at, k = [], 0, 0
    while k < len(found):
        if k in hit:
            out.append(text[at : found[k].start()])
            while k + 1 in hit:
                k += 1
            at = found[k].end()
        k += 1
    return "".join(out) + text[at:]


def test_pipeline(spark, folder):
    path, texts, exam = folder
    got = corpus_pipeline.run(spark, path).collect()
    kept = {d: t for d, t in texts.items() if not (d < 120 and d % 6 == 0) and d not in (200, 201)}
    final = {d: without_exam(t, exam) for d, t in without_repeats(kept).items()}
    assert exam[:30] not in final[21] and "after" in final[21]
    tok, expected = Tokenizer.from_file(tokens.public("word_bpe_49k.json")), []
    for d, t in final.items():
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4")
        expected.append((d, 0, 0, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(expected)


def test_stages_keep_the_columns_of_documents(spark, folder):
    path, texts, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near-duplicates", "suffix-array-dedup", "decontamination", "packing"]
    out = corpus_pipeline.remove_benchmark(spark, docs, path)
    assert out.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in out.collect() if r.doc_id in (21, 22))
    assert all(r.text == texts[r.doc_id] for r in out.collect() if r.doc_id not in (21, 22))
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, path).count() == 0


def test_every_stage_begins_with_slim_executors(spark, monkeypatch):
    from kinetra.llm import workers

    workers.slim(spark)  # runs wherever the executors are
    begun = []

    def slim(session):
        begun.append(session)
        raise InterruptedError

    monkeypatch.setattr(workers, "slim", slim)
    for _, stage in corpus_pipeline.STAGES:
        with pytest.raises(InterruptedError):
            stage(spark, spark.range(1), "nowhere")
    assert len(begun) == len(corpus_pipeline.STAGES)
