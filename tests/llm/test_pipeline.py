import importlib.util
import random

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(8)
    words = "the of and house garden runs small tree was by with green river stone".split() + [f"n{i}" for i in range(60)]
    good = lambda n: " ".join(rng.choices(words, k=n)) + "."
    item = good(30)
    rows = {}
    for i in range(300):
        if i % 6 == 0:
            rows[i] = " ".join(w.upper() + "!!" for w in good(60).split())
        else:
            rows[i] = good(rng.randint(40, 120))
    rows[301], rows[302] = rows[1], rows[2]
    rows[303] = good(30) + " " + item + " " + good(30)
    rows[304] = good(20) + ' password = "hunter22x" ' + good(20)
    rows[305] = None
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 > 0), 0) for i in range(0, 300)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows


def test_run(spark, corpus):
    folder, rows = corpus
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    gone = {i for i in range(0, 300, 6)} | {301, 302, 303}
    assert set(got) | {305} == (rows.keys() - gone) | {305}
    assert "<assign>" in got[304].decoded and "hunter22x" not in got[304].decoded
    for i, r in got.items():
        if i not in (304, 305):
            assert r.decoded == rows[i] and list(r.ids) == [*library.encode(rows[i]), 2]


def test_stages_keep_the_columns(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "near duplicates", "decontamination", "secrets", "tokens"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_all_tasks_give_their_memory_back(spark, corpus, monkeypatch):
    folder, _ = corpus
    given = []
    kind = type(spark.range(1))
    plain = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, function, *args, **named: given.append(function) or plain(self, function, *args, **named))
    corpus_pipeline.run(spark, folder)
    assert len(given) > len(corpus_pipeline.STAGES)
    assert {f.__qualname__.split(".")[0] for f in given} == {"releasing"}


def test_the_tokenizers_are_outside_the_repository():
    assert importlib.util.find_spec("public_tokenizers") is not None
