import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from trackloom.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
CASES = ["", " ", "  ", "a", " a", "a ", "a  b", "a\n\nb c", "x\x00y", "▁", "a▁▁b", "一二 \U0001f600", "éa" * 300, "the of and " * 200, "   " * 50, "</s> <s> <0x41> <unk>", "\t\tx  \n y"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def own():
    return pieces.Pieces(MODEL)


def test_cases_equal_the_library(library, own):
    ids = own.encode(CASES)
    assert ids == [x + [library.eos_id()] for x in library.encode(CASES)]
    assert [own.decode(x) for x in ids] == [library.decode(x) for x in ids]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n▁eatinthe.")), max_size=60))
def test_any_text_equals_the_library(library, own, text):
    ids = own.encode([text])[0]
    assert ids == library.encode(text) + [library.eos_id()]
    assert own.decode(ids) == library.decode(ids)


def test_spark_rows(spark, library):
    rows = [(1, None, "x"), (1, None, "x"), (None, "the of", "y"), (2, "é " * 3000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.digests(docs, MODEL, "texts").collect()}
    ids = [(i, library.encode(t or "") + [2]) for i, t, _ in rows]
    assert got == {(i, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(library.decode(x).encode()).hexdigest()) for i, x in ids}
    full = pieces.encode(docs, MODEL).collect()
    assert sorted((r.doc_id or 0, r.ids) for r in full) == sorted((i or 0, x) for i, x in ids)
    assert {r.decoded for r in full} == {library.decode(x) for _, x in ids}
    assert pieces.digests(docs.limit(0), MODEL).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("einthaors.▁é1\U0001f600"), min_size=1, max_size=120))
def test_both_agendas_agree(own, text):
    """Short stretches have a list for an agenda and long ones a heap; both merge the leftmost of the best pairs."""
    short = list(text)
    own.merge_short(short)
    assert short == own.merge_long(list(text))


def test_short_stretches_need_no_heap(own, monkeypatch):
    """The heap cost more than the budget on texts of many different words."""
    monkeypatch.setattr(own, "merge_long", None)
    assert own.agenda("▁unheard-of")[-1] == own.library.encode("unheard-of")[-1]
