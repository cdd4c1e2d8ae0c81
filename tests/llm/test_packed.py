import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trackloom.llm import packed

FILE = public_tokenizers.path("byte_bpe_50k.json")
UNTOUCHED = Tokenizer.from_file(FILE)
TEXTS = ["", " ", "a  b", "it's one\n\n two \t x", "the of" * 400, "é ü 一二 \U0001f600 \x1c x", "<|endoftext|> y", "x <|endoftext|>", "a b<|endoftext|>c  d <|endoftext| > e", "don 't  'll  z", "1 2 33 a1 _b", "x \ny z\n w", " lead", "tail "]


@given(st.integers(1, 32), st.data())
def test_any_range_comes_back(bits, data):
    ids = np.array(data.draw(st.lists(st.integers(0, 2**bits - 1), max_size=70)), "<u4")
    low = data.draw(st.integers(0, len(ids)))
    high = data.draw(st.integers(low, len(ids)))
    whole = packed.pack(ids, bits)
    assert len(whole) == (len(ids) * bits + 7) // 8
    assert (packed.unpack(whole, bits, low, high) == ids[low:high]).all()


def test_stretches_equal_the_library():
    library = Tokenizer.from_file(FILE)
    got = packed.Encoder(FILE).encode(TEXTS)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode(x, add_special_tokens=False).ids for x in TEXTS]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aeth T.,'s\n -_É1² ")), max_size=40))
def test_any_text_equals_the_library(text):
    library = UNTOUCHED
    assert np.frombuffer(packed.encoder(FILE).encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [1, 5])
def test_files(spark, tmp_path, n):
    library = Tokenizer.from_file(FILE)
    rows = [(i * 7 % 12 - 3, x) for i, x in enumerate(TEXTS)] + [(40, None), (40, None), (41, "twice"), (41, "twice")]
    docs = spark.createDataFrame([(i, x, "clash") for i, x in rows], "doc_id long, text string, start string").repartition(3)
    folder = str(tmp_path / "set")
    packed.write(docs, FILE, 2, folder, partitions=n, block_docs=3)
    got = sorted(packed.digests(spark, folder).collect(), key=lambda r: r.start)
    at, everything = 0, []
    for r, (i, x) in zip(got, sorted(rows, key=lambda r: (r[0], r[1] or "")), strict=True):
        ids = np.array([*library.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
        everything += ids.tolist()
    assert packed.lookup(spark, folder, 5, at - 3).tolist() == everything[5:-3]
    assert [x for r in packed.documents(spark, folder).orderBy("start").collect() for x in r.ids] == everything


def test_no_rows_and_no_ids(spark, tmp_path):
    docs = spark.createDataFrame([(None, "a"), (None, None)], "doc_id long, text string")
    assert [r.n_tokens for r in packed.written_digests(docs, FILE, 2).orderBy("start").collect()] == [1, 2]
    assert packed.written_digests(docs.limit(0), FILE, 2).count() == 0


def test_blank_lines_equal_the_library():
    """Line feeds and other white space between a letter or mark and a letter."""
    library = Tokenizer.from_file(FILE)
    spaces = ["\n\n", "\n\n\n", "\r\n", "\t\n", " \n", "\n \n", "\n\t", "\x1c\n", "\xa0\n", "\n"]
    texts = ["the end.\n\nThe next", "x a\n\nfoo", *[f"x {a}{s}{b} z" for s in spaces for a in ("end", "end.", "7", "'", "\u4e00", "end'") for b in ("The", "\xe9t\xe9", "7", "'s", "(a)", "\u4e00", "")]]
    got = packed.Encoder(FILE).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode(x, add_special_tokens=False).ids for x in texts]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="\n\n\n\r\t aT.,'7\xe9\u4e00", max_size=30))
def test_any_line_feeds_equal_the_library(text):
    library = UNTOUCHED
    assert np.frombuffer(packed.encoder(FILE).encode(["x " + text])[0], "<u4").tolist() == library.encode("x " + text, add_special_tokens=False).ids


def test_quoted_end_marks_are_one_id():
    assert np.frombuffer(packed.Encoder(FILE).encode(["one <|endoftext|> two"])[0], "<u4").tolist() == UNTOUCHED.encode("one <|endoftext|> two", add_special_tokens=False).ids
    assert 50256 in np.frombuffer(packed.Encoder(FILE).encode(["one <|endoftext|> two"])[0], "<u4")


def test_ids_of_any_type(spark, tmp_path):
    docs = spark.createDataFrame([("b", "two words"), ("a", "one"), (None, "none")], "doc_id string, text string")
    packed.write(docs, FILE, 2, str(tmp_path / "p"), 2)
    rows = packed.digests(spark, str(tmp_path / "p")).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, "a", "b"] and rows[0].start == 0
    assert [r.doc_id for r in packed.documents(spark, str(tmp_path / "p")).orderBy("start").collect()] == [None, "a", "b"]


class Counted:
    """The library or its model, with the number of calls that encode."""

    def __init__(self, own, calls):
        self.own, self.calls = own, calls

    def __getattr__(self, name):
        if name in ("encode", "encode_batch_fast", "tokenize"):
            self.calls.append(name)
        return getattr(self.own, name)


def test_new_stretches_take_few_calls_of_the_library():
    """The cost of a text of new words was one call for each of them."""
    words = [f"w{i}x{i % 7}{'.,!'[i % 3]}" if i % 2 else f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100]}ing" for i in range(1000)]
    enc, calls = packed.Encoder(FILE), []
    enc.library = Counted(enc.library, calls)
    if hasattr(enc, "model"):
        enc.model = Counted(enc.model, calls)
    text = "one " + " ".join(words)
    assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == UNTOUCHED.encode(text, add_special_tokens=False).ids
    assert len(calls) < 10


LINES = ["end.\nThe next, it's\nhere!", "a\n", "\nb c", "x,\n(y) z...\n'tis", "a.\n\nb\nc, d", "one,  two.\nthree", "the\n1,\n2\n***\nthe end.***", "7%, é!? ñ. _x_ ×, 'll, n't. 一, ².", "a\n\nb c.\n\nD", "a b\n\n", "\n\na b", "x y\n\n\nz w\n\nv"]


def test_line_feeds_and_marks_at_ends_equal_the_library():
    got = packed.Encoder(FILE).encode(LINES)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [UNTOUCHED.encode(x, add_special_tokens=False).ids for x in LINES]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="\n  aT.,'7\xe9!一\xa0", max_size=20) | st.text(alphabet="\n\nab,.'", max_size=20), max_size=6), st.integers(0, 3))
def test_many_texts_at_once_equal_the_library(texts, remember):
    """Plain, odd and quoting texts side by side, with a memory that forgets between calls."""
    enc = packed.encoder(FILE)
    kept, enc.remember = enc.remember, remember
    for some in (texts, ["x " + x for x in texts] + TEXTS[:3] + ["q <|endoftext|> a"], texts[::-1]):
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(some)] == [UNTOUCHED.encode(x, add_special_tokens=False).ids for x in some]
    enc.remember = kept
    ids, starts = enc.encode_all(texts, np.array([2], "<u4").tobytes())
    assert ids.tolist() == [i for x in texts for i in [*UNTOUCHED.encode(x, add_special_tokens=False).ids, 2]] and len(starts) == len(texts) + 1
