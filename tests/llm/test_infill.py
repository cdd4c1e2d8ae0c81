import hashlib
import random
import re

import duckdb

from trackloom.llm import infill
from trackloom.llm.queries import op11_fill_in_middle


def plainly(doc_id, text):
    """The contract, word for word, on strings."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, h = len(units), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text), text
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"
    return doc_id, n, form, len(pre), len(mid), sha(out), sha(text), out


def check(spark, rows, **how):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, form string").repartition(3)
    want = [plainly(*r) for r in rows]
    assert sorted(map(tuple, infill.transform(docs, **how).collect()), key=str) == sorted([w[:7] for w in want], key=str)
    assert sorted(map(tuple, infill.outputs(docs, **how).collect()), key=str) == sorted([(w[0], w[2], w[7]) for w in want], key=str)


def test_equals_the_contract_on_odd_texts(spark):
    rng = random.Random(3)
    bits = ["a", "Bc", "<P", ">", "<S>", "<M", "é", "ß😀", "\n", "\r", "\x00", " ", "日本", "1", "<", "<<", "P>"]
    rows = [(i, "".join(rng.choices(bits, k=rng.randint(0, 40)))) for i in range(150)] + [(i, t) for i, t in enumerate([None, "", "x", "é", "<P>", "a b", None], 500)]
    rows += [(None, "some text of no one"), (None, None), (None, "some text of no one"), (7, "again and again")] + [(7, "again and again")] * 40 + [(8, "")] * 3
    check(spark, rows, partitions=5)
    check(spark, [])


def test_long_texts_and_long_units(spark):
    check(spark, [(1, "ab cé, " * 60_000), (2, "a" * 400_000), (3, "é" * 150_000 + "z" * 150_000), (4, " " * 200_000), (5, "<" * 100_000), (11, "x<" * 50_000)])


def test_pieces_are_whole_units_of_bounded_size():
    data = ("ab é" * 30_000 + "z" * 300_000 + " end").encode()
    starts = infill.unit_starts(data)
    got = list(infill.pieces(data, starts, 0, len(data)))
    assert b"".join(got) == data and max(map(len, got)) <= infill.BYTES and all(p.decode() for p in got)
    assert len(starts) == len(re.findall(r"[A-Za-z]+|[^A-Za-z]", data.decode()))


def test_marks_are_found_wherever_the_output_is_cut():
    out = b"<S>suf<<fix<P>pre<M>mid<"
    for size in range(1, len(out) + 1):
        got = {}
        for place, piece in infill.parse((out[i : i + size] for i in range(0, len(out), size)), "spm"):
            got[place] = got.get(place, b"") + piece
        assert got == {0: b"pre", 1: b"mid<", 2: b"suf<<fix"}


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    df = op11_fill_in_middle(spark, "/root/testdata/sf0.001")
    cur = con.execute(infill.ORACLE)
    at = [[d[0] for d in cur.description].index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in cur.fetchall())
