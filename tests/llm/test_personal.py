import hashlib
import random
import re
import time

import duckdb
from pyspark.sql import functions as F

from trackloom.llm import personal
from trackloom.llm.queries import op13_personal_data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Without it there is no match; re would look for one in quadratic time.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.split(".")), "card": lambda: 12 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()


def base(text):
    """The contract with Python's re, pattern by pattern."""
    out = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p) in enumerate(BASE.items()) if NEEDS[k] in (text or "") for m in re.finditer(p, text or "") if valid(k, m[0])]
    return [s for *_, s in sorted(out)]


def added(text):
    """Ibans and local numbers, plainly: every match, its neighbours, its checks and its score."""
    text, out = text or "", []
    for k in personal.KINDS[4:]:
        ms = list(re.finditer(k.pattern, text))
        for i, m in enumerate(ms):
            before, after = text[ms[i - 1].end() if i else 0 : m.start()][-48:], text[m.end() : ms[i + 1].start() if i + 1 < len(ms) else len(text)][:48]
            if re.search(r"[A-Za-z0-9]\Z", before) or re.match("[A-Za-z0-9]", after):
                continue
            d = re.sub("[^0-9]", "", m[0])
            if k.name == "iban":
                c = m[0].replace(" ", "")
                ok = int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 == 1
            else:
                ok = not re.search(r"\+[0-9 ().-]*\Z", before) and not re.match(r"[ .-]?[0-9]", after) and 9 <= len(d) <= 12
            low = re.sub("[A-Z]", lambda x: x[0].lower(), f"{before} \n {after}")
            says = lambda words: re.search(f"(?:^|[^a-z])(?:{words})(?:[^a-z]|$)", low)  # noqa: E731, B023
            score = k.score + (k.more if says(k.words) else 0) - (k.less if says(personal.NOT_PERSONAL) else 0)
            if ok and score >= 70:
                out.append(f"{k.name}:{m.start()}:{m.end()}")
    return out


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, spans string, email int")
    got = personal.query(docs).collect()
    want = []
    for i, t in rows:
        b = base(t)
        want.append((i, *[sum(s.startswith(f"{k}:") for s in b) for k in BASE], hashlib.sha256(",".join(b).encode()).hexdigest(), tuple(sorted(b + added(t)))))
    key = lambda r: (str(r[0]), r[5], r[6])
    have = [(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, tuple(sorted(r.spans.split(","))) if r.spans else ()) for r in got]
    assert sorted(have, key=key) == sorted(want, key=key)
    for r in got:
        starts = [int(s.split(":")[1]) for s in r.spans.split(",") if s]
        assert starts == sorted(starts) and r.spans.count(":") == r.scores.count(":")
    return {r.doc_id: r for r in got}


CASES = {
    1: None, 2: "", 3: "clean prose without any", 4: "é a.b@c.de_x@y.z.com@q.r", 5: "1.2.3.4.5.6.7.8 256.1.1.1 000255.0.0.001", 6: "4111 1111 1111 1111 and 4111-1111-1111-1112 4111111111111111 11111111111111111111",
    7: "😀 +1 (017) 555-7713 x +12 +1--2 +49 30 1234567890123456", 8: "Account: DE89 3704 0044 0532 0130 00, GB82WEST12345698765432; DE89370400440532013001 XDE89370400440532013000",
    9: "phone: 555-123-4567, then " + "x" * 60 + " order 555-123-4567", 10: "tel +1 (555) 123-4567", 11: "a@b", 12: "@b.c", 13: "1.2.3", 14: "call (0301) 123-4567 now", 15: "x@y.z\nDE89370400440532013000\n",
    16: "1234567812345670 card 0000-0000-0000", 17: "999999999999999999999999.1.1.1", 18: "invoice version GB82WEST12345698765432",
}


def test_hand_made_cases(spark):
    rows = list(CASES.items()) + [(None, CASES[4]), (None, None), (4, CASES[4]), (4, CASES[4])]
    got = check(spark, rows)
    assert got[8].spans.count("iban") == 2 and got[9].spans == "local_phone:7:19" and "local_phone" not in got[10].spans and "iban" not in got[18].spans
    assert [int(s.rsplit(":", 1)[1]) for s in got[16].scores.split(",")] == [90, 90]
    check(spark, [])


def test_random_texts(spark):
    rng = random.Random(9)
    bits = ["a", "b.c", "@", ".", "1", "25", "255", "300", "-", " ", "+", "(", ")", "4111111111111111", "é", "😀", "\n", "\r", "x_y", "%", "+1 (017) 555-7713", "DE89370400440532013000", "DE", "phone", " tel ", "555-123-4567", "order", "A", "\t", "1.2.3.4"]
    check(spark, [(i, "".join(rng.choices(bits, k=rng.randint(0, 40)))) for i in range(1_500)])


def test_long_texts_in_near_linear_time(spark):
    texts = ["a" * 400_000, "a@" * 150_000, "1" * 400_000, "1." * 150_000, "1 " * 150_000, "+1(" * 100_000, "a@b" + ".c" * 150_000, "A1" * 150_000, "+" * 200_000, "tel 555-123-4567, a@b.cd 1.2.3.4 " * 6_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    began = time.time()
    rows = personal.query(docs).collect()
    assert len(rows) == len(texts) and time.time() - began < 60
    for row in rows:
        assert row.base_sha256 == hashlib.sha256(",".join(base(texts[row.doc_id])).encode()).hexdigest()


def test_query_equals_plain_version(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in op13_personal_data(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        assert [s for s in got[i].spans.split(",") if s.split(":")[0] in BASE] == base(text)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    rows = [(i, t) for i, t in CASES.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id") + 1_000, "text").toDF("doc_id", "text"))
    con.register("documents", docs.toArrow())
    cur = con.execute(personal.ORACLE)
    df = personal.query(docs)
    at = [[d[0] for d in cur.description].index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=str)
