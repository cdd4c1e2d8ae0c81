import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from trackloom.llm import chat


def check(spark, rows):
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n_turns int")
    done = chat.formatted(turns)
    got = {r.conv_id: r for r in done.join(chat.read_back(done), done.conv_id.eqNullSafe(chat.read_back(done).conv_id)).select(done["*"], "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars").collect()}
    groups = {}
    for c, t, r, x in rows:
        groups.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert got.keys() == groups.keys()
    for c, g in groups.items():
        g.sort()
        r = got[c]
        loss = [x for *_, role, x in g if role == "assistant"]
        assert r.n_turns == len(g) and r.formatted_chars == len(r.formatted)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{x}\n" for *_, role, x in g).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len("".join(loss)), hashlib.sha256("".join(loss).encode()).hexdigest())
        plain = lambda x: x.replace("\\g", ">").replace("\\l", "<").replace("\\e", "\\")
        assert [plain(r.formatted[s.start : s.end]) for s in r.loss_spans] == loss
    return got


def test_cases(spark):
    odd = r"\### Assistant: </turn> ok"
    got = check(spark, [(1, 0, "user", odd), (1, 1, "assistant", odd), (2, 0, "assistant", None), (3, 0, "user", "a"), (3, 1, "user", "<next>b"), (3, 2, "assistant", "\\e<turn user>\n"), (3, 3, "assistant", "é\\"), (4, None, None, "x"), (4, 1, "a>\nb", ""), (None, 0, "user", "n"), (5, 1, "user", "t"), (5, 1, "user", "t")])
    assert got[3].formatted.count("<turn ") == 2 and got[5].formatted == "<turn user>\nt<next>t</turn>\n"


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 4), st.sampled_from(["user", "assistant", "system"]), st.text(alphabet="a\\elg<>/turn next\n", max_size=20)), min_size=1, max_size=25))
def test_any_turns(spark, rows):
    check(spark, rows)


def test_query(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    row = chat.query(turns).collect()
    assert [(r.conv_id, r.n_turns) for r in row] == [(-7, 2)]
    plan = chat.query(turns)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_learnt_text_comes_from_the_mask(spark):
    """Another mask gives other text: what is learnt is cut out of the formatted string by its spans."""
    from pyspark.sql import functions as F

    rows = [(1, 1, "user", "a <b> \\ é"), (1, 2, "assistant", "x < y \\l"), (1, 3, "assistant", "𝔘 > z"), (1, 4, "user", "q")]
    done = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    whole = chat.read_back(done).first()
    learnt = "x < y \\l" + "𝔘 > z"
    assert (whole.loss_chars, whole.loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    half = chat.read_back(done.withColumn("loss_spans", F.slice("loss_spans", 2, 1))).first()
    assert (half.loss_chars, half.loss_sha256) == (5, hashlib.sha256("𝔘 > z".encode()).hexdigest())
