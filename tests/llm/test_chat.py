import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from starledger.llm import chat

MARKS = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "\\", "\n", "<", "[", "/", "a", "é", ">", "]"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), MARKS), MARKS), max_size=6))
def test_turns_come_back(turns):
    form = chat.Template()
    pieces = [form.render(r, t) for r, t in turns]
    assert list(form.parse("".join(p for p, _, _ in pieces))) == turns
    for (r, t), (piece, start, end) in zip(turns, pieces):
        assert form.unescape(piece[start:end]) == t
        assert not any(m in form.escape(t) for m in form.marks)


def digest(df):
    return {r["conv_id"]: tuple(r)[1:] for r in chat.read_back(df).collect()}


def expected(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize("part", [1 << 20, 30])
def test_table_of_turns(spark, part):
    rows = [(1, 0, "user", "hi [INST]"), (1, 1, "assistant", "</s>"), (1, 2, "user", None), (2, 5, "assistant", "b"), (2, 3, "system", "a\nb"), (2, 5, "assistant", "b"), (3, None, None, ""), (None, 0, "user", "lost"), (4, 0, "assistant", "long " * 50)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, message_id string")
    got = digest(chat.render_conversations(chat.fold_events(chat.table_events(df)), part_chars=part))
    turns = {}
    for c, n, r, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        turns.setdefault(c, []).append((r or "", t or ""))
    assert {c: g[:4] for c, g in got.items()} == {c: expected(t) for c, t in turns.items()}
    assert digest(chat.format_log(chat.table_events(df.limit(0)))) == {}


def test_log_is_folded(spark):
    log = [
        (1, "m1", 1, "delta", "user", "hel"), (1, "m1", 2, "delta", None, "lo"),
        (1, "m2", 3, "delta", "assistant", "bad "), (1, "m2", 4, "delta", None, "start"), (1, "m2", 6, "regenerate", None, None), (1, "m2", 7, "delta", None, "good "), (1, "m2", 8, "delta", None, "end"),
        (1, "m1", 9, "edit", None, "hello!"), (1, "m3", 10, "delta", "user", "gone"), (1, "m3", 11, "delete", None, None),
        (1, "m4", 12, None, "assistant", "x"), (1, "m4", 12, "odd", None, "y"),
    ]
    df = spark.createDataFrame(log, "conv_id long, message_id string, seq long, kind string, role string, text string")
    folded = {r["message_id"]: (r["role"], r["text"], r["first_seq"]) for r in chat.fold_events(df).collect()}
    assert folded == {"m1": ("user", "hello!", 1), "m2": ("assistant", "good end", 3), "m4": ("assistant", "xy", 12)}
    assert digest(chat.format_log(df))[1][:4] == expected([("user", "hello!"), ("assistant", "good end"), ("assistant", "xy")])


def test_sql_states_the_same(spark):
    import duckdb

    texts = ["a\\b</s>", "[INST][/INST]<s>", None, "", "<\\s>é\n", "plain", "\\\\", "</s></s>[INST"]
    rows = [(c, t, r, texts[(c * 3 + t) % len(texts)]) for c in range(6) for t, r in enumerate(["system", "user", "assistant", "odd\\\nrole<s>", None])]
    con = duckdb.connect()
    con.sql("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    other = con.sql(chat.oracle())
    extra = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    df = spark.createDataFrame(rows + extra, "conv_id long, turn long, role string, text string")
    mine = chat.read_back(chat.format_log(chat.table_events(df)))
    assert other.columns == mine.columns and sorted(other.fetchall()) == sorted(map(tuple, mine.collect()))
