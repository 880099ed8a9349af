import duckdb

from spanloom.llm import quotes

ROWS = [
    (1, 0, "user", "Hello there.\n\nSecond paragraph, with two\nlines in it."),
    (1, 1, "assistant", "> Second paragraph, with two\n> lines in it.\nI agree."),
    (1, 2, "user", ">> Hello there.\n> I agree.\n\nThanks!"),
    (1, 3, "user", "> nobody wrote this\nwell"),
    (1, 4, "assistant", "> hello THERE\nback to the start"),
    (2, 0, "user", "> Hello there.\nother conversation"),
    (2, 1, None, None),
    (2, 2, "user", ""),
    (None, 0, "user", "> x"),
    (3, None, "user", "y"),
    (4, 7, "user", "same"),
    (4, 7, "user", "same"),
    (4, 8, "user", "> same"),
    (5, 0, "user", "> a\nb\n> > c\n>d"),
    (6, 0, "user", "  blanks stay \n"),
    (6, 1, "user", "> blanks   STAY\n a > b "),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'q' as level", "1 as original", "'h' as hash")


def test_links(spark):
    rows = quotes.conversations(frame(spark)).collect()
    assert len(rows) == len(ROWS)
    got = {(r.conv_id, r.turn): (r.reply_to, r.link, r.n_quotes > 0, r.max_level) for r in rows}
    assert got[1, 0] == (None, "none", False, 0)
    assert got[1, 1] == (0, "quote", True, 1)
    assert got[1, 2] == (1, "quote", True, 2)
    assert got[1, 3] == (2, "previous", False, 1)
    assert got[1, 4] == (0, "quote", True, 1)
    assert got[2, 0][:2] == (None, "none") and got[2, 2][:2] == (1, "previous")
    assert got[4, 8][:2] == (7, "quote") and got[None, 0][:2] == (None, "none") and got[3, None][:2] == (None, "none")
    texts = {(r.conv_id, r.turn): r.text for r in rows}
    assert texts[1, 1] == "I agree." and texts[2, 1] == "" and texts[5, 0] == "b"
    assert texts[6, 0] == "  blanks stay \n" and texts[6, 1] == "a > b" and got[6, 1][:2] == (0, "quote")


def test_chat_and_empty(spark):
    own = quotes.chat(frame(spark)).filter("conv_id = 1 and turn = 1").first()
    assert own.chat == "<|assistant|>\nI agree.<|end|>\n"
    assert quotes.conversations(frame(spark).limit(0)).count() == 0


def test_long_quotes(spark):
    lines = "\n".join(f"> line {i}" for i in range(5000))
    body = "\n".join(f"line {i}" for i in range(5000))
    got = quotes.conversations(frame(spark, [(1, 0, "u", body), (1, 5, "u", lines + "\nyes")])).filter("turn = 5").first()
    assert (got.reply_to, got.n_quotes, got.text) == (0, 5001, "yes")


def test_sql_agrees(spark):
    whole = [r for r in ROWS if None not in r[:2]]
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", whole)
    want = con.execute(quotes.SQL)
    names = [d[0] for d in want.description]
    got = quotes.conversations(frame(spark, whole)).select(*names).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)


def test_native_plan(spark):
    plan = quotes.conversations(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_threads(spark):
    rows = quotes.conversations(frame(spark)).collect()
    got = {(r.conv_id, r.turn): (r.root, r.depth) for r in rows}
    assert [got[1, t] for t in range(5)] == [(0, 0), (0, 1), (0, 2), (0, 3), (0, 1)]
    assert got[2, 2] == (0, 2) and got[4, 7] == (7, 0) and got[4, 8] == (7, 1) and got[None, 0] == (0, 0) and got[3, None] == (None, 0)
    long = [(1, t, "u", f"turn {t}") for t in range(300)] + [(1, 400 + t, "u", f"> turn {t * 50}\nanswer {t}") for t in range(3)]
    deep = {r.turn: (r.root, r.depth) for r in quotes.conversations(frame(spark, long)).collect()}
    assert all(deep[t] == (0, t) for t in range(300)) and [deep[400 + t] for t in range(3)] == [(0, 1), (0, 51), (0, 101)]


def test_announcing_lines(spark):
    text = "Hello.\nOn Mon, 3 May, A B <a@b.c> wrote:\n> first\n\nOn this he wrote:\nno quote\nAm 3. Mai schrieb X:\n> first\nEnd"
    rows = [(1, 0, "u", "first"), (1, 1, "u", text), (1, 2, "u", "On Monday X wrote:\nplain")]
    got = {r.turn: (r.text, r.reply_to) for r in quotes.conversations(frame(spark, rows)).collect()}
    assert got[1] == ("Hello.\n\nOn this he wrote:\nno quote\nEnd", 0) and got[2] == ("On Monday X wrote:\nplain", 1)
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    want = con.execute(quotes.SQL)
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, quotes.conversations(frame(spark, rows)).select(*names).collect())) == sorted(want.fetchall())
