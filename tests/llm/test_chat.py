import random

from pyspark.sql import functions as F

from tidemark.llm import chat as m

SCHEMA = "conv_id long, turn long, role string, text string, window string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def chats():
    rng = random.Random(1)
    rows = [(1, 0, "system", "be good"), (2, 0, "system", "only"), (3, None, None, None), (3, 1, "user", None), (None, 1, "user", "hi"), (None, 2, "assistant", "yo")]
    rows += [(4, 5, "assistant", "same"), (4, 5, "assistant", "same"), (4, 5, "user", "same")]
    rows += [(5, i, ("user", "assistant")[i % 2], m.CONTROL + "\\b\\n\\c\\" + "<" + "|" * (i % 3)) for i in range(4)] + [(5, 9, "odd\nrole<|x\\", "t\n\nt")]
    for c in range(10, 20):
        n = rng.randrange(1, 400 if c == 10 else 30)
        for t in range(n):
            role = "system" if t == 0 and c % 2 else ("user", "assistant")[t % 2]
            rows.append((c, t * 7, role, "é🎉wort " * rng.choice([0, 1, 5, 60, 150, 900])))
    rows += [(1, t, ("user", "assistant")[t % 2], f"turn {t} " * 40) for t in range(1, 40)]
    return rows


def ordered(rows):
    by = {}
    for c, t, r, x in rows:
        r, x = r or "", x or ""
        esc = x.replace("\\", "\\b").replace("<|", "\\c")
        er = r.replace("\\", "\\b").replace("<|", "\\c").replace("\n", "\\n")
        by.setdefault(c, []).append(((t is not None, t or 0), er, esc, r, x))
    return {c: [(r, x) for *_, r, x in sorted(v)] for c, v in by.items()}


def test_read_back_gives_every_turn_and_target_once(spark):
    rows = chats()
    got = {r.conv_id: r for r in m.read_back(m.windows(frame(spark, rows))).collect()}
    want = ordered(rows)
    assert got.keys() == want.keys()
    for c, turns in want.items():
        assert got[c].turns == "".join(f"{r}\n{x}\n" for r, x in turns)
        assert got[c].loss == "".join(x for r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)


def test_windows_keep_the_budget_the_system_turn_and_limited_history(spark):
    rows = chats()
    size = lambda x: -(-len(x.encode()) // 4) + 4
    found = m.windows(frame(spark, rows)).collect()
    texts = {c: [x.replace("\\", "\\b").replace("<|", "\\c") for _, x in v] for c, v in ordered(rows).items()}
    assert any(r.n_history for r in found)
    by = {}
    for r in sorted(found, key=lambda r: (str(r.conv_id), r.window)):
        by.setdefault(r.conv_id, []).append(r)
    for c, ws in by.items():
        at = ws[0].n_system
        for w in ws:
            sizes = list(map(size, texts[c]))
            new = sum(sizes[at : at + w.n_new])
            old = sum(sizes[at - w.n_history : at])
            system = sizes[0] if w.n_system else 0
            assert old <= m.HISTORY
            assert w.n_new == 1 or system + old + new <= max(m.BUDGET, system + m.HISTORY + m.BUDGET // 4)
            assert w.formatted.count(m.START) == w.n_system + w.n_history + w.n_new
            if w.n_system:
                assert w.formatted.startswith(f"{m.START}system\n")
            at += w.n_new
        assert at == len(texts[c])


def test_escape_reverses(spark):
    texts = ["", "\\", "\\\\n", "<|", "<\\|", "\\c<|", "a\\bc", "<<||", m.CONTROL]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select("t", m.escape(F.col("t")).alias("e"), m.unescape(m.escape(F.col("t"))).alias("u")).collect()
    assert all(r.t == r.u and "<|" not in r.e for r in out)


def test_plan_is_native_and_empty_table(spark, capsys):
    df = m.read_back(m.windows(frame(spark, [])))
    assert df.collect() == []
    m.read_back(m.windows(frame(spark, chats()))).explain()
    assert "Python" not in capsys.readouterr().out


def test_very_long_turns_and_conversations_with_clashing_columns(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "<|\\" * 500_000), (1, 2, "assistant", "é" * 2_000_000)]
    rows += [(2, t, ("user", "assistant")[t % 2], f"turn {t}") for t in range(20_000)]
    df = frame(spark, rows)
    for name in ("formatted", "n_new", "tokens", "start"):
        df = df.withColumn(name, F.lit("x"))
    got = {r.conv_id: r for r in m.read_back(m.windows(df)).collect()}
    for c, turns in ordered(rows).items():
        assert got[c].turns == "".join(f"{r}\n{x}\n" for r, x in turns)
        assert got[c].loss == "".join(x for r, x in turns if r == "assistant")
