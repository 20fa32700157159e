from __future__ import annotations

from retention_spark.llm import preference

SCHEMA = "pair_id long, chosen boolean, turn long, role string, text string, place string"


def _rows(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def _brute(rows):
    """{pair: row} for rows whose turns are numbered without gaps or ties."""
    out = {}
    for pair in {r[0] for r in rows if r[0] is not None}:
        sides = {s: sorted({(t, (r or "").replace("<|", "< |"), (x or "").replace("<|", "< |"))
                            for p, s2, t, r, x in rows if p == pair and s2 == s})
                 for s in (True, False)}
        same = 0
        for a, b in zip(sides[True], sides[False], strict=False):
            if a != b:
                break
            same += 1

        def render(turns):
            text, loss = "", []
            for _, role, said in turns:
                head = f"<|{role}|>\n"
                if role == "assistant":
                    begin = len(text) + len(head)
                    loss.append(f"{begin}:{begin + len(said) + 8}")
                text += head + said + "<|end|>\n"
            return text, ",".join(loss)

        (a, la), (b, lb) = render(sides[True][same:]), render(sides[False][same:])
        out[pair] = (same, render(sides[True][:same])[0], a, b, la, lb)
    return out


def _got(df):
    return {r.pair_id: (r.prompt_turns, r.prompt, r.chosen, r.rejected, r.chosen_loss,
                        r.rejected_loss) for r in df.collect()}


def test_pairs(spark):
    rows = []
    talk = [("system", "be kind"), ("user", "hé 😀"), ("assistant", "yes"), ("user", "<|end|> ok"),
            ("assistant", "bye")]
    for side in (True, False):
        for t, (role, text) in enumerate(talk):
            rows.append((1, side, t, role, text))  # equal versions
            rows.append((2, side, t, role, text if side or t < 3 else text + "!"))
            if side or t < 2:
                rows.append((3, side, t, role, text))  # one version ends early
        rows.append((4, side, 0, None, None))
        rows.append((5, side, 0, "assistant", "a" if side else ""))
    rows += [(6, True, 0, "user", "no rejected version"), (7, False, 0, "assistant", "x" * 200_000),
             (2, True, 0, "system", "be kind"), (None, True, 0, "user", "x"), (8, None, 0, "user", "x")]
    got = _got(preference.formatted_pairs(_rows(spark, rows)))
    assert got == _brute([r for r in rows if r[1] is not None and r[0] != 8])


def test_long_conversations_are_one_row(spark):
    rows = [(1, side, t, "assistant" if t % 2 else "user", f"{t}{side if t > 1500 else ''}")
            for side in (True, False) for t in range(5100)]
    rows += [(2, side, t - 5, "assistant" if t % 3 else "user", f"{t}{side if t > 3 else ''}")
             for side in (True, False) for t in range(1031)]
    got = _got(preference.formatted_pairs(_rows(spark, rows)))
    assert got == _brute(rows) and got[1][0] == 1501
    late = _got(preference.formatted_pairs(_rows(spark, [*rows, (1, True, None, "user", "late")])))
    assert late[1][2] == got[1][2] + "<|user|>\nlate<|end|>\n" and late[1][3:] == got[1][3:]


def test_only_the_last_reply_is_swapped(spark):
    talks = [(1, 0, "user", "q"), (1, 1, "assistant", "a1"), (2, 0, "user", "q2"),
             (2, 1, "assistant", "a2"), (2, 2, "user", "thanks"), (4, 0, "user", "alone"),
             (4, 1, "assistant", None), (5, None, None, None), (None, 0, "assistant", "z")]
    talks = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string")
    got = _got(preference.formatted_pairs(preference.reply_pairs(talks)))
    assert set(got) == {1, 2, 4, 5}
    assert got[1][2:4] == ("<|assistant|>\na1<|end|>\n", "<|assistant|>\na2<|end|>\n")
    assert got[2][0] == 1 and got[2][3] == "<|assistant|>\n<|end|>\n<|user|>\nthanks<|end|>\n"
    assert got[4][0] == 2 and got[4][2] == "" and got[5][0] == 1


def test_empty_table(spark):
    assert preference.formatted_pairs(_rows(spark, [])).collect() == []


def test_plan_stays_in_the_jvm(spark):
    plan = preference.formatted_pairs(_rows(spark, [(1, True, 0, "user", "x")]))
    text = plan._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text
