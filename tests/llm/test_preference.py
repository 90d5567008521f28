import random

import pytest

from screenlens.llm.preference import digest, formatted, paired, preference_format, swapped_answers

SCHEMA = "pair_id long, turn long, role string, text string, block string, at string"


def render(role, text):
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


def brute(chosen, rejected):
    def clean(rows):
        out = {}
        for k, t, r, x in rows:
            if k is not None and t is not None:
                row = (r or "", x or "")
                out.setdefault(k, {})
                out[k][t] = min(out[k].get(t, row), row)
        return out

    a, b, found = clean(chosen), clean(rejected), []
    for k in set(a) | set(b):
        c, r = a.get(k, {}), b.get(k, {})
        turns = sorted(set(c) | set(r))
        parting = min((t for t in turns if c.get(t) != r.get(t)), default=None)
        common = [t for t in turns if parting is None or t < parting]
        row = [k, len(common), "".join(render(*c[t]) for t in common)]
        texts, spans = [], []
        for side in (c, r):
            text, found_spans = "", []
            for t in turns:
                if t not in common and t in side:
                    head = len(f"<|im_start|>{side[t][0]}\n")
                    piece = render(*side[t])
                    if side[t][0] == "assistant":
                        found_spans.append((len(text) + head, len(text) + len(piece)))
                    text += piece
            texts.append(text)
            spans.append(found_spans)
        found.append((*row, *texts, *spans))
    return sorted(found)


def plain(rows):
    return sorted((*r[:5], *[[tuple(s) for s in spans] for spans in r[5:]]) for r in rows)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


@pytest.mark.parametrize("block", [1024, 3])
def test_matches_brute_force(spark, rows, block):
    rng = random.Random(7)
    chosen, rejected = [], []
    for k in range(40):
        turns = [(k, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None])) for t in range(rng.randint(0, 9))]
        chosen += turns
        cut = rng.randint(0, 9)
        rejected += turns[:cut] + [(k, t, "assistant", rng.choice(["c", "a"])) for t in range(cut, rng.randint(cut, 10))]
    chosen += [(None, 1, "user", "x"), (99, None, "user", "x"), (98, 1, "user", "only chosen"), (97, 0, "user", "z" * 100_000)]
    chosen += chosen[5:9] + [(97, 0, "user", "a tie of turns")]
    rejected += [(96, 3, "assistant", "only rejected"), (95, -2, "user", "a"), (95, 2**40, "assistant", "b")]
    got = plain(rows(preference_format(table(spark, chosen), table(spark, rejected), block=block)))
    assert got == brute(chosen, rejected)


def test_one_long_conversation(spark, rows):
    chosen = [(1, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(5000)]
    rejected = chosen[:3000] + [(1, t, "assistant", "other") for t in range(3000, 3100)]
    got = plain(rows(preference_format(table(spark, chosen), table(spark, rejected))))
    assert len(got) == 1 and got == brute(chosen, rejected)


def test_one_answer_in_a_long_conversation_is_one_pair(spark, rows):
    chosen = [(1, t + 10**6, "user", "same") for t in range(3000)]
    rejected = [*chosen[:2999], (1, 10**6 + 2999, "assistant", "other")]
    got = plain(rows(preference_format(table(spark, chosen), table(spark, rejected))))
    assert [(r[1], len(r[4])) for r in got] == [(2999, len(render("assistant", "other")))]


def test_empty_tables(spark, rows):
    none = table(spark, [])
    assert rows(preference_format(none, none)) == []
    talk = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert rows(formatted(paired(swapped_answers(talk)))) == []


def answers(rows):
    """One pair of every conversation, straight from the definition."""
    talks = {}
    for k, t, role, text in rows:
        if k is not None and t is not None:
            talks.setdefault(k, []).append((t, role, text or ""))
    last = {k: max((t, x) for t, r, x in talk if r == "assistant") for k, talk in talks.items() if any(r == "assistant" for _, r, _ in talk)}
    chosen, rejected = [], []
    for k, t, role, text in rows:
        chosen.append((k, t, role, text))
        if k not in last or t is None or t < last[k][0]:
            rejected.append((k, t, role, text))
    for k, (t, _) in last.items():
        if k ^ 1 in last:
            rejected.append((k, t, "assistant", last[k ^ 1][1]))
    return chosen, rejected


def test_every_conversation_is_a_pair(spark, rows):
    rng = random.Random(9)
    ids = [*range(0, 40, 3), 100, 101, 102, 2**40]  # with gaps, so that partners are missing
    talk = [(7, 0, "user", "no answer"), (6, 0, "user", "q"), (6, 1, "assistant", "a"), (300, 1, "assistant", "x"), (301, 4, "assistant", "x")]
    for k in ids:
        for t in range(rng.randint(1, 8)):
            talk.append((k, t, rng.choice(["user", "assistant", "system", None]), rng.choice(["a", "b", "é", "", None])))
    talk += [*talk[:3], (None, 0, "user", "x"), (6, None, "user", "x"), (300, 2, "user", "after the answer")]
    df = spark.createDataFrame([(*r, "x", "y") for r in talk], "conv_id long, turn long, role string, text string, block string, at string")
    got = plain(rows(formatted(paired(swapped_answers(df)))))
    assert got == brute(*answers(talk))
    assert {r[0] for r in got} == {k for k, t, _, _ in talk if k is not None and t is not None}


def test_every_sample_conversation_and_sql(spark):
    import duckdb

    from screenlens.llm.preference import SQL

    path = "/root/testdata/sf0.01/conversations.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
    talk = spark.read.parquet(path)
    got = digest(formatted(paired(swapped_answers(talk))))
    assert got.count() == talk.select("conv_id").distinct().count() == 100
    sql = con.execute(SQL)
    names = [d[0] for d in sql.description]
    assert sorted(map(tuple, got.select(names).collect())) == sorted(sql.fetchall())
