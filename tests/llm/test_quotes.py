"""Quotation linking on conversations with quotes, against its SQL counterpart."""

import random

import duckdb
import pyarrow as pa

from newslens.llm import chat

SPEC = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "turn", "role", "text", "n_quotes", "parent_turn", "thread_turn", "depth", "position")


def conversations(seed, n, hot=0.2):
    """Replies that quote whole messages, parts or quotes in them, with credit lines, ties and a frequent passage."""
    r = random.Random(seed)
    line = lambda: " ".join(r.choice(["Yes", "no", "why not", "über", "la vie", "x  y", "Ok."]) for _ in range(r.randint(1, 4)))
    rows = []
    for c in range(n):
        said: list[str] = []
        for t in range(r.randint(1, 9)):
            parts = []
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                if said:
                    old = r.choice(said).split("\n")
                    if r.random() < 0.5:
                        i = r.randrange(len(old))
                        old = old[i : i + r.randint(1, 3)]
                    if r.random() < 0.3:
                        parts.append(r.choice(["On Monday A wrote:", "Am Montag schrieb:", "Le lundi, B a écrit :"]))
                    mark = r.choice(["> ", ">", " > "])
                    parts += [mark + (x.upper() if r.random() < 0.2 else x) for x in old]
                parts += [line() for _ in range(r.randint(0, 2))] + [""] * r.randint(0, 1)
            if r.random() < hot:
                parts.append("Hello everybody")
            said.append("\n".join([*parts, *(line() for _ in range(r.randint(0, 3)))]))
            rows.append((c, t, r.choice("ab"), said[-1]))
            if r.random() < 0.05:
                rows.append(rows[-1])
    return [*rows, (None, 1, "a", "> Yes\nno"), (n, None, "a", "> Yes"), (n, 3, "b", None), (n, 4, "b", "")]


def test_against_sql(spark):
    rows = conversations(1, 120)
    table = pa.table({"conv_id": pa.array([r[0] for r in rows], pa.int64()), "turn": pa.array([r[1] for r in rows], pa.int64()), "role": [r[2] for r in rows], "text": pa.array([r[3] for r in rows], pa.string())})
    con = duckdb.connect()
    con.register("conversations", table)
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({chat.ORACLE})").fetchall()
    got = [tuple(-1 if c == "parent_turn" and r[c] is None else r[c] for c in COLUMNS) for r in chat.link_quotes(spark.createDataFrame(rows, SPEC)).collect()]
    assert sum(r[5] >= 0 for r in got) > 50 and max(r[7] for r in got) > 2
    for g, w in zip(sorted(got, key=str), sorted(want, key=str), strict=True):
        assert g == w


def test_order_puts_replies_after_what_they_answer(spark):
    got = [r for r in chat.link_quotes(spark.createDataFrame(conversations(2, 60), SPEC)).collect() if r["position"] is not None]
    place = {(r["conv_id"], r["turn"]): r["position"] for r in got}
    assert all(r["parent_turn"] is None or place[r["conv_id"], r["parent_turn"]] < r["position"] for r in got)
    assert not any(x.lstrip().startswith(">") for r in got for x in (r["text"] or "").split("\n"))
