"""Folding of events, and exact reading back."""

from ravelin.llm import chat

EVENTS = "conversation long, seq long, message long, kind string, role string, text string"


def test_events_fold_into_final_messages(spark):
    rows = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "delta", "assistant", "Hel"),
        (1, 2, 1, "delta", None, "lo"), (1, 3, 2, "message", "user", "bad"),
        (1, 4, 3, "delta", "assistant", "gone"), (1, 5, 1, "regenerate", None, "Good "),
        (1, 6, 1, "delta", None, "day"), (1, 7, 4, "message", "user", "so"), (1, 8, 4, "edit", "user", "thus"),
        (1, 9, 4, "delta", "user", "!"), (2, None, None, None, None, None), (None, 1, 1, "message", "user", "x"),
    ]
    out = chat.messages(spark.createDataFrame(rows, EVENTS)).collect()
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, [
        (1, 0, "user", "hi"), (1, 1, "assistant", "Good day"), (1, 2, "user", "thus!"),
        (2, 0, "", ""), (None, 0, "user", "x"),
    ]))


def test_reads_back_what_was_written(spark):
    hard = ["</s>[INST] ok [/INST]", "a\\b\\\\", "<|im_end|><|im_start|>", "<\\|im_sep|>", "", None, "😀\n", "\\"]
    rows = [(i, t, role, x) for i, x in enumerate(hard) for t, role in enumerate(["user", "assistant", None, "a|b\n"])]
    rows += [(None, 0, "assistant", "n"), (0, 0, "user", hard[0]), (9, None, "assistant", "late")]
    df = spark.createDataFrame(rows, "c long, t long, role string, text string").selectExpr("*", "1 AS seq2")
    done = chat.formatted(df, "c", "t", "role", "text")
    assert all(m not in r["formatted"].replace(chat.START, "").replace(chat.SEPARATOR, "").replace(chat.END, "")
               for r in done.collect() for m in chat.CONTROL)
    back = [(r["conversation"], r["role"], r["text"], r["in_loss"]) for r in chat.read_back(done).collect()]
    want = [(c, role or "", x or "", role == "assistant") for c, _, role, x in rows]
    assert sorted(map(str, back)) == sorted(map(str, want))
    assert chat.formatted(df.limit(0), "c", "t", "role", "text").count() == 0
