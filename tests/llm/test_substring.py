"""Repeated windows against a plain walk over all windows."""

import random

from ravelin.llm import substring


def plain(rows, window):
    seen, out = set(), []
    for key, text in rows:
        words = (text or "").split()
        keep = [True] * len(words)
        for i in range(len(words) - window + 1):
            own = tuple(words[i : i + window])
            if own in seen:
                keep[i : i + window] = [False] * window
            seen.add(own)
        kept = [w for w, k in zip(words, keep, strict=True) if k]
        out.append((key, len(words), len(words) - len(kept), " ".join(kept)))
    return out


def texts(draw, n):
    words = [f"w{i}" for i in range(30)]
    pool = [[draw.choice(words) for _ in range(draw.randint(5, 40))] for _ in range(12)]
    made = []
    for _ in range(n):
        parts = [draw.choice(pool) for _ in range(draw.randint(0, 5))]
        made.append(" ".join(w for p in parts for w in p[draw.randint(0, 3) :]))
    return made


def test_same_as_a_walk(spark):
    draw = random.Random(8)
    made = texts(draw, 80)
    made += [made[0], made[0], None, "", " ".join(["ab cd ef"] * 60), " ".join(["x"] * 300), "one two"]
    rows = list(enumerate(made))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for window in (20, 7):
        got = substring.dedup(df, "doc_id", "text", window).orderBy("doc_id").collect()
        assert [tuple(r) for r in got] == plain(rows, window)


def test_columns_nulls_and_repeated_rows(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [
        (2, f"a  b\n{passage}", "x", 9), (None, f"{passage} tail", "y", 8), (3, None, None, None),
        (4, "kept \t as it is", "z", 7), (4, f"{passage}", "z", 7), (4, f"{passage}", "z", 7),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, segs string, n_words long")
    out = substring.without_repeats(df, "doc_id", "text", size="n_words")
    assert out.columns == df.columns
    got = out.collect()
    assert len(got) == 6
    assert {tuple(r) for r in got} == {
        (2, "a b", "x", 3), (None, f"{passage} tail", "y", 8), (3, None, None, None),
        (4, "kept \t as it is", "z", 7), (4, "", "z", 0),
    }
    assert substring.dedup(df.limit(0), "doc_id", "text").count() == 0


def test_a_collision_is_seen_and_repeated(spark, monkeypatch):
    real, calls = substring.attempt, []

    def once(docs, window, seed):
        result, wrong = real(docs, window, seed)
        calls.append(seed)
        return result, 1 if len(calls) == 1 else wrong

    monkeypatch.setattr(substring, "attempt", once)
    df = spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id long, text string")
    out = substring.dedup(df, "doc_id", "text", 3).orderBy("doc_id").collect()
    assert [r["n_removed"] for r in out] == [0, 3]
    assert calls == [42, 43]
