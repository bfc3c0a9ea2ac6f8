"""Heavy-hitter split against plain grouping."""

import hashlib
import random
import string

import pytest

from ravelin.llm import exact_dedup
from ravelin.llm.exact_dedup import Summary

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain(rows):
    groups = {}
    for key, text in rows:
        groups.setdefault((text or "").translate(LOWER), []).append(key)
    out = []
    for key, text in rows:
        text = (text or "").translate(LOWER)
        keep = max(groups[text], key=lambda k: (k is not None, k))
        out.append((key, keep, len(groups[text]), key == keep, hashlib.sha256(text.encode()).digest()))
    return sorted(out, key=str)


def corpus():
    draw = random.Random(3)
    rows = [(i, "The common Text") for i in range(400)]
    rows += [(1000 + i, draw.choice(["a", "A", "b", "Ä", "ä", "", None, "İ", "i", "x " * 40_000])) for i in range(80)]
    rows += [(2000 + i, f"text {i}") for i in range(300)] + [(2000 + i, f"TEXT {i}") for i in range(0, 300, 7)]
    rows += [(None, "a"), (None, "alone"), (5000, "twice"), (5000, "twice"), (-3, "the common text")]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("counters", [1, 3, 4096])
def test_same_as_plain_grouping(spark, counters):
    rows = corpus()
    df = spark.createDataFrame(rows, "k long, t string").repartition(7)
    out = exact_dedup.duplicates(df, "k", "t", counters).collect()
    assert sorted([(*r[:4], bytes(r[4])) for r in out], key=str) == plain(rows)


def test_keep_last_leaves_one_row_a_text_as_it_is(spark):
    rows = [(k, t, i, "d") for i, (k, t) in enumerate(corpus())]
    df = spark.createDataFrame(rows, "`_0_` long, t string, id int, d string")
    out = [tuple(r) for r in exact_dedup.keep_last(df, "_0_", "t", 4).collect()]
    assert exact_dedup.keep_last(df, "_0_", "t").columns == df.columns and set(out) <= set(rows)
    stay = {(keep, text) for _, keep, _, _, text in plain([r[:2] for r in rows])}
    found = [(r[0], hashlib.sha256((r[1] or "").translate(LOWER).encode()).digest()) for r in out]
    assert sorted(found, key=str) == sorted(stay, key=str)
    assert exact_dedup.keep_last(df.limit(0), "_0_", "t").count() == 0
    assert exact_dedup.duplicates(df.limit(0), "_0_", "t").count() == 0


def test_frequent_values_are_found_and_few(spark):
    draw = random.Random(5)
    values = [b"hot"] * 300 + [b"warm"] * 120 + [str(draw.randrange(5000)).encode() for _ in range(600)]
    draw.shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "d binary").repartition(5)
    for counters in (4, 10, 50):
        found = {bytes(r[0]) for r in exact_dedup.frequent(df, counters).collect()}
        sure = {v for v in set(values) if values.count(v) >= 2 * len(values) / (counters + 1)}
        assert sure <= found and len(found) <= counters + 1


def test_summary_understates_by_its_bound():
    draw = random.Random(1)
    items = [draw.choice("aaaaabbbcdefghijklmnop") for _ in range(2000)]
    for size in (1, 2, 5, 30):
        summary = Summary(size)
        for start in range(0, 2000, 90):
            part = items[start : start + 90]
            summary.add(part, [1] * len(part))
        assert len(summary.counts) <= size
        for item in set(items):
            true = items.count(item)
            assert true - 2000 / (size + 1) <= summary.counts.get(item, 0) <= true
