"""Template windows: copies, re-parameterised questions, near misses."""

import pytest

from ravelin.llm import templates

ITEM = (
    "A train leaves Boston at 9 and travels 120 km before it meets the train of Alice who waits "
    "for 45 minutes near the old bridge and then drives another 60 km to see Bob."
)
FILL = "some plain words that say nothing of note here and go on for a while without any aim"


def swap(text, *pairs):
    for a, b in pairs:
        text = text.replace(a, b)
    return text


CASES = [
    ("copy", f"{FILL}. {ITEM} {FILL}", True, True),
    ("other slots", f"{FILL} {swap(ITEM, ('Boston', 'Paris'), ('120', '75'), ('Alice', 'Maria'), ('45', '30'))}", True, False),
    ("unit changed", swap(ITEM, ("120 km", "120 miles"), ("60 km", "60 miles")), True, False),
    ("inconsistent", swap(ITEM, ("120 km", "75 miles"), ("60 km", "75 kg"), ("45", "75"), ("9 ", "75 ")), False, False),
    ("half", " ".join(ITEM.split()[:16]) + " " + FILL, False, False),
    ("clean", FILL, False, False), ("empty", "", False, False), ("null", None, False, False),
]


def test_cases(spark):
    rows = [(i, t, "z") for i, (_, t, _, _) in enumerate(CASES)]
    rows += [(0, FILL, "z"), rows[0], (None, ITEM, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _item string").selectExpr("*", "3 AS w", "4 AS pos")
    items = spark.createDataFrame([(7, ITEM), (8, None), (9, ""), (7, ITEM), (10, "short one")], "item_id long, text string")
    found = templates.contaminated(docs, "doc_id", "text", items, "item_id", "text").collect()
    got = {(r["_key"], r["_item"], r["same_words"]) for r in found}
    assert got == {(i, 7, same) for i, (_, _, hit, same) in enumerate(CASES) if hit} | {(None, 7, True)}
    kept = templates.without_contaminated(docs, "doc_id", "text", items, "item_id", "text")
    assert kept.columns == docs.columns
    left = sorted(str((r["doc_id"], r["text"])) for r in kept.collect())
    clean = [(i, t) for i, (_, t, hit, _) in enumerate(CASES) if not hit] + [(0, FILL)]
    assert left == sorted(map(str, clean))
    for d, b in ((docs.limit(0), items), (docs, items.limit(0))):
        assert templates.contaminated(d, "doc_id", "text", b, "item_id", "text").count() == 0


def plain(docs, items):
    """Pairs by exact five-word containment of four fifths, for texts without slots."""
    def shingles(text):
        words = [w.strip(templates.STRIPPED).lower() for w in text.split()]
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    return {
        (d, i) for d, t in docs for i, x in items
        if len(shingles(t) & shingles(x)) * 5 >= 4 * len(shingles(x))
    }


def test_texts_without_slots_match_by_shingles(spark):
    import random

    draw = random.Random(2)
    words = [f"{a}{b}" for a in "bcdfg" for b in ("a", "e", "i", "o")]
    items = [(i, " ".join(draw.choices(words, k=draw.randint(8, 30)))) for i in range(25)]
    items += [(30, "common words in all items " + items[0][1])]
    docs = []
    for i in range(60):
        own = draw.choice(items)[1].split()
        for _ in range(draw.randint(0, 2)):
            own[draw.randrange(len(own))] = "zz"
        docs.append((i, " ".join(draw.choices(words, k=20) + own + draw.choices(words, k=20))))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = templates.contaminated(frame, "doc_id", "text", bench, "item_id", "text").collect()
    assert {(r["_key"], r["_item"]) for r in found} == plain(docs, items)


@pytest.mark.parametrize("limit", [5, 10_000])
def test_reader_forgets_without_harm(limit, monkeypatch):
    monkeypatch.setattr(templates, "REMEMBERED", limit)
    reader = templates.Reader()
    first = reader.windows(ITEM, 5)[0].tolist()
    reader.windows(FILL, 5)
    assert reader.windows(ITEM, 5)[0].tolist() == first


YEARS = ITEM + " The line was built in 1901 and the bridge was built in 1901 as well by workers from Leeds."
LOOSE = [
    ("two values become one", swap(ITEM, ("at 9", "at 30"), ("45", "30"), ("Alice", "Maria"), ("Bob", "Maria")), 0, True, False),
    ("one of two years changed", YEARS.replace("1901", "1902", 1), 1, True, True),
    ("name misspelt once", swap(ITEM + " Alice waves and then Alice sleeps in the quiet old station.", ("of Alice", "of Alcie")), 2, True, True),
    ("misspelt under other names", swap(ITEM + " Now Alice waves and then Alice sleeps in the quiet old station.",
                                        ("of Alice", "of Maira"), ("Alice", "Maria")), 3, True, False),
    ("no value for most places", swap(YEARS, ("in 1901 and", "in 1850 and"), ("in 1901 as", "in 1860 as"),
                                      ("120 km", "75 miles"), ("60 km", "75 kg")), 1, False, False),
]


def test_slots_are_judged_by_window(spark):
    bench = [ITEM, YEARS, ITEM + " Alice waves and then Alice sleeps in the quiet old station.",
             ITEM + " Now Alice waves and then Alice sleeps in the quiet old station."]
    docs = spark.createDataFrame([(i, t) for i, (_, t, *_) in enumerate(LOOSE)], "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")
    found = templates.contaminated(docs, "doc_id", "text", items, "item_id", "text").collect()
    got = {(r["_key"], r["_item"]): r["same_words"] for r in found}
    for i, (name, _, item, hit, same) in enumerate(LOOSE):
        assert got.get((i, item)) == (same if hit else None), name


DENSE = "mix 5 g 7 ml salt 30 g 9 ml rice 12 kg 8 cm oil 4 l 3 mm tea 6 lb 2 oz"
BENCH = [
    (1, "the first question has nine quite ordinary words here"), (1, "another text of that same id is asked about rain"),
    (None, "an item that has no id at all is still an item"), (None, "some second item without any id asks about snow"),
    (2, "purple elephants dance"), (3, "xylophone"), (4, DENSE), (5, "saw Paris 1789"), (6, "71 72 73 74 75 76"),
]
HELD = [
    (f"{FILL} {BENCH[0][1]} {FILL}", {1}), (f"{FILL} {BENCH[1][1]} {FILL}", {1}), (f"{FILL} {BENCH[2][1]} {FILL}", {None}),
    (f"{FILL} {BENCH[3][1]}", {None}), (f"{FILL} Purple elephants dance, {FILL}", {2}), (f"{FILL} xylophone {FILL}", {3}),
    (f"{FILL} {swap(DENSE, ('5 g', '15 g'), ('30 g', '31 g'), ('9 ml', '19 ml'), ('12 kg', '22 kg'), ('8 cm', '18 cm'))} {FILL}", {4}),
    (f"{FILL} saw Paris 1789 {FILL}", {5}), (f"{FILL} saw Berlin 1848 {FILL}", set()), ("purple elephants", set()),
    (f"{FILL} 71 72 73 74 75 76 {FILL}", {6}), (f"{FILL} 1 2 3 4 5 6 {FILL}", set()), (FILL, set()),
]


def test_every_item_can_be_found(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(HELD)], "doc_id long, text string")
    items = spark.createDataFrame(BENCH, "item_id long, text string")
    found = templates.contaminated(docs, "doc_id", "text", items, "item_id", "text").collect()
    assert len({(r["_key"], r["_item"], r["_item_hash"]) for r in found}) == len(found)
    for i, (text, wanted) in enumerate(HELD):
        assert {r["_item"] for r in found if r["_key"] == i} == wanted, text
