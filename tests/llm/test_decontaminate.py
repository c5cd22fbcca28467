"""Re-parameterised benchmark items: measured recall and false alarms, slots by hand, and the plan at any number of hashes."""

import random

import numpy as np
import pytest

from scholia.llm import common, decontaminate
from scholia.llm.decontaminate import NAME, NUMERAL, OPENING, PLAIN, UNIT, clean_documents, contamination, typed

NAMES = ["Alice", "Bob", "Carol Lee", "New York", "Paris", "Dmitri", "Lake Victoria", "Quito", "Ngozi", "San Juan Hill"]
UNITS = ["km", "miles", "kg", "hours", "days", "dollars", "liters", "minutes"]


def template(rng, text):
    """The item's words with slots among them: names, numbers with units apart and glued, and a name that opens a sentence."""
    words = [w.lower().strip(".,") for w in text.split()][:40]
    for kind in rng.choices(["name", "number", "unit", "glued", "opening"], k=4):
        words.insert(rng.randrange(2, len(words) - 1), ("slot", kind, rng.randrange(3)))
    return words


def filled(rng, words):
    """Each slot of one kind and number gets one value throughout; different ones get different values."""
    values, used = {}, set()
    out = []
    for w in words:
        if isinstance(w, str):
            out.append(w)
            continue
        if w not in values:
            while (v := value_of(rng, w[1])) in used:
                pass
            used.add(v)
            values[w] = v
        out.append(values[w])
    return "So it begins: " + " ".join(out) + "."


def value_of(rng, kind):
    n = str(rng.randrange(2, 900))
    return {"name": rng.choice(NAMES), "number": n, "unit": f"{n} {rng.choice(UNITS)}", "glued": f"{n}{rng.choice(['km', 'kg', 'h', 'ml'])}", "opening": f"done. {rng.choice(NAMES)}"}[kind]


@pytest.fixture(scope="module")
def planted(spark):
    """Items, and documents that hold each of them with every name, number and unit changed."""
    rng = random.Random(11)
    made = [template(rng, r.text) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()]
    items = [(i, filled(rng, t)) for i, t in enumerate(made)]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    clean = [r.text or "" for r in docs.orderBy("doc_id").limit(200).collect()]
    copies = [(10**6 + i, f"{clean[i]} {filled(rng, t)} {clean[i - 1][:300]}") for i, t in enumerate(made)]
    return spark.createDataFrame(items, "item_id bigint, text string"), docs, spark.createDataFrame(copies, docs.schema)


def ids_of(docs, found):
    return {r.doc_id for r in docs.withColumn("k", common.row_key()).join(found, "k").select("doc_id").collect()}


def test_recall_of_changed_items_and_false_alarms(spark, planted):
    bench, docs, copies = planted
    everything = docs.unionByName(copies)
    found = contamination(everything, bench).cache()
    got = ids_of(everything, found)
    recall = len([i for i in got if i >= 10**6]) / copies.count()
    alarms = len([i for i in got if i < 10**6]) / docs.count()
    print(f"recall {recall:.3f}, false alarms {alarms:.4f}")
    assert recall >= 0.9 and alarms <= 0.01
    per_item = {(r.doc_id - 10**6, r.item) for r in everything.withColumn("k", common.row_key()).join(found, "k").collect()}
    assert sum((i, i) in per_item for i in range(copies.count())) >= 0.9 * copies.count()


def test_more_hashes_than_a_filter_holds_give_the_same(spark, planted):
    bench, docs, copies = planted
    some = copies.limit(30).unionByName(docs.limit(100))
    want = {tuple(r) for r in contamination(some, bench).collect()}
    assert want and {tuple(r) for r in contamination(some, bench, most_sent=10).collect()} == want


CASES = {
    "units and numbers glued": ("the tank drains 5km of pipe within the given time and then stops for the night", "the tank drains 9km of pipe within the given time and then stops for the night", True),
    "a name of two words for one": ("we drove from New York along the coast until the road came to an end at last", "we drove from Paris along the coast until the road came to an end at last", True),
    "a name opens the sentence": ("Alice has seven apples and gives three of them to her friend who likes apples", "Bob has nine apples and gives four of them to her friend who likes apples", True),
    "one repeated name differs once": ("Tom went to the shop with his dog and later Tom went to the river where they all saw that Tom could swim", "Tom went to the shop with his dog and later Tom went to the river where they all saw that Tim could swim", True),
    "plain numbers": ("a farmer sells 12 eggs every morning and keeps 3 for his own breakfast at home", "a farmer sells 40 eggs every morning and keeps 7 for his own breakfast at home", True),
    "times of day": ("the train leaves the old station at 5:30 and arrives in the city before the shops close", "the train leaves the old station at 7:45 and arrives in the city before the shops close", True),
    "dates": ("the contract that they signed on 12/05/2020 ends after the last payment has been made", "the contract that they signed on 3-11-1998 ends after the last payment has been made", True),
    "one unit for each of another": ("a car goes along the straight road at 60 km/h until it has to stop for fuel", "a car goes along the straight road at 45 mph until it has to stop for fuel", True),
    "number words with a hyphen": ("there are twenty-five pupils in the class and each of them has a desk of their own", "there are 31 pupils in the class and each of them has a desk of their own", True),
    "names with apostrophes and inner capitals": ("on sunday old mister O'Brien walks with his dog to the bakery and buys some bread", "on sunday old mister McDonald walks with his dog to the bakery and buys some bread", True),
    "degrees": ("the water in the large pot is heated to 80 °C before the salt is put into it", "the water in the large pot is heated to 176 °F before the salt is put into it", True),
    "titles": ("last year Dr. Smith gave a talk about the birds that live around the frozen lake", "last year Dr. Jones gave a talk about the birds that live around the frozen lake", True),
    "number to word": ("she waits for 5 days at the harbour until the ship with her brother comes in", "she waits for nine days at the harbour until the ship with her brother comes in", True),
    "a hyphen between number and unit": ("after the 10-km race the runners rest in the shade and drink a lot of water", "after the 42-mile race the runners rest in the shade and drink a lot of water", True),
    "currencies": ("the book about the history of the town costs 30 EUR in the shop beside the museum", "the book about the history of the town costs 45 USD in the shop beside the museum", True),
    "capitals": ("the new engine was tested by the people at NASA before it was sent up to the moon", "the new engine was tested by the people at ESA before it was sent up to the moon", True),
    "prose with a and in": ("a bird in a tree sang a song in the evening before it flew away over the hills", "the bird of the tree sang the song of the evening before it flew away over the hills", False),
    "other words": ("the long road leads over the mountain to the village near the lake of glass", "the short path leads under the bridge to the castle near the sea of sand", False),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    item, text, want = CASES[name]
    docs = spark.createDataFrame([(1, f"before it. {text}. after it")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(0, item)], "item_id bigint, text string")
    assert (ids_of(docs, contamination(docs, bench)) == {1}) == want


def test_short_and_odd_items_are_compared_word_for_word(spark):
    bench = spark.createDataFrame([(0, "What Is The Capital Of France"), (1, "1 2 3 4 5 6 7 8 9"), (2, "too short")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "asked: what is the capital of France? none knew"), (2, "count 1 2 3 4 5 6 7 8 9 done"), (3, "count 2 3 4 5 7 8 9 9 1"), (4, "this is too short")], "doc_id bigint, text string")
    assert ids_of(docs, contamination(docs, bench)) == {1, 2}


def foreign(rng, kind):
    """Values in forms that are made here from letters and digits, not from the lists of the module."""
    letters = lambda k: "".join(rng.choice("abcdefghijklmnoprstuvwyz") for _ in range(k))
    capital = lambda k: letters(k).capitalize()
    digits = lambda k: str(rng.randrange(10 ** (k - 1), 10**k))
    forms = {
        "number": [lambda: digits(rng.randint(1, 6)), lambda: f"{digits(2)}.{digits(3)}", lambda: f"{digits(1)},{digits(3)}", lambda: f"{rng.randrange(24)}:{rng.randrange(10, 60)}", lambda: f"{digits(2)}/{digits(2)}/{digits(4)}", lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"{digits(2)}–{digits(2)}", lambda: f"{digits(2)}th", lambda: f"{digits(1)}/{digits(1)}", lambda: f"{rng.choice(['twenty', 'thirty', 'ninety'])}-{rng.choice(['one', 'seven', 'nine'])}", lambda: f"{digits(3)}%", lambda: f"${digits(3)}"],
        "name": [lambda: capital(6), lambda: f"{capital(4)} {capital(7)}", lambda: f"O'{capital(5)}", lambda: f"Mc{capital(5)}", lambda: f"{capital(4)}-{capital(5)}", lambda: f"{capital(3)} de {capital(5)}".replace(" de ", " "), lambda: f"{capital(5)}'s", lambda: f"D’{capital(6)}"],
        "measure": [lambda: f"{digits(2)} {letters(2)}/{letters(1)}", lambda: f"{digits(3)}{letters(2)}/{letters(1)}", lambda: f"{digits(2)} °{capital(1)}", lambda: f"{digits(2)}°{capital(1)}", lambda: f"{digits(3)} {letters(1)}²", lambda: f"{digits(1)}-{letters(2)}/{letters(1)}"],
    }
    return rng.choice(forms[kind])()


def test_recall_on_forms_that_are_in_no_list(spark):
    """Four slots among some forty words, each filled twice with values of its kind whose forms are drawn anew."""
    rng = random.Random(12)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()]
    items, copies = [], []
    for i, text in enumerate(texts):
        words = [w.lower().strip(".,") for w in text.split()][:40]
        for kind in rng.choices(["number", "name", "measure"], k=4):
            words.insert(rng.randrange(2, len(words) - 1), ("slot", kind))
        fill = lambda: " ".join(w if isinstance(w, str) else foreign(rng, w[1]) for w in words)
        items.append((i, f"So it begins: {fill()}."))
        copies.append((i, f"Some words before it. So it begins: {fill()}. And some words after it."))
    docs = spark.createDataFrame(copies, "doc_id bigint, text string")
    recall = len(ids_of(docs, contamination(docs, spark.createDataFrame(items, "item_id bigint, text string")))) / len(items)
    print(f"recall on other forms {recall:.3f}")
    assert recall >= 0.9


def kinds(text):
    return typed(text)[2].tolist()


def test_types():
    assert kinds("he ran 5 km in a day") == [PLAIN, PLAIN, NUMERAL, UNIT, PLAIN, PLAIN, PLAIN]
    assert kinds("a day in a month") == [PLAIN] * 5
    assert kinds("it took 3h, then 20% of 7kg") == [PLAIN, PLAIN, NUMERAL, UNIT, PLAIN, NUMERAL, PLAIN, NUMERAL, UNIT]
    assert kinds("we met Ann Lee, Bob and San Juan Hill") == [PLAIN, PLAIN, NAME, NAME, PLAIN, NAME]
    assert kinds("New York is big. Big Ben too\nLast line") == [OPENING, PLAIN, PLAIN, OPENING, PLAIN, OPENING, PLAIN]
    assert kinds("") == kinds(None) == kinds(" \n ") == []


def test_columns_with_any_names_and_repeated_rows(spark, odd):
    names = {c: c for c in ("item", "hash", "pos", "slots", "t", "at", "cover")}
    docs = odd.selectExpr("*", *[f"'{c}' AS {c}" for c in names])
    bench = spark.createDataFrame([(0, "Alpha beta gamma. Delta epsilon zeta!")], "item_id bigint, text string")
    out = clean_documents(docs, contamination(docs, bench))
    assert out.columns == docs.columns and sorted(r.doc_id or 0 for r in out.collect()) == [0, 2, 3, 4, 5, 6, 7]


def test_filter_of_keys(spark):
    keys = spark.range(0, 5000).selectExpr("xxhash64(id) AS h")
    f = common.key_filter(keys)
    held = np.array([r.h for r in keys.collect()], np.int64).view(np.uint64)
    others = np.array([r.h for r in spark.range(5000, 25_000).selectExpr("xxhash64(id) AS h").collect()], np.int64).view(np.uint64)
    assert f.holds(held).all() and f.holds(others).mean() < 0.03
    assert f.bits >= 50_000 and common.key_filter(keys, most_bits=1024) is None
    rows = spark.range(0, 6000).selectExpr("id", "id * 2 AS other")
    gone = spark.range(1000, 7000).select("id")
    for bits in (1 << 26, 1 << 10):  # with a filter and without
        assert common.without_keys(rows, "id", gone, bits).count() == 1000
        assert common.with_keys(rows, "id", gone, bits).count() == 5000
