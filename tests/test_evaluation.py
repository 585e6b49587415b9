"""Golden evaluation: passages of any length in texts of any length."""

import random

from attestra.operators import answer


def brute(items, docs):
    return sorted((i, d) for i, p in items for d, t in docs if p is not None and t is not None and p in t)


def test_passages_of_every_length_are_found(spark):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    docs = [(d, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60)))) for d in range(80)]
    docs += [(80, None), (81, ""), (82, "tab\tand\nfeed  twice"), (83, " ".join(f"x{i}" for i in range(150_000)))]  # the last has 1 MB
    items = []
    for n in (1, 2, 3, 4, 5, 6, 7, 8, 12, 30):
        for _ in range(6):
            w = rnd.choice(docs[:80])[1].split(" ")
            at = rnd.randint(0, max(0, len(w) - n))
            text = " ".join(w[at : at + n])
            items.append((len(items), text[rnd.randint(0, 1) : len(text) - rnd.randint(0, 1)]))  # ends may lie inside words
    items += [(len(items) + k, t) for k, t in enumerate(["", None, "and\nfeed  twice", "not there at all, in none of these", "x149997 x149998 x149999", "149998 x", " w1 ", "x7 x8 x9 x10 x11 x12 x13 x14"])]
    got = answer.passages_held(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute(items, docs)


def test_the_rarest_run_finds_a_passage(spark):
    """A beginning that every document has doesn't make every document a candidate."""
    common = "under this licence you may copy and change all of it"
    docs = [(d, f"{common} freely {d} as the case may be {d} or so") for d in range(50)]
    items = [(1, f"{common} freely 7 as the case may be 7 or so"), (2, common)]
    got = answer.passages_held(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute(items, docs)


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert answer.passages_held(none, spark.createDataFrame([(1, "a b")], "doc_id long, text string")).count() == 0
    assert answer.passages_held(spark.createDataFrame([(1, "a b")], "item_id long, text string"), none.withColumnRenamed("item_id", "doc_id")).count() == 0
