"""Short benchmark items are found wherever they stand word for word."""

import random

from plumbline.llm.decontaminate import find_leaks


def test_verbatim_copies_of_short_items(spark):
    draw = random.Random(13)
    vocabulary = [f"w{i}" for i in range(3000)] + ["the", "of", "and", "to", "in"] * 400

    def prose(n):
        return [draw.choice(vocabulary) for _ in range(n)]

    items = [(i, " ".join(prose(5 + i % 6))) for i in range(60)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = []
    for i, text in items:
        words = prose(draw.randint(40, 300))
        at = draw.randint(0, len(words))
        docs.append((i, " ".join([*words[:at], text.upper(), *words[at:]])))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {(r.id, r.item): r.share for r in find_leaks(df, bench).collect()}
    assert all(got.get((i, i)) == 1.0 for i, _ in items)
