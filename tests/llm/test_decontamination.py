import random

from spanloom.llm import decontamination as dc

from .odd import DOCS, documents


def distance(item, text):
    """Least edit distance of the item to a substring."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers():
    rng = random.Random(0)
    for _ in range(400):
        item = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 90)))
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 60)))
        masks = {}
        for i, c in enumerate(item):
            masks[c] = masks.get(c, 0) | 1 << i
        found = dc.myers(item, masks, text, 0, len(text), len(item))
        want = distance(item, text)
        assert found[0] == want if found else want == len(item)


def test_finds_all_within_budget(spark):
    rng = random.Random(1)
    words = [f"{rng.choice('bcdfgh')}{rng.choice('aeiou')}{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(4, 30)))) for i in range(12)]
    docs = []
    for d in range(60):
        text = " ".join(rng.choice(words) for _ in range(40))
        if d % 2:
            own = list(rng.choice(items)[1])
            for _ in range(rng.randrange(0, int(0.12 * len(own)) + 1)):
                at = rng.randrange(len(own))
                own[at] = rng.choice(["", "z", own[at] + "q"])
            text = text[:50] + " " + "".join(own).upper().replace(" ", "\n") + " " + text[50:]
        docs.append((d, text))
    got = {(r.doc_id, r.item_id): r.distance for r in dc.links(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, text in docs:
        for i, item in items:
            item, n = dc.normal(item), distance(dc.normal(item), dc.normal(text))
            if n <= dc.budget(len(item), 0.08):
                want[d, i] = n
    assert got == want and len({d for d, _ in want}) > 15


def test_odd_rows(spark):
    items = spark.createDataFrame([(5, "The  LAZY dog"), (2, "the lazy dog"), (3, None), (4, " "), (6, "x"), (None, "quick brown")], "item_id long, text string")
    rows = dc.links(documents(spark), items)
    got = sorted((r.doc_id, r.item_id, r.distance) for r in rows.collect())
    assert [g for g in got if g[1] == 2] == [(1, 2, 0), (2, 2, 0), (2, 2, 0), (8, 2, 0)] and {g[1] for g in got} <= {2, 6}
    assert dc.links(documents(spark), items.limit(0)).count() == 0 and dc.links(documents(spark).limit(0), items).count() == 0
    sliced = dc.links(documents(spark), items, most_bytes=10)
    assert sorted((r.doc_id, r.item_id, r.distance) for r in sliced.collect()) == got
    assert len(DOCS) == documents(spark).count()
