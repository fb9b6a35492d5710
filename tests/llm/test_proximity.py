"""Proximity matches of benchmark items against brute force."""

import random

from grainlake.llm.decontaminate import contamination, proximity


def _common(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        old = list(best)
        for k, y in enumerate(b):
            best[k + 1] = max(old[k + 1], best[k], old[k] + (x == y))
    return best[-1]


def test_proximity_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"t{k}" for k in range(40)]
    items = [(k, [rng.choice(words) for _ in range(n)]) for k, n in enumerate([13, 20, 8, 3, 14])]
    docs = []
    for _, own in items:
        for every in (5, 6, 8, 99):
            for kind in ("put in", "left out", "changed"):
                text = []
                for k, w in enumerate(own):
                    hit = k % every == every - 1
                    text += ["zz"] * (hit and kind != "left out") + [w] * (not hit or kind == "put in")
                docs.append(["aa", rng.choice(words)] * rng.randrange(3) + text + [rng.choice(words)])
    docs += [[], [rng.choice(words) for _ in range(60)]]
    want = {}
    for d, text in enumerate(docs):
        for item, own in items:
            for i in range(max(1, len(own) - 12)):
                window = own[i : i + 13]
                n = len(window)
                found = max((_common(text[a : a + n + 3], window) for a in range(len(text))), default=0)
                if found >= n - min(2, n // 6):
                    want[d, str(item)] = max(want.get((d, str(item)), (-n, n, 0)), (found - n, n, found))
    tables = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(docs)], "doc_id long, text string"), spark.createDataFrame([(k, " ".join(t)) for k, t in items], "item_id long, text string")
    got = {(r.id, r.item): (r.n_terms, r.n_found) for r in proximity(*tables).collect()}
    assert got == {k: (n, found) for k, (_, n, found) in want.items()}
    exact = {(r.id, x) for r in contamination(*tables).collect() for x in r["items"]}
    assert exact < set(got)
    assert proximity(tables[0].where("false"), tables[1]).count() == proximity(tables[0], tables[1].where("false")).count() == 0
