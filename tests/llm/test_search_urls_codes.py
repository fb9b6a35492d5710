"""Ranked search, url filters and vector codes against brute force, on small tables with nulls, empty values, ties, repeats and clashing columns."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainlake.llm import ranked_search, url_filters, vector_codes
from grainlake.llm import queries as Q

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ASCII_LOWER = str.maketrans(url_filters.UPPER, url_filters.LOWER)


def terms_of(text):
    return TERM.findall((text or "").translate(ASCII_LOWER))


def ranked(docs, items, k=10):
    """Every document scored for every item."""
    counts = [(i, Counter(terms_of(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms_of(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c in counts:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def searched(spark, docs, items, k=10):
    d = spark.createDataFrame([(i, t, 1, "x", 2.0) for i, t in docs], "doc_id long, text string, term int, item string, score double")
    q = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, item int")
    got = ranked_search.search(ranked_search.build_index(d), q, k)
    assert got.columns == ["item", "rank", "id", "score"]
    return sorted(((r.item, r["rank"], r.id, r.score) for r in got.collect()), key=repr)


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Ünï", "éa", "x1"]
    text = lambda k: " ".join(rng.choice(words[: rng.choice((3, 20, 63))]) for _ in range(k))
    docs = [(k, text(rng.randrange(1, 40))) for k in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, " .,\n"), (None, "w1 w2 W3"), (4, docs[4][1]), (n + 3, docs[4][1]), (n + 4, "w5 " * 50_000)]
    items = [(k, text(12)) for k in range(6)] + [(90, None), (91, ""), (92, "nowhere at all"), (93, "W1 w1 w2"), (93, "w7"), (None, "w3 ünï"), (94, " ".join(words) + " " + " ".join(f"z{k}" for k in range(40)))]
    return docs, items


@pytest.mark.parametrize("block_docs,items_seen,first", [(1 << 15, 2048, 64), (7, 3, 1)])
def test_ranked_search(spark, monkeypatch, block_docs, items_seen, first):
    monkeypatch.setattr(ranked_search, "BLOCK_DOCS", block_docs)
    monkeypatch.setattr(ranked_search, "ITEMS", items_seen)
    docs, items = corpus(80, 11)
    assert searched(spark, docs, items) == ranked(docs, items)
    assert searched(spark, docs, items, 3) == ranked(docs, items, 3)


def test_masks_stop_only_when_safe(monkeypatch):
    """The masks' walk alone, with small steps, over documents of many equal scores."""
    import pyarrow as pa

    monkeypatch.setattr(ranked_search, "FIRST", 1)
    rng = np.random.default_rng(8)
    held = rng.random((70, 300)) < 0.2
    tf = rng.integers(1, 4, held.shape)
    rows = [(None if False else int(i), int(5 + i % 9), None, None, None, None, None) for i in range(300)]
    for t in range(70):
        at = np.flatnonzero(held[t])
        rows.append((None, None, t, len(at), np.diff(at, prepend=0).astype("<i4").tobytes(), tf[t, at].astype("<i4").tobytes(), [{"item": 1}]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.struct([("item", pa.int64())]))]
    table = pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["id", "n", "term", "df", "docs", "tfs", "uses"])
    block = ranked_search.Block(table, 300, 2000)
    m = 10 + (90 * (5 + np.arange(300) % 9) * 300) // 2000
    for n_terms in (3, 40, 70):
        weight = rng.integers(1, 4, n_terms)
        score = (weight[:, None] * np.where(held[:n_terms], 10**9 * tf[:n_terms] // (1000 * tf[:n_terms] + 8 * m), 0)).sum(axis=0)
        want = np.lexsort((np.arange(300), -score))[:10]
        doc, got = block.best(np.arange(n_terms), weight, np.arange(300), 10)
        assert doc.tolist() == [d for d in want.tolist() if score[d] > 0] and got.tolist() == score[doc].tolist()


def test_search_of_nothing(spark):
    docs, items = corpus(10, 2)
    assert searched(spark, [], items) == searched(spark, docs, []) == searched(spark, [(1, None)], items) == []


URLS = [
    "https://example.org/es/1", "https://m.Example.ORG/es/", "http://notexample.org/es/", "http://example.org", "http://example.org?x=/es/", "http://a.b.example.org/en/12#top", "http://example.org/en/21",
    "ftp://shop.example.com/fr/x.html", "http://com/de/y", "http://example.com/DE/y", "http://evil.com.net/de/", "http://example.net/login", "http://example.net/loginform", "http://example.net/a/login?x",
    "http://ads.example.net/", "http://loads.example.net/", "http://example.net/x?utm_source=feed", "http://example.net/calendar/2020/1", "http://example.net/calendar//", "http://example.net/pic.png", "http://example.net/pic.png?x",
    "http://example.net/tags/index.html", "http://example.net/tags/x", "http://docs.a.net/search/", "HTTP://EXAMPLE.NET/x;PHPSESSID=4", "no scheme", "", None, "a://b://org/", "http://x-casino-y.net/", "http://x.net/é/login\n", "://", "http://example.org:80/es/", "http://example.net/a b#://org/",
    "http://example.net/list?page=2&ref=x", "http://" + "a/" * 200_000 + "login/",
]


def judged(spark, urls, rules, plan_rules=url_filters.PLAN_RULES):
    df = spark.createDataFrame([(k, u, "c", 1) for k, u in enumerate(urls)], "page_id long, url string, place string, token int")
    return sorted(((r.id, r.host, r.path, r.rule, r.verdict, r.pattern) for r in url_filters.judge(df, rules, plan_rules=plan_rules).collect()), key=repr)


def by_hand(urls):
    """The place rules of the query by plain comparison; None where a pattern decides."""
    out = []
    for u in urls:
        _, mark, rest = (u or "").partition("://")
        host = re.split("[/?#]", rest)[0].translate(ASCII_LOWER) if mark else ""
        path = re.split("[?#]", rest[len(host) :])[0] if mark else ""
        fits = [(len(h + p), h + p, a) for h, p, a in (("org", "/", 1), ("example.org", "/es/", 0), ("example.org", "/en/1", 0), ("com", "/fr/", 1), ("com", "/de/", 0)) if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        out.append((host, path, best and best[1], best and ("block", "allow")[best[2]]))
    return out


def test_url_filters(spark):
    urls = URLS + URLS[:5]
    got = judged(spark, urls, Q.URL_RULES)
    assert len(got) == len(urls)
    for (_, host, path, rule, verdict, _), (h, p, r, v) in zip(sorted(got), by_hand(urls)):
        assert (host, path, rule) == (h, p, r) and (v is None or verdict == v)
    patterns = {urls[k]: (verdict, pattern) for k, _, _, rule, verdict, pattern in got if rule is None}
    assert patterns["http://example.net/login"] == patterns["http://example.net/a/login?x"] == ("block", "/login^")
    assert patterns["http://example.net/loginform"] == patterns["http://loads.example.net/"] == patterns[""] == patterns[None] == patterns["http://example.net/pic.png?x"] == ("allow", None)
    assert patterns["http://ads.example.net/"] == ("block", "||ads.") and patterns["http://example.net/pic.png"] == ("block", ".png|")
    assert patterns["http://example.net/tags/index.html"] == ("allow", "@@/tags/index.html|") and patterns["http://docs.a.net/search/"] == ("allow", "@@||docs.*/search^")
    assert patterns["HTTP://EXAMPLE.NET/x;PHPSESSID=4"] == ("block", "phpsessid=") and patterns["http://x-casino-y.net/"][0] == "block" and patterns[urls[35]][0] == "block"
    assert judged(spark, urls, Q.URL_RULES, plan_rules=0) == got
    assert judged(spark, [], Q.URL_RULES) == [] and {r[4] for r in judged(spark, urls, [])} == {"allow"}


def test_index_finds_what_all_rules_find(spark):
    """Random rules and urls over a small alphabet: the index loses no match."""
    rng = random.Random(4)
    text = lambda letters, n: "".join(rng.choice(letters) for _ in range(rng.randrange(1, n)))
    rules = [url_filters.pattern_rule(rng.choice(("", "@@")) + rng.choice(("", "|", "||")) + text("aab1./*^-", 7) + rng.choice(("", "|"))) for _ in range(150)]
    rules += [url_filters.place_rule(text("ab.", 4), rng.choice(("", "/" + text("ab/", 4))), rng.random() < 0.5) for _ in range(40)]
    urls = ["http://" + text("aAb.", 6) + rng.choice(("", "/", "?")) + text("aab1./-?_%", 9) for _ in range(300)]
    index = url_filters.build_index(rules, {})
    want = []
    for k, u in enumerate(urls):
        rest = u.partition("://")[2]
        host = re.split("[/?#]", rest)[0].translate(ASCII_LOWER)
        place = host + re.split("[?#]", rest[len(host) :])[0]
        hits = [r for r in index if re.search(r["regex"].replace(r"\z", r"\Z"), place if r["place"] else u.translate(ASCII_LOWER))]
        best = max(hits, key=lambda r: r["rank"], default={"allow": True, "place": None, "text": None})
        want.append((k, host, place[len(host) :], best["text"] if best["place"] else None, "allow" if best["allow"] else "block", None if best["place"] else best["text"]))
    want = sorted(want, key=repr)
    assert judged(spark, urls, rules) == want
    assert judged(spark, urls, rules, plan_rules=0) == want


def test_rules_lie_under_their_rarest_token():
    rules = [url_filters.place_rule("example.org", "/en/1", False), url_filters.pattern_rule("phpsessid="), url_filters.pattern_rule("^a=*&bb=")]
    assert [r.tokens for r in rules] == [("en", "example", "org"), (), ("a", "bb")]
    index = url_filters.build_index(rules, {"example": 9, "org": 3, "en": 5, "a": 1, "bb": 1})
    assert {r["text"]: r["token"] for r in index} == {"example.org/en/1": "org", "phpsessid=": "", "^a=*&bb=": "a"}


def test_nearest_equals_all_pairs():
    rng = np.random.default_rng(6)
    for scale, n, m in ((3, 700, 256), (1000, 900, 256), (2**27, 300, 40), (5, 40, 1)):
        x, entries = rng.integers(-scale, scale, (n, 16)), rng.integers(-scale, scale, (m, 16))
        entries[-1] = entries[0]
        d = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
        index, error = vector_codes.nearest(x, entries)
        assert (index == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all()
    assert len(vector_codes.nearest(np.zeros((0, 4), np.int64), entries[:, :4])[0]) == 0


def coded(rows, parts=4, size=256, rounds=4):
    """All parts against all entries, with Python's own integers."""
    kept = [(i, [math.floor(1024 * float(v)) for v in vec], label) for i, vec, label in rows if vec and len(vec) == 8 and all(v is not None and math.isfinite(v) for v in vec)]
    width = 8 // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:size]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        groups = [{} for _ in range(parts)]
        for _, v, _ in kept:
            for p, x in enumerate(cut(v)):
                groups[p].setdefault(near(p, x)[1], []).append(x)
        for p in range(parts):
            for k, xs in groups[p].items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    out = []
    for i, v, label in kept:
        best = [near(p, x) for p, x in enumerate(cut(v))]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), label))
    errors = Counter()
    for _, _, e, label in out:
        errors[label] += e
    return sorted(((i, code, e, errors[label]) for i, code, e, label in out), key=repr), books


def test_vector_codes(spark):
    rng = np.random.default_rng(9)
    rows = [(k, rng.normal(size=8).astype("float32").tolist(), int(k % 3) if k % 4 else None) for k in range(400)]
    rows += [(400, None, 1), (401, [], 1), (402, [float("nan")] + [0.0] * 7, 1), (403, [None] + [0.0] * 7, 1), (404, [float("inf")] * 8, 1), (405, [0.5] * 4, 1), (406, [-0.25] * 8, 2), (7, rows[7][1], 1), (None, [1.0] * 8, None), (407, rows[7][1], None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, code string, of_label int")
    books = vector_codes.fit(df, size=20)
    want, plain = coded(rows, size=20)
    assert [e.tolist() for e in books.entries] == plain
    got = vector_codes.with_label_error(vector_codes.encode(df, books))
    assert sorted(((r.id, r.code, r.error, r.label_error) for r in got.collect()), key=repr) == want
    back = {r.id: r.embedding for r in vector_codes.decode(got, books).where("id = 3").collect()}
    x, code = np.floor(1024 * np.array(rows[3][1])), next(c for i, c, _, _ in want if i == 3)
    assert [math.floor(1024 * v) for v in back[3]] == [v for p in range(4) for v in plain[p][int(code[2 * p : 2 * p + 2], 16)]] and len(x) == 8


def test_vectors_without_any(spark, tmp_path):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vector_codes.fit(none) is None
    none.write.parquet(str(tmp_path / "embeddings.parquet"))
    assert Q.op13_vector_codes(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_url_filters", "op13_vector_codes"])
def test_queries_match_sql(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got, want = Q.queries()[name](spark, folder), c.sql(Q.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(want.select(*(f'"{n}"' for n in names)).fetchall(), key=repr)


def test_search_ranks_and_ids_are_typed(spark):
    docs, items = corpus(5, 3)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast("string"))
    got = ranked_search.search(ranked_search.build_index(d), spark.createDataFrame([(k, t) for k, (_, t) in enumerate(items)], "item_id long, text string"))
    assert dict(got.dtypes) == {"item": "bigint", "rank": "int", "id": "string", "score": "bigint"}
