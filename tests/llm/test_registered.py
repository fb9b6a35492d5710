"""Registered queries on the smallest tables against brute force, called as the driver calls them."""

import re
from collections import Counter

import duckdb
import pytest
import xxhash

import __spark_entry__

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{FOLDER}/documents.parquet'").fetchall())


def fingerprint(text):
    words = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_dedup(spark, texts):
    prints = {k: fingerprint(t) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = __spark_entry__.queries()["op2_simhash_near_dedup"](spark, FOLDER).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((k, f"{prints[k]:016x}", find(k)) for k in texts)


def test_quality_counts(spark, texts):
    want = {}
    for k, text in texts.items():
        words = [w.decode() for w in WORD.findall(text.encode())]
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        again = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
        lines = [line for line in text.split("\n") if WORD.search(line.encode())]
        failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
        want[k] = (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again), failed)
    got = __spark_entry__.queries()["op5_quality_rules"](spark, FOLDER).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got} == want
    assert not any(r.kept and r.base_failed for r in got) and any(r.kept for r in got)


def test_every_operator_is_registered():
    names = set(__spark_entry__.queries())
    assert {int(n[2:].split("_")[0]) for n in names if re.match(r"op\d+_", n)} == set(range(1, 14)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= names
