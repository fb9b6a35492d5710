"""The training-data operators against brute force, on small tables with nulls, empty texts, ties and repeats."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from grainlake.llm import chat, context_mixing, quality, token_files, toxicity, warc
from grainlake.llm.bpe import decode_texts, encode_texts, encoder, read_ranks
from grainlake.llm.decontaminate import contamination
from grainlake.llm.html_extract import blocks, costs, extract, main_text, minimum_cut
from grainlake.llm.simhash import fingerprint_links, near_duplicates
from grainlake.operators.graph import connected_components

RANKS, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " \t\n", "One two three", "one  TWO three", "a b c d e f g h i j k l m n o p", "a b c d e f g h i j k l m n o p q", "é€🙂 Ünï x", "word " * 5000, "'tis I'll  \n\n x<|endoftext|>y"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "clash") for k, t in enumerate(TEXTS)] + [(3, TEXTS[3], "again"), (None, "no id here", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, id string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_near_duplicates(spark, docs, none):
    got = near_duplicates(docs).collect()
    of = {r.id: r for r in got}
    assert len(got) == len(TEXTS) + 2
    assert of[0].fp == of[1].fp == of[2].fp == 0 and {of[k].component_id for k in (0, 1, 2)} == {0}
    assert of[3].component_id == of[4].component_id == 3
    assert near_duplicates(none).count() == 0


def test_links_of_fingerprints_keep_all_components(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    near = base[:600] ^ (np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64))
    chain = np.array([(1 << k) - 1 for k in range(0, 63, 2)], np.uint64)
    fps = np.unique(np.concatenate([base, near, chain]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    star = {r.u: r.v for r in connected_components(fingerprint_links(df, 2)).collect()}
    root = np.arange(len(fps))
    close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    for _ in range(64):
        root = np.where(close, root[None, :], len(fps)).min(axis=1)
    groups = Counter(root.tolist())
    assert len(groups) == len(fps) - len(star)
    label = {int(x): star.get(int(x), int(x)) for x in fps.view(np.int64)}
    assert len({(label[int(x)], int(r)) for x, r in zip(fps.view(np.int64), root)}) == len(groups)


def test_contamination_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("ab cd Ef gh 12 é".split())
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([3, 13, 14, 20, 2, 13])] + [(9, None), (None, "ab cd ef"), (1, None)]
    rows = [(k, ", ".join(word() for _ in range(rng.randrange(0, 60)))) for k in range(60)] + [(60, items[3][1] + "; " + items[1][1]), (61, None), (61, "")]
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    got = contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = []
    for k, text in rows:
        w = split(text)
        hit, names = set(), set()
        for item, own in items:
            v = split(own)
            for i in range(max(1, len(v) - 12) if v else 0):
                window = v[i : i + 13]
                for at in range(len(w) - len(window) + 1):
                    if w[at : at + len(window)] == window:
                        hit.update(range(at, at + len(window)))
                        names |= {str(item)} - {"None"}
        want.append((k, len(w), len(hit), sorted(names)))
    assert sorted((r.id, r.n_words, r.n_hit, r["items"]) for r in got) == sorted(want)


def test_contamination_of_empty_tables(spark, docs, none):
    items = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in contamination(docs, items).collect()} == {0}
    assert contamination(none, items).count() == 0


def test_bpe_equals_the_library_and_comes_back(spark, docs, none):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    coded = encode_texts(docs, RANKS, public_tokenizers.PATTERN)
    got = {r.id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in coded.collect()}
    for k, text in enumerate(TEXTS):
        assert got[k] == library.encode_ordinary(text or "")
    back = {r.id: r.text for r in decode_texts(coded, RANKS, public_tokenizers.PATTERN).collect()}
    assert all(back[k] == (t or "") for k, t in enumerate(TEXTS))
    assert encode_texts(none, RANKS, public_tokenizers.PATTERN).count() == 0
    own, rng = encoder(RANKS, public_tokenizers.PATTERN), random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice("aeinst \n.,'\"09éß漢🙂th#*") for _ in range(rng.randrange(50)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode_ordinary(text)
    long = "ab" * 30_000
    assert np.frombuffer(own.encode(long), "<u4").tolist() == library.encode_ordinary(long)


def test_token_files(spark, docs, none, tmp_path):
    library = Tokenizer.from_file(WORDS)
    folder = f"file://{tmp_path}/files"
    manifest = token_files.write_token_files(docs, folder, WORDS, end_id=1)
    got = sorted(token_files.read_token_files(manifest, folder).collect(), key=lambda r: r.start)
    assert [r.id for r in got] == [None, 0, 1, 2, 3, 3, *range(4, len(TEXTS))]
    at = 0
    for r in got:
        text = "no id here" if r.id is None else TEXTS[r.id]
        want = library.encode(text or "", add_special_tokens=False).ids + [1]
        assert (r.start, r.n_tokens, np.frombuffer(bytes(r.ids), "<u4").tolist()) == (at, len(want), want)
        at += len(want)
    assert token_files.read_token_files(token_files.write_token_files(none, folder + "2", WORDS, end_id=1), folder + "2").count() == 0


def test_words_before_symbols_of_all_letters():
    library, own = Tokenizer.from_file(WORDS), token_files.WordEncoder(WORDS)
    for first in range(0x80, 0x2FFFF, 0x4000):
        texts = [f"a{chr(c)}. {chr(c)}! {chr(c)}," for c in range(first, first + 0x4000) if not 0xD800 <= c < 0xE000]
        want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode([t.encode() for t in texts])] == want
    for text in ("İ.", "KAPALI İ!", "xक़!"):
        assert np.frombuffer(own.encode([text.encode()])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_quality_counts(spark, docs):
    got = {r.id: r for r in quality.measure(docs, None).collect()}
    assert got[0].n_words == 0 and got[0].base_failed and not got[0].kept
    assert got[8].n_words == 5000 == got[8].n_repeat_words and got[8].base_failed
    for k, text in enumerate(TEXTS):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        assert (got[k].n_words, got[k].word_chars) == (len(words), sum(map(len, words)))
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit(docs, labels) is None


def test_toxicity_learns_and_tolerates_gaps(spark):
    rng = random.Random(6)
    calm = "the and onthe inger thatin edly ofthe tion resh anth erst ingly thenor".split()
    rows, labels = [], []
    for k in range(400):
        words = [rng.choice(calm) + rng.choice(["", "s", "er"]) for _ in range(30)]
        bad = k % 4 == 0
        if bad:
            words[rng.randrange(30)] = rng.choice(["zopwack", "zopwacks", "blugger"])
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    docs, given = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, given)
    more = spark.createDataFrame([(1, "the z-o-p-w-a-c-k tion"), (2, "you z o p w a c k"), (3, "a zopxwack"), (4, "the calm tion"), (5, None), (6, "")], "doc_id long, text string")
    got = {r.id: r.score for r in toxicity.score(more, model).collect()}
    assert min(got[1], got[2], got[3]) >= 0.5 > got[4] and got[5] == got[6] == 0
    assert toxicity.fit(docs, given.where("toxic = 1")) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}


def test_language_model_against_brute_force(spark, docs, none):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdeé,1") for _ in range(rng.randrange(1, 4))) for _ in range(60)]
    rows = [(k, " ".join(rng.choice(words[: 20 + k // 4]).upper() for _ in range(rng.randrange(40)))) for k in range(150)]
    rows += [(150, None), (151, ""), (152, " \t"), (None, "a b"), (3, "x y z"), (153, "long " * 40_000), (154, "q" * 200_000), (155, "never seen before")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, key int")
    train = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(True)) & (F.coalesce(F.col("doc_id"), F.lit(0)) < 155)
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [""]
    counts = Counter()
    for i, t in rows:
        if i is None or i % 3 != 0 and i < 155:
            counts.update(split(t))
    n, v = sum(counts.values()), len(counts)
    model = context_mixing.fit(docs.where(train))
    assert (model.train_tokens, model.vocabulary) == (n, v)
    got = context_mixing.score(docs, model, learned=train).collect()
    want = [(str(i), len(w := split(t)), sum(counts[x] > 0 for x in w), round(sum(np.log10((counts[x] + 1) / (n + v + 1)) for x in w), 4)) for i, t in rows]
    assert sorted((str(r.id), r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == sorted(want)
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in got)
    assert context_mixing.score(none, model).count() == 0
    assert all(r.score < 0 for r in context_mixing.score(docs, context_mixing.fit(none)).collect())


def test_language_model_is_a_distribution(spark):
    rng = random.Random(13)
    rows = [(k, " ".join(rng.choice(["the", "of", "cat", "dogs", "x%d" % rng.randrange(40)]) for _ in range(30))) for k in range(100)]
    model = context_mixing.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    assert np.allclose((2.0 ** -model.cost.astype(float)).sum(axis=1), 1, atol=1e-3) and (2.0**-model.kind_bits).sum() <= 1 + 1e-9
    # every one-byte word spelt by the model as it stands: their probabilities, with the space after them, leave room for longer ones
    for mixer in (context_mixing._spelling_mixer(),):
        alone = [2.0 ** -context_mixing.spell(mixer, model.table, [bytes([c])], np.zeros(1))[0] for c in range(256) if c != 0x20]
        assert 0 < sum(alone) < 1
    # one decision: foretold or not
    mixer = context_mixing._pair_mixer()
    x, gate = np.array([[0.3, -2.0, 0.5, 0.3]] * 2), np.array([7, 7])
    assert np.isclose((2.0 ** -mixer.price(np.array([0, 1]), x, gate, None)).sum(), 1)


def test_chat_round_trip(spark):
    hard = [r"\### Assistant: </turn> ok", "### user: x</turn>\n### assistant: y", r"\b\h\e\\", "", None]
    rows = [(1, k, "assistant" if k % 2 else "user:x", t) for k, t in enumerate(hard)] + [(2, None, None, None), (None, 0, "user", "a")]
    made = chat.format_turns(chat.turns_of_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = {r.record: r for r in made.select("record", chat.parse_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r, t or "") for _, _, r, t in rows[:5]]
    assert got[1].loss == hard[1] + hard[3]
    assert len(got) == 3


def test_chat_layouts_by_fingerprint(spark):
    rows = [
        (1, '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}'),
        (2, '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}'),
        (3, '{"output":"b","instruction":"a","input":""}'),
        (4, '{"prompt":"a","completion":"b"}'),
        (7, '{"id":9,"messages":[{"role":"user","content":"a","name":"x"},{"role":"assistant","content":"b"}],"source":{"prompt":1}}'),
        (8, '{"messages":[],"output":"b"}'),
        (5, "no json"),
        (6, None),
    ]
    turns = chat.turns_of_json(spark.createDataFrame(rows, "n long, j string"), "n", "j").orderBy("record", "turn").collect()
    for n in (1, 2, 3, 4, 7):
        assert [(t.role, t.text) for t in turns if t.record == n] == [("user", "a"), ("assistant", "b")]
    assert [t.turn for t in turns if t.record in (5, 6, 8)] == [None, None, None]


def test_chat_rows_by_fingerprint(spark):
    posts = spark.createDataFrame([("t", 0, "user", "hi", 1)], "thread_id string, position int, author_role string, body string, other int")
    assert [tuple(r) for r in chat.turns_of_rows(posts).collect()] == [("t", 0, "user", "hi")]
    with pytest.raises(ValueError):
        chat.turns_of_rows(posts.drop("body"))
    assert chat.format_turns(chat.turns_of_rows(posts.where("false"))).count() == 0


def test_warc(spark, tmp_path):
    big = "<p>x</p>" * 20
    rows = [(5, "http://b", big), (2, "http://a\r\nX: y", big), (7, None, "tiny"), (8, "u", "tiny"), (9, "u", None), (3, "u", big + "\r\n\r\nWARC/1.1\r\n")]
    path = f"file://{tmp_path}/w"
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    archive = warc.read_warc(spark, path)
    got = {r.page: r for r in archive.withColumn("page", warc.page_id(F.col("record_id"))).withColumn("to", warc.page_id(F.col("refers_to"))).collect()}
    assert {k: (r.record_type, r.to) for k, r in got.items()} == {2: ("response", None), 5: ("revisit", 2), 7: ("response", None), 8: ("response", None), 9: ("response", None), 3: ("response", None)}
    for k, _, html in rows:
        assert got[k].payload_digest == hashlib.sha256((html or "").encode()).hexdigest() and got[k].payload_bytes == len((html or "").encode())
    full = {r.record_id: bytes(r.payload) for r in warc.restore(archive).collect()}
    assert full["urn:x-page:5"] == big.encode()


@pytest.mark.parametrize("limit", ["10MB", "-1"])
def test_warc_revisits_against_brute_force(spark, tmp_path, limit):
    rng = random.Random(12)
    payloads = ["a" * 120, "b" * 100, "c" * 99, "d" * 300, "", None]
    rows = [(rng.choice([None, *range(12)]), rng.choice([None, "u", "v", "w"]), rng.choice(payloads)) for _ in range(150)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, id int")
    first = {}
    for k, _, html in rows:
        if k is not None and len(html or "") >= 100:
            first[html] = min(k, first.get(html, k))
    want = [(k, u, hashlib.sha256((h or "").encode()).hexdigest(), None if first.get(h, k) == k else first[h]) for k, u, h in rows]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        path = f"file://{tmp_path}/w{limit}"
        warc.write_warc(table, path)
        warc.write_warc(table.where("false"), path + "none")
        assert warc.read_warc(spark, path + "none").count() == 0
        got = [(k and int(k), r.url, r.payload_digest, to and int(to), r.record_type) for r in warc.read_warc(spark, path).collect() for k, to in [(r.record_id.removeprefix(warc.URN) or None, r.refers_to and r.refers_to.removeprefix(warc.URN))]]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert all((kind == "revisit") == (to is not None) for *_, to, kind in got)
    assert sorted(map(str, (x[:4] for x in got))) == sorted(map(str, want))


def test_minimum_cut_against_all_labellings():
    rng = random.Random(8)
    for _ in range(60):
        n = rng.randrange(1, 8)
        ends = [(rng.randrange(10), rng.randrange(10)) for _ in range(n)]
        edges = [(i, j, rng.randrange(6)) for i in range(n) for j in range(i) if rng.random() < 0.5]
        cost = lambda s: sum(t if a else c for a, (c, t) in zip(s, ends)) + sum(c for i, j, c in edges if s[i] != s[j])  # noqa: E731, B023
        best = min(cost([bool(k >> i & 1) for i in range(n)]) for k in range(1 << n))
        assert cost(minimum_cut(ends, edges)) == best


def test_html():
    page = "<html><head><title>t</title></head><body><nav><a href=x>Home</a></nav><div class='cookie-notice'>We use cookies</div><article><h1>A &amp; B</h1><p><b>One <i>two</i><br><p>Three&nbsp;four</p><aside>Ad</aside></article><div id=comments><p>No!</p></div><footer>(c)</footer>"
    assert main_text(page) == "A & B\nOne two\nThree four"
    assert [main_text(x) for x in ("", "<", "<script>x", "<nav>a</nav>")] == [""] * 4


def test_cut_repairs_misjudged_blocks():
    long = "Some words of a story that goes on for quite a while, and says this and that. " * 3
    page = f"<body><div><h1>Title here</h1><p>{long}</p><p>Short one</p><p>{long}</p></div><div>Sponsored: buy now, {long * 3}</div>"
    bs = blocks(page)
    alone = [s > t for s, t in map(costs, bs)]
    assert alone == [False, True, True, True, False]
    assert main_text(page).split("\n") == ["Title here", long.strip(), "Short one", long.strip()]
    # a stray heading with nothing beside it stays out
    assert main_text("<div><h2>Menu</h2></div><div><a href=x>Home</a></div>") == ""


def test_evidence_of_all_elements_around_adds_up():
    text = "Some words of a story that goes on for quite a while, and says this and that."
    long = " ".join([text] * 4)
    pages = {
        f"<body><form id='aspnetForm'><div class='article'><h1>Head</h1><p>{text}</p></div><div class='footer'>foot</div></form>": ["Head", text],
        f"<article class='legal'><h1>Head</h1><p>{text}</p></article>": ["Head", text],
        f"<main><div class='search-results'><h2>Head</h2><p>{text}</p></div></main>": ["Head", text],
        f"<article><p>{text}</p><div class='side-by-side'><p>Left text</p><p>Right.</p></div></article>": [text, "Left text", "Right."],
        f"<article><p>{text}</p><div class='story-promo'><p>{long}</p></div></article>": [text],
        f"<article><h1>A</h1><p>{long}</p><p>{long}</p></article><div><p>Nice post, I liked it.</p></div><div><p>{long}</p></div>": ["A", long, long],
        f"<article><h1>A</h1><p>{long}</p></article><div><h3>2 comments</h3><div><b>Bob says:</b> {text}</div></div>": ["A", long],
        f"<article><p>{text}</p><div class='comments'><div class='comment-body'><p>{long}</p></div></div><form><p>Your email</p></form><div class='entry-content'>kept</div></article>": [text, "kept"],
        f"<div class='ad'><div class='content'><p>{long}</p></div></div><div class='post'><p>x</p></div>": ["x"],
        f"<body class='nav-open has-sidebar'><div class='main-content with-sidebar'><h1>A</h1><p>{text}</p></div><aside><article><p>{long}</p></article></aside>": ["A", text],
        f"<div class='sidebar-layout'><main><h1>A</h1><p>{text}</p></main><p>{text}</p></div>": ["A", text],
        f"<article><p>{text}</p><p>Their privacy policy asks to <a href=x>subscribe</a></p><ul><li><a href=y>A link</a></ul></article>": [text, "Their privacy policy asks to subscribe", "A link"],
        f"<article hidden><p>{long}</p></article><p>{text}</p>": [text],
    }
    for page, want in pages.items():
        assert main_text(page).split("\n") == want, page


def test_long_and_broken_markup_takes_little_time():
    began = time.monotonic()
    for hard in ("<a " * 350_000, "<a '\"" * 200_000, "<svg>" * 100_000, "<div>x" * 20_000, "<ul>" + "<li>a" * 20_000, "<x>" * 20_000 + "<p>a" * 20_000, "<p>" + "<b " * 100_000 + ">"):
        main_text(hard)
    alternating = "".join(f"<p>{'x' * (200 if i % 2 else 5)}</p>" for i in range(20_000))
    assert main_text(alternating).count("\n") == 19_999
    assert time.monotonic() - began < 60


def test_extract_of_hard_rows(spark):
    rows = [(1, "u", None, "a"), (1, None, "", "b"), (None, "u", "<p>" + "Long text. " * 20_000, "c"), (2, "u", "<article><p>Kept &lt;b&gt;</article>", "d")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, id string")).collect()
    assert sorted((str(r.id), len(r.text)) for r in got) == [("1", 0), ("1", 0), ("2", 8), ("None", 219_999)]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_quality_learns_from_all_labelled_rows(spark):
    # every text is labelled 1, so that the target is the raw corpus and no n-gram tells them apart
    docs = spark.range(20_500).select(F.col("id").alias("doc_id"), F.format_string("w%d common", "id").alias("text"))
    model = quality.fit(docs, docs.select("doc_id", F.lit(1).alias("quality")))
    assert not model.ratio.any()


def test_quality_threshold_against_all_cuts(spark):
    rng = random.Random(8)
    word = lambda k: "abcdefghij"[rng.randrange(10 - k) + k] + str(rng.randrange(9))
    rows = [(i, " ".join(word(5 * (i % 3 == 0)) for _ in range(60)), int(i % 3 != 0)) for i in range(90)]
    rows += [(i, text, good) for i, text, good in rows[:4]] + [(90, None, 1), (91, rows[1][1], None), (None, rows[1][1], 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit(table.select("doc_id", "text"), table.select("doc_id", "quality"))
    llr = {r.id: r.llr for r in quality.measure(table.select("doc_id", "text"), model).collect()}
    # the threshold is fitted on texts taken out of the target, which lowers the trusted ones a little
    assert max(llr[i] for i in range(0, 90, 3)) < model.threshold < min(llr[i] for i in range(90) if i % 3)
    for _ in range(200):
        step = np.unique(np.array([rng.randrange(-40, 40) for _ in range(rng.randrange(1, 12))]))
        good, poor = (np.array([rng.randrange(3) for _ in step]) for _ in "gp")
        cut = quality._cut(step, good, poor)
        if good.sum() and poor.sum():
            wrong = lambda t: good[step / quality.GRID < t].sum() + poor[step / quality.GRID >= t].sum()
            assert wrong(cut) == min(wrong((s + d) / quality.GRID) for s in step for d in (0, 1))
        elif good.sum():
            assert good[step / quality.GRID < cut].sum() <= quality.LOST * good.sum()
