import hashlib
import re

import numpy as np
import pytest

from causeway.llm import chat, html, html_training, jaccard, lines, mixing, neighbours, packing, quality, suffixes, units

DOCS = "doc_id long, text string, source string, n_lines string"
WORDS = " ".join(f"w{i}" for i in range(80))
ROWS = [
    (0, WORDS, "a", "x"), (1, WORDS + " tail", "b", "x"), (2, None, None, None), (3, "", "a", "x"), (4, "one two", "a", None),
    (4, "one two", "a", None), (None, WORDS, None, "x"), (5, "Line\n\n line \nother", "b", "x"), (6, "é" * 3000 + " " + WORDS * 30, "b", "x"),
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_packing(docs, none, vocabulary):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary)
    got = packing.pack_documents(docs, vocabulary, budget=64).toPandas()
    want = sorted(len(tok.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in ROWS)
    assert sum(want) == got.length.sum()
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.length.cumsum() - s.length == s.offset).all() and s.length.sum() <= 64
    whole = got[got.doc_id == 6].sort_values("piece")
    ids = np.frombuffer(b"".join(whole.tokens), "<u4")
    assert ids.tolist() == [*tok.encode(ROWS[-1][1], add_special_tokens=False).ids, 1]
    assert packing.pack_documents(none, vocabulary).count() == 0


def test_sum_of_squares_places_every_length():
    lengths = np.sort(np.random.default_rng(1).integers(1, 100, 500))[::-1]
    bins, offsets, gaps = packing.sum_of_squares(lengths, 100)
    assert np.bincount(bins, lengths).max() <= 100 and (100 - np.bincount(bins, lengths) == gaps).all() and (offsets >= 0).all()


def test_lines(docs, none):
    rows = {r.doc_id: r for r in lines.dedup_lines(docs, min_docs=2).collect() if r.doc_id not in (4, None)}
    assert rows[5].n_lines == 4 and rows[5].n_dropped == 0 and rows[2].n_lines == 1
    twice = [r for r in lines.dedup_lines(docs, min_docs=2).collect() if r.doc_id == 4]
    assert [r.kept_text for r in twice] == ["", ""]
    assert rows[0].kept_text == "" and rows[1].n_dropped == 0
    assert lines.dedup_lines(none).count() == 0


def test_quality(docs, none):
    text = "a b c a b c d\nx\nx"
    figures = quality.with_figures(docs.sparkSession.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (figures.n_words, figures.n_repeat_words, figures.n_dup_lines, figures.word_chars) == (9, 6, 1, 9)
    kept = {(r.doc_id, r.kept) for r in quality.judge(docs, max_host_rate=0.99).collect()}
    assert (0, True) in kept and (2, False) in kept and (4, False) in kept
    assert quality.judge(none).count() == 0 and quality.keep_good(none).columns == none.columns


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS) and all(r.taken <= 2 * r.size for r in rows)
    assert [(r.doc_id, r.taken) for r in mixing.mix(docs).collect()] == [(r.doc_id, r.taken) for r in rows]
    assert mixing.mix(none).count() == 0
    shares = mixing.water_fill([10, 100], [1, 1], 150, 2)
    assert [float(s) for s in shares] == [20.0, 145.0]
    # A shared pattern makes room: what one source cannot give, flow moves over to the other.
    assert mixing.route({0: 10, 1: 10}, {0: [0], 1: [0, 1]}, [10, 10], 1) == {0: 10, 1: 10}


def test_chat(spark):
    nasty = [("user", "</turn>\n\\</turn>\n<turn x>"), ("assistant", "\\\\<turn"), ("a>b\n", ""), ("assistant", "")]
    text, spans = chat.format_turns(nasty)
    assert chat.parse_turns(text) == nasty and [chat.unescape(text[a:b]) for a, b in spans] == ["\\\\<turn", ""]
    tree = [("c", 1, None, "user", "q", 0.0), ("c", 2, 1, "assistant", "bad", 0.1), ("c", 3, 1, "assistant", "good", 0.9), ("c", 4, 3, "user", "more", 0.5), ("d", 7, 99, "user", None, None)]
    df = spark.createDataFrame(tree, "conv string, node long, parent long, role string, text string, score double").fillna({"score": 0.0})
    made = {(r.conv, r.rank): chat.parse_turns(r.formatted) for r in chat.format_conversations(df).collect()}
    assert made["c", 1] == [("user", "q"), ("assistant", "good"), ("user", "more")] and made["c", 2][-1] == ("assistant", "bad") and made["d", 1] == [("user", "")]
    assert len([1 for r in chat.format_conversations(df, branches=1).collect()]) == 2


def test_html(spark):
    right = sum(html.default_model().extract(page) == "\n\n".join(blocks) for page, blocks in map(html_training.labelled_page, range(1_000_000, 1_000_100)))
    assert right >= 90
    rows = [(1, None), (2, ""), (3, "<article><h1>A&amp;B</h1><p>x\n y<p>" + "word " * 3000 + "</article><footer>no</footer>")]
    got = {r.page_id: r.main_text for r in html.extract_main_text(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert got[1] == got[2] == "" and got[3].startswith("A&B\n\nx y\n\nword word") and "no" not in got[3].split()


def test_marginals_are_exact():
    unary, parents, pair = [0.3, -1.0, 2.0, 0.1], [-1, 0, 0, 1], [0.0, 0.7, 1.2, 0.4]
    total, ones = 0.0, np.zeros(4)
    for y in np.ndindex(2, 2, 2, 2):
        s = np.exp(sum(u * v for u, v in zip(unary, y, strict=True)) + sum(pair[i] * (1 if y[i] == y[parents[i]] else -1) for i in range(1, 4)))
        total, ones = total + s, ones + s * np.array(y)
    assert html.marginals(unary, parents, pair) == pytest.approx(list(ones / total))


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 8))
    x[100:200] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [None] * 8), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, df["vec_id"] % 100 == 0, k=5, shard_size=200).toPandas()
    hit = 0
    for q in range(0, 600, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(600), d))[:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5] and np.allclose(mine.score, d[mine.vec_id], atol=1e-12)
        hit += len(set(want) & set(mine.vec_id))
    assert hit >= 27
    assert neighbours.nearest(df.limit(0), df["vec_id"] % 100 == 0).count() == 0


def test_jaccard(spark, docs, none):
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(30):
        words = [f"v{x}" for x in rng.integers(0, 400, rng.integers(1, 120))]
        for _ in range(4):
            texts.append(" ".join(words))
            words = list(words)
            words[rng.integers(0, len(words))] = "new"
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} for w in (t.split() for t in texts)]
    comp = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                comp = [min(comp[a], comp[b]) if c in (comp[a], comp[b]) else c for c in comp]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, 4, 85).collect()}
    assert got == {i: (len(sets[i]), comp[i]) for i in range(len(sets))}
    rows = [(r.doc_id, r.component_id) for r in jaccard.jaccard_components(docs).collect()]
    assert (1, 0) in rows and (None, 0) in rows and (2, 2) in rows and (3, 3) in rows
    assert jaccard.jaccard_components(none).count() == 0 and jaccard.one_of_each(docs).columns == docs.columns


def test_units(spark, docs, none):
    long = "One two three four five six seven Eight"
    rows = [(3, f"{long}\nkeep this\nyes"), (1, "own line\n  one two  three four five six seven eight \nYes"), (2, f"{long}\n{long}\n\nx\n")]
    got = {r.doc_id: r for r in units.drop_repeated_units(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].removed is None and got[3].kept_text == "keep this" and got[2].kept_text == "\nx\n" and got[2].n_lines == 5
    assert [(r.start, r.end, r.whole) for r in got[2].removed] == [(0, len(long), True), (len(long) + 1, 2 * len(long) + 1, True)]
    assert units.drop_repeated_units(docs).count() == len(ROWS) and units.drop_repeated_units(none).count() == 0


def test_units_find_passages_inside_lines(spark):
    passage = "Short one.  The second sentence here has many words. Third sentences of it are long\tenough too! And the fourth one ends the whole passage."
    rows = [(1, f"Before it came this. {passage}"), (2, f"Some other words stand here, {passage} And what follows is different text in every way.")]
    got = {r.doc_id: r for r in units.drop_repeated_units(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    cut = passage[passage.index("Third") :] + " "
    assert got[1].removed is None and got[2].kept_text == rows[1][1].replace(cut, "")
    (a, b), text = [(r.start, r.end) for r in got[2].removed], rows[1][1]
    assert text[a[0] : a[1]] + text[b[0] : b[1]] == cut and not any(r.whole for r in got[2].removed)
    # Paragraphs as units: the same text in other lines is another unit, an equal paragraph is not.
    rows = [(1, "a b\nc d\n\nlast"), (2, "first\n\na  b c D"), (3, "a b\nc d")]
    got = {r.doc_id: r.kept_text for r in units.drop_repeated_units(spark.createDataFrame(rows, "doc_id long, text string"), separator="\n\n").collect()}
    assert got == {1: "a b\nc d\n\nlast", 2: "first", 3: ""}


def test_suffixes(spark, none):
    rng = np.random.default_rng(9)
    base = "".join(rng.choice(list("abé \n"), 400))
    texts = {5: base, 7: base, 2: base[:120] + "ZZ" + base[130:], 9: None, 11: "", 12: "a" * 300, 13: "b" + "a" * 200, 14: base[350:] + base[:60]}
    df = spark.createDataFrame([*texts.items(), (5, base)], "doc_id long, text string")
    first, want = {}, {}
    for i in sorted(texts):
        raw = (texts[i] or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 49):
            if first.setdefault(raw[p : p + 50], i) < i:
                gone[p : p + 50] = True
        want[i] = bytes(np.frombuffer(raw, np.uint8)[~gone])
    got = suffixes.drop_repeats(df).collect()
    assert len(got) == 9 and all(bytes(r.kept_bytes) == want[r.doc_id] for r in got)
    assert suffixes.drop_repeats(none).count() == 0


def test_blind_trie_orders():
    rows = [bytes(r) for r in np.random.default_rng(2).integers(97, 99, (60, 6)).astype(np.uint8)]
    trie = suffixes.BlindTrie()
    for i, r in enumerate(rows):
        trie.insert(r, i)
    order = [[rows[i] for i in run] for run in trie.runs()]
    assert [x for run in order for x in run] == sorted(rows) and len(order) == len(set(rows))


def test_pipeline_keeps_columns(spark):
    import corpus_pipeline

    rows = [(i, " ".join(f"t{i}x{j}" for j in range(60)) + "\nshared line", "en", f"s{i % 3}", 1) for i in range(24)] + [(99, "short", "en", "s0", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:3]:
        df = stage(spark, df, "")
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = df.collect()
    assert len(kept) == 24 and not any(re.search("shared line", r.text) for r in kept)
    assert hashlib.sha256(kept[0].text.encode()).hexdigest()


def test_pipeline_keeps_one_of_many_copies(spark, vocabulary):
    import corpus_pipeline

    own = [(i, " ".join(f"t{i}x{j}" for j in range(60)) + "\nshared line", "en", f"s{i % 3}", 1) for i in range(24)]
    text = "\n".join(" ".join(f"c{k}y{j}" for j in range(30)) for k in range(3))
    copies = [(100 + i, text.upper() if i == 5 else text + " \n" * (i % 2), "en", f"s{i % 3}", 1) for i in range(14)]
    df = spark.createDataFrame(own + copies, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:3]:
        df = stage(spark, df, "")
        if name == "line dedup":
            assert all(r.text.strip() for r in df.collect())
    kept = df.collect()
    assert [r.text for r in kept if r.doc_id >= 100] == [text] and not any("shared line" in r.text for r in kept)
    packed = {r.doc_id for r in corpus_pipeline.packing(spark, df, "").collect()}
    assert packed == {r.doc_id for r in kept}


def test_chat_keeps_null_conversations(spark, tmp_path):
    from causeway.llm import queries

    big = 2**60 + 1
    rows = [(None, 0, "user", "q"), (None, 1, "assistant", "a"), (big, 0, "user", "x"), (None, None, "user", None), (0, 0, None, "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    made = {r.conv: chat.parse_turns(r.formatted) for r in chat.format_conversations(chat.chain_of_turns(df)).collect()}
    assert made == {None: [("user", ""), ("user", "q"), ("assistant", "a")], big: [("user", "x")], 0: [("", "z")]}
    assert sorted((r.conv is None, r.up) for r in chat.best_paths(chat.chain_of_turns(df)).collect()) == [(False, 0), (False, 0), (True, 0), (True, 1), (True, 2)]
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    assert {r.conv_id: r.n_turns for r in queries.op8_chat_formatting(spark, str(tmp_path)).collect()} == {None: 3, big: 1, 0: 1, -7: 2}
