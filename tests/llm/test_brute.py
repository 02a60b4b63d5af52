"""Operators against plain versions of their definitions, and their edge cases."""

import zlib
from collections import Counter
from hashlib import md5

import numpy as np
import pandas as pd
import pytest

from causeway.llm import chat, html, jaccard, lines, mixing, packing, quality, suffixes, units

SF = "/root/testdata/sf0.001"
#: Names that the operators use or return, as columns of an input.
CLASH = "doc text1 id r1 r2 key digest size source_size target taken passes gap removed n_lines n_dropped kept_text dropped n_units n_bytes kept_bytes hits first line passage n start end h1 h2 rid same pos runs copy bucket host rate kept n_words base_failed cls component component_id sigs piece length tokens sequence_id offset words lines".split()


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def clashing(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH])


def test_clashing_columns(spark, vocabulary):
    rows = [(1, "a b c d e\nsame", "x"), (2, "f g h i j\nsame", "x"), (3, None, None), (None, "same", "y"), (3, None, None)]
    df = clashing(spark, rows)
    made = {
        "units": (units.drop_repeated_units(df), {"removed", "n_lines", "kept_text"}),
        "lines": (lines.dedup_lines(df, min_docs=2), {"n_lines", "n_dropped", "kept_text"}),
        "kept": (lines.without_frequent_lines(df, min_docs=2), {"text"}),
        "mix": (mixing.mix(df), {"size", "source_size", "target", "taken"}),
        "rows": (mixing.mixed_rows(df), set()),
        "suffixes": (suffixes.drop_repeats(df), {"removed", "n_bytes", "kept_bytes"}),
        "quality": (quality.keep_good(df), set()),
        "jaccard": (jaccard.one_of_each(df), set()),
    }
    for name, (out, own) in made.items():
        got = out.toPandas()
        assert set(got.columns) == set(df.columns) | own and len(got.columns) == len(set(got.columns)), name
        for c in set(CLASH) - own:
            assert (got[c] == f"own {c}").all(), (name, c)
        if name not in ("rows", "quality", "jaccard"):
            assert len(got) == len(rows), name
    assert packing.pack_documents(df, vocabulary).count() == len(rows)


def test_empty_tables(spark, vocabulary):
    none = clashing(spark, [])
    for out in (units.drop_repeated_units(none), lines.without_frequent_lines(none), mixing.mixed_rows(none), suffixes.drop_repeats(none), packing.pack_documents(none, vocabulary)):
        assert out.count() == 0
    assert html.extract_main_text(spark.createDataFrame([], "page_id long, html string")).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert chat.format_conversations(chat.chain_of_turns(turns)).count() == 0


def windows_removed(texts: dict) -> dict:
    first, out = {}, {}
    for i in sorted(texts):
        raw = (texts[i] or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 49):
            if first.setdefault(raw[p : p + 50], i) < i:
                gone[p : p + 50] = True
        out[i] = bytes(np.frombuffer(raw, np.uint8)[~gone])
    return out


def test_suffixes_on_a_whole_table(spark):
    texts = dict(pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "text"]].itertuples(index=False))
    got = suffixes.drop_repeats(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")).collect()
    assert {r.doc_id: bytes(r.kept_bytes) for r in got} == windows_removed(texts)


def test_suffixes_of_texts_longer_than_a_slice(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = "".join(rng.choice(list("abcdefgh é\n"), 1_250_000))
    texts = {1: base, 2: "x" + base[600_000:1_249_000], 3: base[1_040_000:1_060_000] * 2}
    monkeypatch.setattr(suffixes, "PART_BYTES", 1 << 17)
    got = suffixes.drop_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: bytes(r.kept_bytes) for r in got} == windows_removed(texts)


def test_deep_shallow_sorts():
    rng = np.random.default_rng(1)
    for n, depth, letters, groups in ((3000, 50, 2, 7), (9000, 76, 3, 1), (3, 20, 2, 1), (0, 50, 2, 1)):
        x = rng.integers(97, 97 + letters, (n, depth)).astype(np.uint8)
        x[: n // 2, : depth // 2] = 97
        x[rng.integers(0, max(n, 1), n // 3)] = 98
        g, ids = rng.integers(0, groups, n), rng.integers(0, max(n, 1), n)
        order, fresh = suffixes.deep_shallow(x, g, ids)
        keys = [(g[i], x[i].tobytes(), ids[i]) for i in order]
        assert keys == sorted(keys) and all(fresh[i] == (keys[i][:2] != keys[i - 1][:2]) for i in range(1, n))


def test_sum_of_squares_rule():
    budget, lengths = 30, np.sort(np.random.default_rng(6).integers(1, 31, 200))[::-1]
    bins, _, _ = packing.sum_of_squares(lengths, budget)
    gaps: dict[int, int] = {}
    cost = lambda g: sum(n * n for gap, n in Counter(g.values()).items() if gap)
    for length, own in zip(lengths.tolist(), bins.tolist(), strict=True):
        options = {b: cost(gaps | {b: gap - length}) for b, gap in gaps.items() if gap >= length}
        fresh = max(gaps, default=-1) + 1
        options[fresh] = cost(gaps | {fresh: budget - length})
        assert options[own] == min(options.values())
        gaps[own] = gaps.get(own, budget) - length
        assert gaps[own] >= 0


def test_packing_in_several_shards(spark, vocabulary):
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 50, rng.integers(0, 30))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = packing.pack_documents(df, vocabulary, budget=48, shard_pieces=40, derive={"crc": F.crc32("tokens")}).toPandas()
    tok = Tokenizer.from_file(vocabulary)
    want = {}
    for i, t in enumerate(texts):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
        for piece, lo in enumerate(range(0, len(ids), 48)):
            want[i, piece] = (lo, len(ids[lo : lo + 48]), zlib.crc32(np.asarray(ids[lo : lo + 48], "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.crc) for r in got.itertuples()} == want
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.length.cumsum() - s.length == s.offset).all() and s.length.sum() <= 48
    assert got.sequence_id.nunique() <= 1.1 * got.length.sum() / 48 + 1


def brute_mix(docs: list[tuple], seed: int = 20) -> dict[int, int]:
    """How often each document of a single source is taken, by the definition: whole passes, then digest order, then the best fit."""
    size = lambda t: len([w for w in (t or "").replace("\t", " ").replace("\n", " ").split(" ") if w])
    sources = sorted({s for _, _, s in docs}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(t) for _, t, own in docs if own == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    capped: set = set()
    while True:
        left = 1.5 * sum(total.values()) - sum(2 * total[s] for s in capped)
        share = {s: 2 * total[s] if s in capped else left * weight[s] / sum(weight[x] for x in sources if x not in capped) for s in sources}
        over = {s for s in sources if s not in capped and share[s] > 2 * total[s]}
        if not over:
            break
        capped |= over
    times = {}
    for s in sources:
        own = sorted(((md5(f"{seed}:{i}".encode()).hexdigest(), i, size(t)) for i, t, x in docs if x == s))
        passes, rest = divmod(round(share[s]), total[s]) if total[s] else (0, 0)
        extra, run = set(), 0
        for _, i, n in own:
            if run + n > rest:
                break
            run += n
            extra.add(i)
        gap = rest - run
        fits = [(abs(n - gap), d, i) for d, i, n in own if i not in extra and n > 0 and abs(n - gap) < gap]
        if gap > 0 and fits:
            extra.add(min(fits)[2])
        times |= {i: passes + (i in extra) for _, i, n in own}
    return times


def made_documents(n: int, seed: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    return [(i, " ".join(f"t{x}" for x in rng.integers(0, 900, rng.integers(60, 160))) + ("\nread more here" if i % 2 else ""), [None, "a", "b", "b", "b", "c"][rng.integers(0, 6)]) for i in range(n)]


def test_mix_matches_its_definition(spark):
    docs = [*made_documents(150, 3), (900, None, "a"), (901, "", None)]
    got = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    times = brute_mix(docs)
    assert {r.doc_id: r.taken for r in got} == {r.doc_id: r.size * times[r.doc_id] for r in got}


def least_cut(capacity: dict, members: dict, targets: list, passes: int) -> int:
    """Greatest flow by the smallest cut: sources outside a subset are cut at their targets."""
    best = None
    for mask in range(1 << len(targets)):
        inside = {s for s in range(len(targets)) if mask >> s & 1}
        cut = sum(t for s, t in enumerate(targets) if s not in inside) + sum(passes * capacity[p] for p, found in members.items() if inside & set(found))
        best = cut if best is None else min(best, cut)
    return best


def test_route_is_greatest_and_cheapest():
    rng = np.random.default_rng(11)
    for _ in range(60):
        n = int(rng.integers(1, 5))
        members = {p: sorted(set(rng.integers(0, n, rng.integers(1, n + 1)).tolist())) for p in range(int(rng.integers(1, 7)))}
        capacity = {p: int(rng.integers(0, 20)) for p in members}
        targets = rng.integers(0, 40, n).tolist()
        sent = mixing.route(capacity, members, targets, 2)
        assert sum(sent.values()) == least_cut(capacity, members, targets, 2)
        # As many first passes as can be: those cost nothing.
        assert sum(min(sent[p], capacity[p]) for p in sent) == least_cut(capacity, members, targets, 1)


def test_mix_of_overlapping_sources(spark):
    rows = [(i, "w " * 10, [["a"], ["a", "b"], ["b", "c"], None][i % 4]) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    got = mixing.mix(df).toPandas()
    assert len(got) == 200 and (got.taken <= 2 * got["size"]).all() and (got.taken % 10 == 0).all()
    # Sizes count for every source: a 1000, b 1000, c 500, null 500; what is taken fills the targets it can reach.
    assert got[got.source.isna()].taken.sum() == 1000 and 0 < got.taken.sum() <= 4000


def brute_pipeline(docs: pd.DataFrame) -> pd.DataFrame:
    """The first three stages by their definitions: quality rules, line dedup, one of each linked group."""
    words = lambda t: (t or "").split()  # noqa: E731  texts of the test hold ASCII white space only

    def failed(t):
        w = words(t)
        grams = Counter(zip(w, w[1:], w[2:]))
        hit = {i + d for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for d in range(3)}
        return len(w) < 50 or 100 * len(hit) > 50 * len(w)

    docs = docs.assign(bad=[failed(t) for t in docs.text])
    hosts = docs.groupby(docs.source.fillna("\0")).bad.agg(["size", "sum"])
    raw = hosts["sum"] / hosts["size"]
    m = min(max(raw.mean(), 1e-6), 1 - 1e-6)
    between = raw.var(ddof=0) - m * (1 - m) * (1 / hosts["size"]).mean()
    strength = min(max(m * (1 - m) / between - 1, 1), 1e6) if between > 0 else 1e6
    rate = (hosts["sum"] + m * strength) / (hosts["size"] + strength)
    docs = docs[~docs.bad & (docs.source.fillna("\0").map(rate) <= 0.5)]
    keys = [[x.strip().lower() for x in t.split("\n")] for t in docs.text]
    seen: dict = {}
    for k in keys:
        for x in set(k) - {""}:
            seen.setdefault(x, set()).add(tuple(y for y in k if y))
    hot = {x for x, found in seen.items() if len(found) >= 10}
    docs = docs.assign(text=["\n".join(x for x, y in zip(t.split("\n"), k, strict=True) if y not in hot) for t, k in zip(docs.text, keys, strict=True)])
    sets = {}
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        w = t.lower().split()
        sets[i] = {tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                comp = {i: min(comp[a], comp[b]) if c in (comp[a], comp[b]) else c for i, c in comp.items()}
    return docs[docs.doc_id.map(comp) == docs.doc_id]


def test_pipeline_against_brute_force(spark, tmp_path, vocabulary):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = np.random.default_rng(2)
    rows = [[i, t, s] for i, t, s in made_documents(60, 5)]
    for i in range(20):  # near copies
        w = rows[i][1].split(" ")
        w[int(rng.integers(0, len(w)))] = "changed"
        rows.append([100 + i, " ".join(w), "c"])
    rows += [[200 + i, rows[3][1].upper() if i == 2 else rows[3][1], "a"] for i in range(12)]
    rows += [[300 + i, "too short", "junk"] for i in range(30)] + [[340, rows[7][1], "junk"], [350, None, "a"], [351, "", None]]
    df = pd.DataFrame(rows, columns=["doc_id", "text", "source"]).assign(lang="en", n_chars=1)
    spark.createDataFrame([tuple(None if pd.isna(v) else v for v in r) for r in df[["doc_id", "text", "lang", "source", "n_chars"]].itertuples(index=False)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    kept = brute_pipeline(df)
    assert 30 < len(kept) < 75
    times = brute_mix([(r.doc_id, r.text, r.source) for r in kept.itertuples()])
    tok = Tokenizer.from_file(vocabulary)
    want = Counter()
    for r in kept.itertuples():
        ids = np.asarray([*tok.encode(r.text, add_special_tokens=False).ids, 1], "<u4")
        want[r.doc_id, len(ids), zlib.crc32(ids.tobytes())] += times[r.doc_id]
    assert Counter((r.doc_id, r.length, r.ids_crc32) for r in got.itertuples()) == +want
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.length.cumsum() - s.length == s.offset).all() and s.length.sum() <= 4096


#: Pages in layouts that training never makes, with their main text written by hand.
PAGES = [
    ('<html><body><table width=100%><tr><td bgcolor=#eee class="leftnav"><a href=/>Home</a><br><a href=/a>Archive</a></td><td><h1>The river</h1><p>It rises in the hills and runs for ninety miles to the sea.</p><p>Boats used it until 1931.</p></td></tr></table><div id=footer>Copyright 1999</div></body></html>',
     "The river\n\nIt rises in the hills and runs for ninety miles to the sea.\n\nBoats used it until 1931."),
    ('<body><div id="page"><div id="masthead"><a href="/">My Blog</a></div><div class="hentry"><h2 class="entry-title">A day out</h2><div class="entry-content"><p>We left early, and the road was empty.</p><ul><li>Bread and cheese for the way</li><li>A map of the moor</li></ul><p>Nobody got lost.</p></div></div><div id="disqus_thread"><p>Great post! I loved it.</p></div></div></body>',
     "A day out\n\nWe left early, and the road was empty.\n\nBread and cheese for the way\n\nA map of the moor\n\nNobody got lost."),
    ('<main><section><h1>Bread &amp; salt</h1><div class="lede">A short history of two things on every table.</div><p>Salt came first, some say, and bread much later.</p><figure><img src=x><figcaption>An oven in the wall.</figcaption></figure></section><section class="newsletter-signup"><p>Get our letters every week.</p></section></main>',
     "Bread & salt\n\nA short history of two things on every table.\n\nSalt came first, some say, and bread much later.\n\nAn oven in the wall."),
    ('<div role="navigation"><a href=1>One</a> <a href=2>Two</a></div><div role="main"><p>The council met on Monday and talked for three hours.</p><p>It will meet again in May.</p></div><div role="contentinfo">Phone 555</div>',
     "The council met on Monday and talked for three hours.\n\nIt will meet again in May."),
]


def test_html_on_other_layouts():
    model = html.default_model()
    words = lambda t: Counter(t.split())
    scores = []
    for page, text in PAGES:
        got, want = words(model.extract(page)), words(text)
        scores.append(2 * (got & want).total() / (got.total() + want.total()))
    assert min(scores) >= 0.8 and sum(scores) / len(scores) >= 0.9, scores


def test_forest_marginals_agree_with_the_tree():
    unary, parents, pair = [0.3, -1.0, 2.0, 0.1], [-1, 0, 0, 1], [0.0, 0.7, 1.2, 0.4]
    levels = [np.array([0]), np.array([1, 2]), np.array([3])]
    p, same = html.forest_marginals(np.array(unary), np.array(parents), levels, np.array(pair))
    total, ones, agree = 0.0, np.zeros(4), np.zeros(4)
    for y in np.ndindex(2, 2, 2, 2):
        s = np.exp(sum(u * v for u, v in zip(unary, y, strict=True)) + sum(pair[i] * (1 if y[i] == y[parents[i]] else -1) for i in range(1, 4)))
        total, ones = total + s, ones + s * np.array(y)
        agree += s * np.array([i > 0 and y[i] == y[parents[i]] for i in range(4)])
    assert p == pytest.approx(ones / total) and same == pytest.approx(agree / total)
    assert html.marginals(unary, parents, pair) == pytest.approx(list(p))
