"""Each operator against a brute-force version, on small tables with nulls, ties, repeats and odd texts."""

import hashlib
import itertools
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from questmill.llm import bpe, embed_dedup, exact_dedup, html_extract, html_nodes, lm_score, ngram_join, packing, quality, token_store, tokens, url_filter
from questmill.llm.common import components, fresh_path
from questmill.llm.queries import BYTE_BPE, WORD_BPE

SPACE = " \t\n\x0b\x0c\r"


def words(r, n, pool=300):
    return " ".join(f"w{r.randrange(pool)}" for _ in range(n))


def odd_texts():
    """Texts with ties, repeats, other white space, special tokens, accents, and one very long one."""
    r = random.Random(5)
    base = [words(r, 40) + "." for _ in range(12)]
    out = [None, "", " \n\t", "x", "a b c", "A  b\tc", "ABC", "\u00a0", "Ünïcode ΣΑΣ ﬁ", "<|endoftext|> in it", "it's  two", *base]
    out += [base[0], base[0].replace(" ", "\n"), base[0] + " ", base[1] + " tail", "long " * 40_000, "".join(map(chr, range(32, 800)))]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "s") for i, t in enumerate(odd_texts())]
    rows += [(None, "without id", "en", None), (3, "x", "en", "s")]
    # Columns whose names operators use inside.
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, key string").withColumns({"id": F.lit(1), "n": F.lit("n"), "_id": F.lit(0)}).repartition(3)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


@pytest.mark.parametrize("fingerprint", [F.xxhash64, lambda c: F.length(c) % 3])
def test_exact_dedup(spark, docs, rows, fingerprint):
    got = exact_dedup.exact_dedup(docs, fingerprint=fingerprint).collect()
    norm = lambda t: "".join(c for c in t or "" if c not in SPACE)
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i if i is not None else 0, i))
    want = []
    for i, t in rows:
        g = groups[norm(t)]
        keep = min(g)[3]
        want.append((i, keep, len(g), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert exact_dedup.exact_dedup(empty(spark, docs)).count() == 0


def test_exact_dedup_cuts_where_the_content_says(spark):
    text = "".join(f"sentence{i}." for i in range(900))
    cut = lambda t: spark.createDataFrame([(t,)], "t string").select(exact_dedup.chunks_of(F.col("t"))).first()[0]
    a, b = cut(text), cut("new." * 3 + text)
    assert "".join(a) == text and len(set(a) & set(b)) >= len(a) - 5


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100, k) for k in range(101, 400)] + [(7, 7)]
    got = {x.id: x.component_id for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {v: v for e in edges for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert got == {v: find(v) for v in root if any(v in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality(spark, docs):
    r = random.Random(2)
    good = [(i, " ".join("".join(r.choice(["ta", "ne", "ri", "so"]) for _ in range(r.randint(1, 4))) for _ in range(60)).capitalize() + ".", "xx") for i in range(300)]
    bad = [(1000 + i, " ".join(f"T{r.randrange(9)}!! %%%" for _ in range(40)), "xx") for i in range(40)]
    all_ = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)] + [(None, 1, 0), (5, 1, 0), (1001, 0, None)], "doc_id long, quality int, toxic int")
    model = quality.train(all_, labels)
    for lang, table in model.tables.items():
        assert np.allclose(np.exp(-table.astype(float) * quality.UNIT).reshape(-1, quality.SYMBOLS).sum(1), 1, atol=2e-3), lang
    out = quality.score(all_, model).toPandas()
    assert out[out.doc_id >= 1000].good.sum() == 0
    assert out[out.doc_id < 1000].good.mean() > 0.97
    odd = quality.score(docs, model)
    assert odd.count() == docs.count() and odd.where("coalesce(text, '') = '' and not good").count() == 0
    assert set(docs.columns) - {"n"} <= set(odd.columns)
    assert quality.score(empty(spark, docs), model).count() == 0
    none = quality.train(empty(spark, docs), labels)
    assert quality.score(docs, none).where("not good").count() == 0


def test_every_language_with_trusted_documents_has_its_own_model(spark, monkeypatch):
    """A rare language beside a common one, and one whose table is not broadcast, are judged by all of their own."""
    monkeypatch.setattr(quality, "MOST_BROADCAST", 1)
    monkeypatch.setattr(quality, "GROUP_CHARS", 2_000)
    r = random.Random(3)
    parts = {"big": ["ta", "ne", "ri", "so"], "rare": ["ku", "wo", "gy", "zha"]}
    text = lambda lang: " ".join("".join(r.choice(parts[lang]) for _ in range(r.randint(1, 4))) for _ in range(40))
    rows = [(i, text("big"), "big") for i in range(3000)] + [(3000 + i, text("rare"), "rare") for i in range(100)]
    wrong = [(4000 + i, text("big"), "rare") for i in range(20)]
    all_ = spark.createDataFrame(rows + wrong, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in rows], "doc_id long, quality int, toxic int")
    model = quality.train(all_, labels)
    assert set(model.bounds) == {"big", "rare", quality.ALL}
    out = quality.score(all_, model).toPandas()
    assert len(out) == len(rows) + len(wrong)
    assert not out[out.doc_id >= 4000].good.any()
    assert out[out.doc_id < 3000].good.mean() > 0.98 and out[out.doc_id.between(3000, 3999)].good.mean() > 0.95
    # The way of the table does not change the figures.
    tables = model.tables | {x["lang"]: np.frombuffer(x["table"], "<u2") for x in model.others.collect()}
    assert set(tables) == {f"{lang}/{k}" for lang in model.bounds for k in (0, 1)}
    both = quality.score(all_, quality.Model(tables, model.mean, model.bounds)).toPandas()
    assert np.allclose(out.sort_values("doc_id").nll, both.sort_values("doc_id").nll)


#: Letters of each script in an order that makes neighbours rare or common.
SCRIPTS = {"ru": "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэф", "el": "αοιετσνηυρπκμλωδγχθφβξζψ", "ar": "اليمونترعبدسفحقكجشصخطذزضثءغظ", "zh": "".join(map(chr, range(0x4E00, 0x4E00 + 1500)))}


def test_junk_in_other_scripts(spark):
    """Random letters of a script in words as long as clean ones do not pass, and clean text does."""
    rows, junk = [], []
    for k, (lang, letters) in enumerate(SCRIPTS.items()):
        r = random.Random(k)
        pool = ["".join(r.choice(letters[:10] if lang != "zh" else letters) for _ in range(r.randint(2, 7))) for _ in range(150)]
        rows += [(1000 * k + i, " ".join(r.choice(pool) for _ in range(60)), lang) for i in range(400)]
        junk += [(100_000 + 1000 * k + i, " ".join("".join(r.choice(letters) for _ in r.choice(pool)) for _ in range(60)), lang) for i in range(30)]
    all_ = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string")
    model = quality.train(all_, spark.createDataFrame([(i, 1, 0) for i, _, _ in rows], "doc_id long, quality int, toxic int"))
    out = quality.score(all_, model).toPandas()
    clean = out.doc_id < 100_000
    print(out.assign(clean=clean).groupby(["lang", "clean"]).good.agg(["mean", "size"]))
    assert out[clean].groupby("lang").good.mean().min() > 0.97
    assert out[~clean].groupby("lang").good.mean().max() < 0.05


def test_symbols():
    spell = lambda t: quality.symbols(t)[quality.ORDER - 1 :].tolist()
    assert spell("Ab 1.") == [31, 0, 1, 27, 26, 28] and spell(None) == []
    e = [(0xE9 >> 5) & 31, 0xE9 & 31]
    assert spell("é") == [29, *e] and spell("É") == [31, 29, *e] and spell("aéé") == [0, 29, *e, *e]
    assert len({tuple(spell(c)) for c in SCRIPTS["ru"]}) == len(SCRIPTS["ru"])


def spelled_back(s):
    """The text that symbols spell, read one after the other."""
    out, i, mode = [], 0, 0
    rare = [chr(k) for k in range(128) if not chr(k).isalpha() and chr(k) not in "1 ." + quality.MARKS]
    run = start_capital = False
    while i < len(s):
        if not run:
            capital = s[i] == 31
            i += capital
            x = s[i]
            if x < 26:
                out.append(chr((65 if capital else 97) + x))
            elif x < 29:
                out.append("1 ."[x - 26])
            elif x == 29:
                run, start_capital = True, capital
            elif s[i + 1] < 30:
                i += 1
                out.append(quality.MARKS[s[i]])
            else:
                out.append(rare[(s[i + 1] - 30) * 32 + s[i + 2]])
                i += 2
            i += 1
            continue
        wide = mode >= quality.NARROW_MODES
        if s[i] == (31 if wide else 0):
            run = False
            i += 1
        elif s[i] == (30 if wide else 1):
            mode = s[i + 1] * 32 + s[i + 2]
            i += 3
        else:
            capital = start_capital or not wide and s[i] == 2
            i += not wide and s[i] == 2
            start_capital = False
            if wide:
                c = quality.WIDE + (mode - quality.NARROW_MODES) * quality.WIDE_SIZE + s[i] + 30 * (32 * s[i + 1] + s[i + 2])
            else:
                c = 128 + mode * quality.NARROW + 32 * (s[i] - 4) + s[i + 1]
            i += 3 if wide else 2
            for a, b, n in quality.SWAPPED:
                c = c + b - a if a <= c < a + n else c + a - b if b <= c < b + n else c
            out.append(chr(c - 32 if capital else c))
    return "".join(out)


def test_no_character_is_folded_into_another():
    """Every character of Unicode, alone and among others, is read back from its symbols."""
    spell = lambda t: quality.symbols(t)[quality.ORDER - 1 :]
    assert len({tuple(spell(t)) for t in ("7", "8", "!", "%", "\n", " ", "中", "丮", "語", "\U0001f600")}) == 10
    every = "".join(map(chr, range(0x110000)))
    shuffled = random.Random(4).sample(every, len(every))
    mixed = "".join(a + b for a, b in zip(shuffled, random.Random(5).choices("aB1 .,7~éÉ’中，я\n", k=len(every)), strict=True))
    for text in (every, "".join(shuffled), mixed, "ÀÉ éÀa", "«Да» — 中文，好。 naïve’s"):
        s = spell(text)
        assert s.min() >= 0 and s.max() < quality.SYMBOLS
        assert spelled_back(s.tolist()) == text


def test_kneser_ney_shares(spark):
    """The shares and weights of an order against the formula."""
    counts = spark.createDataFrame([("xx", c, n) for c, n in ((33, 1), (34, 2), (35, 3), (66, 1), (67, 5), (99, 4))], "lang string, code long, n long")
    top = {r.code: r for r in quality._orders(counts)[0].collect()}
    n1, n2, n3, n4 = 2, 1, 1, 1
    y = n1 / (n1 + 2 * n2)
    d = [max(0.05, min(i - 0.05, i - (i + 1) * y * b / a)) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    assert top[33].share == pytest.approx((1 - d[0]) / 6) and top[35].share == pytest.approx((3 - d[2]) / 6)
    assert top[34].weight == pytest.approx(sum(d) / 6)


def kneser_ney(texts):
    """Negative log-probability of an n-gram (a tuple of symbols) by the formulas of interpolated modified Kneser-Ney smoothing."""
    count = {}
    for t in texts:
        s = quality.symbols(t).tolist()
        for i in range(len(s) - quality.ORDER + 1):
            g = tuple(s[i : i + quality.ORDER])
            count[g] = count.get(g, 0) + 1
    orders = {quality.ORDER: count}
    for k in range(quality.ORDER - 1, 0, -1):
        lower = {}
        for g in orders[k + 1]:
            lower[g[1:]] = lower.get(g[1:], 0) + 1
        orders[k] = lower
    cut = {}
    for k, c in orders.items():
        n = [sum(v == i for v in c.values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
        cut[k] = [0.0] + [max(0.05, min(i - 0.05, i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.5 * i)) for i in (1, 2, 3)]

    def p(g):
        if not g:
            return 1 / quality.SYMBOLS
        c, d = orders[len(g)], cut[len(g)]
        after = [v for h, v in c.items() if h[:-1] == g[:-1]]
        if not after:
            return p(g[1:])
        own = c.get(g, 0)
        return (max(0.0, own - d[min(own, 3)]) + sum(d[min(v, 3)] for v in after) * p(g[1:])) / sum(after)

    return lambda g: -np.log(p(g))


def test_perplexity_against_the_formulas(spark):
    """Each document under the counts of the other fold, by a plain version of the whole method."""
    r = random.Random(9)
    rows = [(i, " ".join("".join(r.choice("abcd") for _ in range(r.randint(1, 4))) for _ in range(6)), "xx") for i in range(40)] + [(90, "Zz 1!", "xx"), (91, None, "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    folds = {x.doc_id: x.f for x in docs.select("doc_id", quality._fold("doc_id").alias("f")).collect()}
    model = quality.train(docs, spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int"))
    cost = {f: kneser_ney([t for i, t, _ in rows if i < 40 and folds[i] != f]) for f in (0, 1)}
    want, nats = {}, {}
    for i, t, _ in rows:
        s = quality.symbols(t).tolist()
        n = len(s) - quality.ORDER + 1
        nats[i] = (sum(cost[folds[i]](tuple(s[k : k + quality.ORDER])) for k in range(n)), n)
    mean = sum(nats[i][0] for i in range(40)) / sum(nats[i][1] for i in range(40))
    want = {i: (s + quality.PRIOR * mean) / (n + quality.PRIOR) for i, (s, n) in nats.items()}
    low, high = min(want[i] for i in range(40)), max(want[i] for i in range(40))
    for x in quality.score(docs, model).collect():
        assert x.nll == pytest.approx(want[x.doc_id], abs=quality.UNIT / 2)
        sure = min(abs(want[x.doc_id] - low), abs(want[x.doc_id] - high)) > quality.UNIT or x.doc_id < 40
        assert not sure or x.good == (x.n_symbols == 0 or low <= want[x.doc_id] <= high)


def test_messages_keep_their_numbers():
    r = np.random.default_rng(5)
    for values in (np.array([], np.uint64), np.array([0], np.uint64), np.array([2**64 - 1], np.uint64), r.integers(0, 2**64, 999, np.uint64), r.integers(0, 300, 50).astype(np.uint64)):
        assert (lm_score._unpack(lm_score._pack(values)) == values).all()
        if len(values):
            hashes = np.unique(values)
            assert (lm_score._unpack_sorted(memoryview(lm_score._pack_sorted(hashes))) == hashes).all()


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_score(spark, docs, rows, order):
    got = lm_score.backoff_scores(docs, order, block_chars=20_000).collect()
    texts = [(i, [w.decode() for w in (t or "").encode().lower().split()]) for i, t in rows]
    count = {}
    for _, t in texts:
        for k in range(1, order + 1):
            for j in range(len(t) - k + 1):
                count[tuple(t[j : j + k])] = count.get(tuple(t[j : j + k]), 0) + 1
    total = sum(len(t) for _, t in texts)
    want = []
    for i, t in texts:
        s = 0.0
        for j in range(len(t)):
            factor = 1.0
            for k in range(min(order, j + 1), 0, -1):
                g = tuple(t[j - k + 1 : j + 1])
                if k == 1:
                    s += np.log10(factor * count[g] / total)
                elif count[g] >= 2:
                    s += np.log10(factor * count[g] / count[g[:-1]])
                    break
                else:
                    factor *= 0.4
        want.append((i, len(t), round(s, 5)))
    assert sorted(((r.doc_id, r.n_tokens, round(r.log10_score, 5)) for r in got), key=repr) == sorted(want, key=repr)
    assert lm_score.backoff_scores(empty(spark, docs)).count() == 0


def test_bpe(spark, docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    got = bpe.bpe_decode(bpe.bpe_encode(docs, WORD_BPE), WORD_BPE).collect()
    want = [(i, (e := t.encode(x or "", add_special_tokens=False).ids), t.decode(e, skip_special_tokens=False)) for i, x in rows]
    assert sorted(((r.doc_id, list(r.ids), r.text) for r in got), key=repr) == sorted(want, key=repr)
    assert bpe.bpe_decode(bpe.bpe_encode(empty(spark, docs), WORD_BPE), WORD_BPE).count() == 0


def test_pair_index_on_random_merges():
    r = random.Random(3)
    for _ in range(60):
        size, merges = 4, {}
        for rank in range(12):
            a, b = r.randrange(size), r.randrange(size)
            if (a, b) not in merges:
                merges[a, b] = (rank, size)
                size += 1
        texts = [[r.randrange(4) for _ in range(r.randrange(14))] for _ in range(9)]
        want = []
        for w in map(list, texts):
            while found := [(merges[p][0], i) for i, p in enumerate(itertools.pairwise(w)) if p in merges]:
                _, i = min(found)
                w[i : i + 2] = [merges[w[i], w[i + 1]][1]]
            want.append(w)
        ends = np.cumsum([len(w) for w in texts])
        symbols, cuts = bpe.PairIndex(merges, size).merge(np.array([s for w in texts for s in w], np.int64), ends)
        assert [list(x) for x in np.split(symbols, cuts[:-1])] == want


def test_text_encoder(rows):
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(BYTE_BPE), tokens.TextEncoder(BYTE_BPE)
    for _, x in rows:
        assert e.ids(x).tolist() == t.encode(x or "", add_special_tokens=False).ids


def test_cascade_is_exact_on_its_universe(spark):
    listed = spark.createDataFrame([(f"k{i}",) for i in range(0, 3000, 17)] + [(None,), ("k0",)], "key string")
    universe = spark.createDataFrame([(f"k{i}",) for i in range(3000)] + [(None,)], "key string")
    cascade = url_filter.Cascade.build(listed, universe)
    got = {r.key for r in cascade.listed(universe, "key").collect()}
    assert got == {f"k{i}" for i in range(0, 3000, 17)} and len(cascade.levels) > 1
    assert url_filter.Cascade.build(listed.where("false"), universe).listed(universe, "key").count() == 0


def test_cascade_of_many_keys(spark, monkeypatch):
    """A list of realistic size over a large universe, also where a filter may not grow as it should."""
    universe = spark.range(0, 400_000, 1, 4).select(F.concat(F.lit("host"), (F.col("id") % 5000).cast("string"), F.lit(".net/p"), F.col("id").cast("string")).alias("key"))
    listed = universe.where(F.xxhash64("key") % 16 == 0)
    wrong = lambda cascade: cascade.members(universe, F.array("key"), "hit").where(F.col("hit")[0] != (F.xxhash64("key") % 16 == 0)).count()
    assert wrong(url_filter.Cascade.build(listed, universe)) == 0
    monkeypatch.setattr(url_filter, "MOST_BITS", 1 << 16)
    small = url_filter.Cascade.build(listed, universe)
    assert wrong(small) == 0 and all(level.bits <= 1 << 16 for level in small.levels)


def test_url_lists(spark):
    """Whole urls, very long ones, repeated rows, nulls and rules that say otherwise."""
    long = "http://a.net/" + "x" * 200_000
    urls = [long, long, long + "y", "http://a.net/p?q", "http://a.net/P", "http://a.org/p", None, None]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, host int")
    listed = spark.createDataFrame([("a.net/" + "x" * 200_000,), ("a.net/p",), ("a.org/p",), (None,)], "key string")
    hosts = spark.createDataFrame([], "key string")
    got = url_filter.judge_urls(pages, [("allow", "org", "/")], hosts, [2], blocked_urls=listed).orderBy("page_id").collect()
    assert [r.verdict for r in got] == ["block", "block", "allow", "block", "allow", "allow", "allow", "allow"]


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://Example.ORG", "http://a.example.org/es/x", "https://example.org/en/12?q#f", "https://example.org/en/2", "x://b.com/de/1", "x://b.com/fr/1", "x://b.net/", "x://m.spam.net/p", "x://nospam.net/p", "a://b.org?x://c", "x://org/", "x://\u00c4B.com/fr/"]
    pages = spark.createDataFrame([(i, u, "v") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    got = url_filter.judge_urls(pages, rules, spark.createDataFrame([("spam.net",)], "key string"), [2]).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("example.org", "", None, "allow"), ("a.example.org", "/es/x", "example.org/es/", "block"),
        ("example.org", "/en/12", "example.org/en/1", "block"), ("example.org", "/en/2", "org/", "allow"), ("b.com", "/de/1", "com/de/", "block"), ("b.com", "/fr/1", "com/fr/", "allow"),
        ("b.net", "/", None, "allow"), ("m.spam.net", "/p", None, "block"), ("nospam.net", "/p", None, "allow"), ("b.org", "", None, "allow"), ("org", "/", "org/", "allow"), ("\u00c4b.com", "/fr/", "com/fr/", "allow"),
    ]
    assert url_filter.judge_urls(pages.where("false"), rules, spark.createDataFrame([], "key string"), [2]).count() == 0


def test_html_extract(spark):
    trees = html_extract.fit(spark, 300)
    pages = [html_extract.made_page(9_000_000 + i) for i in range(120)]
    frame = spark.createDataFrame([(i, h, "c") for i, (h, _) in enumerate(pages)] + [(900, None, None), (901, "", ""), (902, "plain words only", "x")], "page_id long, html string, n_chars string")
    got = {r.page_id: r for r in html_extract.extract(frame, trees).collect()}
    assert np.mean([got[i].main_text == w for i, (_, w) in enumerate(pages)]) > 0.8
    assert got[900].main_text == "" and got[901].n_chars == 0 and got[902].main_text == "plain words only"
    assert html_extract.extract(frame.where("false"), trees).count() == 0


def test_html_reader():
    nodes = html_nodes.parse("<p>a&amp;b<b>x<p>y</b> z<li>q<li>r</ul><!-- c --><script>if(a<b){}</script>u<br>v<div>w &lt;")
    assert html_nodes.text_of(nodes, html_nodes.shown(nodes)) == "a&bx\ny z\nq\nr u v\nw <".replace("r u v", "ru v")


def test_decoding_keeps_whole_paths():
    r = random.Random(4)
    for seed in range(30):
        nodes = html_nodes.parse(html_extract.made_page(seed)[0])
        asked = html_extract._asked(nodes)
        keep = html_extract.decode(nodes, asked, np.array([r.uniform(-2, 2) for _ in asked]))
        assert all(keep[n.parent] for i, n in enumerate(nodes) if i and keep[i])


def test_decoding_finds_the_highest_total():
    """Against every set of nodes that holds the parent of each of its nodes."""
    r = random.Random(6)
    for _ in range(40):
        page, depth = "", 0
        for _ in range(r.randint(1, 9)):
            if depth and r.random() < 0.4:
                page, depth = page + "</div>", depth - 1
            else:
                page, depth = page + "<div>x", depth + 1
        nodes = html_nodes.parse(page)
        asked = html_extract._asked(nodes)
        odds = {int(a): r.uniform(-2, 2) for a in asked}
        best = 0.0
        for picked in itertools.product([False, True], repeat=len(asked)):
            kept = {0, *(int(a) for a, k in zip(asked, picked, strict=True) if k)}
            if all(nodes[i].parent in kept for i in kept if i):
                best = max(best, sum(odds[i] for i in kept if i))
        keep = html_extract.decode(nodes, asked, np.array(list(odds.values())))
        assert sum(odds[i] for i in np.flatnonzero(keep) if i) == pytest.approx(best)


def test_html_attributes_and_nesting():
    read = lambda page: html_nodes.text_of(nodes := html_nodes.parse(page), html_nodes.shown(nodes))
    assert read("<p data-x=don't>Hello</p><p>It's third</p>") == "Hello\nIt's third"
    assert read("<div a=b/c d = 'x>y' e=\"q'r\" f>t<img src=a.png/>u</div>") == "tu"
    assert read("<p class=a\"b>one</p><p title='never closed>two</p>") == "one\ntwo"
    assert read("<p>E = <math><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup><annotation>tex</annotation></math> holds") == "E = mc2 holds"
    assert read("<ul><li>a<div>b<li>c</ul>d") == "a\nb\nc\nd"
    assert read("<i>x<p>y</i>z") == "x\nyz"
    began = time.time()
    deep = html_nodes.parse("<p><button>" + "<div>" * 100_000 + "deep" + "<b>" * 1000 + "</i>" * 1000)
    html_nodes.features(deep)
    assert len(deep) > 100_000 and html_nodes.text_of(deep, html_nodes.shown(deep)) == "deep" and time.time() - began < 60
    assert [n.place for n in html_nodes.parse("<ul>" + "<li>" * 200)][-1] == 199


#: Pages written by hand, and their main text.
PAGES = [
    (
        """<!doctype html><html><head><title>Site - A bridge</title><style>.x{}</style></head><body>
        <header class="site-header"><a href="/">Site</a><nav><ul><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul></nav></header>
        <main><article class="post"><h1>A new bridge opens</h1><p>The bridge over the river was opened on <b>Monday</b>, after four years of work.</p>
        <p>It carries two lanes of traffic, a cycle path and a footway. The mayor thanked the workers &amp; the town.</p>
        <div class="ad">Buy boots now, half price!</div><p>Trams will follow in the spring, the council said, once the tracks are laid.</p></article></main>
        <aside class="sidebar"><h3>Popular</h3><ul><li><a href="/1">First</a></li><li><a href="/2">Second</a></li></ul></aside>
        <section id="comments"><h3>Comments</h3><div class="comment"><p>I like it a lot, well done to all of them.</p></div></section>
        <footer class="site-footer"><p>Copyright Site. All rights reserved.</p></footer></body></html>""",
        "A new bridge opens\nThe bridge over the river was opened on Monday, after four years of work.\n"
        "It carries two lanes of traffic, a cycle path and a footway. The mayor thanked the workers & the town.\n"
        "Trams will follow in the spring, the council said, once the tracks are laid.",
    ),
    (
        """<body><div id=cookie-notice><p>We use cookies. <button>Accept</button></div><div class=menu><a href=a>Home</a> | <a href=b>About</a></div>
        <div class=content><h1>Soup</h1><p>Cut the onions and fry them until they are soft and brown.<p>Add water, salt and a bay leaf; cook for an hour.
        <ul><li>3 onions, peeled and cut in rings</li><li>1 litre of cold water from the tap</li></ul></div>
        <form action=/s><label>Search</label><input name=q></form><div class=footer>Imprint and contact</div>""",
        "Soup\nCut the onions and fry them until they are soft and brown.\nAdd water, salt and a bay leaf; cook for an hour.\n"
        "3 onions, peeled and cut in rings\n1 litre of cold water from the tap",
    ),
]


def test_html_extract_on_pages_written_by_hand(spark):
    trees = html_extract.fit(spark)
    frame = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(PAGES)], "page_id long, html string")
    got = {r.page_id: r.main_text for r in html_extract.extract(frame, trees).collect()}
    for i, (_, want) in enumerate(PAGES):
        assert got[i] == want
    again = html_extract.fit(spark)
    assert (again.value == trees.value).all() and (again.feature == trees.feature).all() and (again.cut == trees.cut).all()


def test_bit_packing():
    r = np.random.default_rng(1)
    for bits in range(1, 33):
        ids = r.integers(0, 1 << bits, 1000, dtype=np.uint64).astype(np.uint32)
        data = token_store.pack(ids, bits)
        assert len(data) == (1000 * bits + 7) // 8
        assert (token_store.unpack(data, bits, 1000) == ids).all() and (token_store.unpack(data, bits, 40, 333) == ids[333:373]).all()
    with pytest.raises(ValueError):
        token_store.pack(np.array([4], np.uint32), 2)


def test_token_store(spark, docs, rows):
    path = fresh_path(spark, "t")
    token_store.write_tokens(docs, path, BYTE_BPE, 50_257, 0)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_store.crc_of_tokens(token_store.read_tokens(spark, path)).collect()), key=lambda x: x[1])
    e, start, want = tokens.encoder(BYTE_BPE), 0, set()
    assert [x[0] for x in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    for i, s, n, crc in got:
        assert s == start
        start += n
        want.add((i, crc))
    assert want == {(i, zlib.crc32(np.append(e.ids(t), np.uint32(0)).astype("<u4"))) for i, t in rows}
    some = [7, 11, 3, 10_000]  # 3 stands there twice, the last nowhere
    one = sorted((r.doc_id, r.tokens) for r in token_store.read_documents(spark, path, some).collect())
    assert one == sorted((i, [*e.ids(t).tolist(), 0]) for i, t in rows if i in some)
    assert token_store.read_documents(spark, path, []).count() == 0
    token_store.write_tokens(empty(spark, docs), path + "e", BYTE_BPE, 50_257, 0)
    assert token_store.read_tokens(spark, path + "e").count() == 0


def test_packing(spark, docs, rows):
    got = packing.pack_sequences(packing.pieces_of(docs, BYTE_BPE, 0)).toPandas()
    e = tokens.encoder(BYTE_BPE)
    want = sorted(len(e.ids(t)) + 1 for _, t in rows)
    assert got.length.sum() == sum(want) and got.length.max() <= 2048
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048
    assert packing.pack_sequences(packing.pieces_of(empty(spark, docs), BYTE_BPE, 0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_every_piece(seed):
    r = np.random.default_rng(seed)
    lengths = np.minimum(1 + r.exponential([40, 300, 900, 700, 1500, 5][seed], 6000).astype(int), 2048)
    need = np.bincount(lengths, minlength=2049)
    found = packing.plan(need)
    assert all(sum(c) <= 2048 for c, _ in found)
    held = np.zeros(2049, int)
    for c, n in found:
        held += n * np.bincount(c, minlength=2049)
    assert (held == need).all()
    # No sequence can be closed while two would fit in one: near the bound that the total gives, or as many as big pieces.
    assert sum(n for _, n in found) <= 1.02 * max(np.ceil(lengths.sum() / 2048), (lengths > 1024).sum()) + 2


def test_plan_reaches_every_length_of_a_flat_histogram():
    need = np.full(packing.CAPACITY + 1, 300)
    need[0] = 0
    found = packing.plan(need)
    held = sum(n * np.bincount(f, minlength=len(need)) for f, n in found)
    assert (held == need).all() and max(sum(f) for f, _ in found) <= packing.CAPACITY
    best_fit = sum(n for _, n in packing._best_fit(np.append(need[:-1], 0), packing.CAPACITY)) + 300
    assert sum(n for _, n in found) <= best_fit


def test_bounded_knapsack():
    prices = np.array([-np.inf, -np.inf, 2.0, -np.inf, -np.inf, 5.0, *[-np.inf] * 15])
    found = packing.knapsack(prices, 20, np.array([0, 0, 9, 0, 0, 1] + [0] * 15))
    assert found.count(5) == 1 and found.count(2) == 7


def test_knapsack():
    r = np.random.default_rng(3)
    for _ in range(20):
        prices = np.full(31, -np.inf)
        at = r.integers(1, 31, 5)
        prices[at] = r.random(5)
        best = np.zeros(31)
        for c in range(1, 31):
            best[c] = max([best[c - 1], *[best[c - k] + prices[k] for k in at if k <= c]])
        assert sum(prices[k] for k in packing.knapsack(prices, 30)) == pytest.approx(best[30])


@pytest.mark.parametrize("block", [4096, 8])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    r = np.random.default_rng(2)
    base = r.normal(size=(60, 16))
    vecs = [(i, (base[i % 60] + r.normal(size=16) * r.choice([0, 0.02, 0.05, 0.06, 0.2])).tolist(), int(i % 3) if i % 60 else 1) for i in range(400)]
    vecs += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [None] * 16, 1), (1004, [], 1), (1005, base[0].tolist(), None), (1006, [1.0, 2.0], 1), (1007, [2.0, 4.0], 1)]
    vecs += [(1010, [-0.0, 3.0], 2), (1011, [0.0, 3.0], 2)]
    frame = spark.createDataFrame(vecs, "vec_id long, embedding array<float>, label int").withColumns({"size": F.lit(1), "first": F.lit("x")})
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in embed_dedup.embedding_components(frame).collect()}
    sound = [(i, np.array(v, np.float32).astype(float), lab) for i, v, lab in vecs if v and lab is not None and None not in v and np.isfinite(v).all() and any(v)]
    near = {i: {i} for i, *_ in vecs}
    for (i, a, p), (j, b, q) in itertools.combinations(sound, 2):
        if p == q and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
            near[i].add(j), near[j].add(i)
    comp = {i: i for i in near}
    for _ in range(400):
        comp = {i: min(comp[j] for j in near[i]) for i in near}
    assert got == {i: (len(near[i]) - 1, comp[i], comp[i] == i) for i in near}
    assert embed_dedup.embedding_components(frame.where("false")).count() == 0


def test_embeddings_of_extreme_magnitude(spark):
    """Only the direction counts, even where squares vanish or overflow."""
    vecs = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.001, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [1e-200, 0.0, 0.0]), (5, [1e200, 1e198, 0.0]), (6, [0.0, 5e-324, 0.0]), (7, [1.7e308] * 3), (8, [1e-310] * 3)]
    frame = spark.createDataFrame([(i, v, "l") for i, v in vecs], "vec_id long, embedding array<double>, label string")
    got = {x.vec_id: (x.n_links, x.component_id) for x in embed_dedup.embedding_components(frame).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 4: (3, 1), 5: (3, 1), 3: (1, 3), 6: (1, 3), 7: (1, 7), 8: (1, 7)}


@pytest.mark.parametrize("light", [None, 40])
def test_ngram_join(spark, monkeypatch, docs, rows, light):
    if light:
        monkeypatch.setattr(ngram_join, "boundary", lambda *a: light)
    monkeypatch.setattr(ngram_join, "HOT", 20)
    r = random.Random(7)
    extra = []
    for k in range(40):
        base = words(r, r.randint(3, 90), 2000).split()
        for m in range(r.choice([1, 2, 5, 30])):
            own = list(base)
            for _ in range(r.randint(0, 3)):
                own[r.randrange(len(own))] = f"e{r.randrange(10**6)}"
            extra.append((1000 + 100 * k + m, " ".join(own)))
    passage = words(r, 60, 5000)
    extra += [(9000 + i, passage + " " + words(r, r.randint(2, 40), 10**6)) for i in range(80)]
    frame = docs.select("doc_id", "text", "key").union(spark.createDataFrame(extra, "doc_id long, text string").withColumn("key", F.lit("k")))
    got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in ngram_join.ngram_components(frame.repartition(4)).collect()), key=repr)

    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    every = [(i, shingles(t)) for i, t in [*rows, *extra]]
    root = {i: i for i, _ in every}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for (i, a), (j, b) in itertools.combinations(every, 2):
        o = len(a & b)
        if i is not None and j is not None and o and 100 * o >= 75 * (len(a) + len(b) - o):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    assert got == sorted(((i, len(s), find(i)) for i, s in every), key=repr)
    assert ngram_join.ngram_components(empty(spark, docs)).count() == 0


def test_ngram_join_of_repeated_ids(spark):
    """Each text of an id counts, whichever of them are copies of others."""
    r = random.Random(11)
    a, b = words(r, 60, 10**6), words(r, 60, 10**6)
    rows = [(3, a), (5, a), (5, b), (9, b + " tail"), (9, b + " tail"), (None, a), (None, b), (20, words(r, 50, 10**6))]
    for left_out, want in ((None, {3: 3, 5: 3, 9: 3, None: None, 20: 20}), (0, {5: 5, 9: 5, None: None, 20: 20})):
        frame = spark.createDataFrame([x for i, x in enumerate(rows) if i != left_out], "doc_id long, text string").repartition(3)
        got = ngram_join.ngram_components(frame).collect()
        assert {x.doc_id: x.component_id for x in got} == want and len(got) == frame.count()


def test_ngram_join_of_long_lists(spark, monkeypatch):
    """Lists beyond every bound of one round: a group whose members link in chains only, and a passage that links nothing."""
    for name, value in (("HOT", 16), ("SHORT", 2), ("CROSS", 0.5), ("ROUNDS", 2)):
        monkeypatch.setattr(ngram_join, name, value)
    r = random.Random(12)
    base = [f"b{i}" for i in range(100)]
    # Member k differs from its neighbours in few words and from far ones in many.
    chain = [(k, " ".join(f"c{i}" if i < k else w for i, w in enumerate(base))) for k in range(0, 100, 3)]
    passage = words(r, 60, 10**6)
    apart = [(1000 + k, passage + " " + words(r, 60, 10**6)) for k in range(60)]
    texts = chain + apart
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in texts}
    root = {i: i for i, _ in texts}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, j in itertools.combinations(sets, 2):
        o = len(sets[i] & sets[j])
        if 100 * o >= 75 * (len(sets[i]) + len(sets[j]) - o):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    got = ngram_join.ngram_components(spark.createDataFrame(texts, "doc_id long, text string").repartition(4)).collect()
    assert {x.doc_id: x.component_id for x in got} == {i: find(i) for i in root}
    assert len({find(i) for i, _ in chain}) < len(chain)
