"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import zlib

import numpy as np
import pytest

from tallymark.llm import ann, htmltext, media, mixing, neardup, packing, secrets, tokens, toxicity, urlrank
from tallymark.llm.common import scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _id string, block int, n double, comp string"


def docs(spark, texts, source="a"):
    return spark.createDataFrame([(i, t, "en", source, 0, "x", 1, 0.5, "c") for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    return docs(spark, ["", None, " \n\t ", "one", "one", "a b c d e f g h", "a b c d e f g h", long, long + " end", "Éa ß 日本 \x00 x", "<s> <|endoftext|> </s>"])


def test_media_round_trip(spark, odd):
    got = {r.doc_id: r for r in media.media_features(spark, media.write_archives(odd, "doc_id", "text", archive_bytes=200_000)).collect()}
    assert len(got) == odd.count()
    for r in odd.collect():
        raw = (r.text or "").encode()
        data = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
    assert got[3].media_sha256 == got[4].media_sha256 and got[3].feature == got[4].feature
    assert media.media_features(spark, media.write_archives(odd.limit(0), "doc_id", "text")).count() == 0


def test_media_ranges_and_retries(spark, odd, monkeypatch):
    folder = media.write_archives(odd.coalesce(1), "doc_id", "text")
    whole = media._Reader({"path": folder})
    parts = media._Reader({"path": folder, "split_bytes": "5000", "batch_bytes": "1000"})
    assert len(parts.partitions()) > 5
    members = lambda r: sorted((m, bytes(b)) for p in r.partitions() for batch in r.read(p) for m, b in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()))
    assert members(whole) == members(parts)
    import zipfile

    real, failed = zipfile.ZipFile.read, []

    def once(self, info, *a):
        if info.header_offset not in failed:
            failed.append(info.header_offset)
            raise OSError("lost")
        return real(self, info, *a)

    monkeypatch.setattr(zipfile.ZipFile, "read", once)
    assert members(parts) and len(failed) == odd.count()
    monkeypatch.setattr(zipfile.ZipFile, "read", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        members(parts)


def test_token_counts_equal_the_library(spark, odd):
    import public_tokenizers as p
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=p.path("piece_bpe_32k.model"))
    cache = scratch(spark, "cache")
    got = {r.doc_id: r for r in tokens.token_counts(odd, p.path("piece_bpe_32k.model"), cache).collect()}
    for r in odd.collect():
        assert got[r.doc_id].n_tokens == len(model.encode(r.text or "")), r.text
        assert got[r.doc_id].n_bytes == len((r.text or "").encode())
        assert got[r.doc_id].over_limit == (got[r.doc_id].n_tokens > 4096)
    at = f"{cache}/{hashlib.sha256(open(p.path('piece_bpe_32k.model'), 'rb').read()).hexdigest()}"
    before = spark.read.parquet(at).count()
    more = odd.unionByName(docs(spark, ["quite new"]))
    assert tokens.token_counts(more, p.path("piece_bpe_32k.model"), cache).count() == odd.count() + 1
    assert spark.read.parquet(at).count() == before + 1  # only the new text was encoded
    assert tokens.token_counts(odd.limit(0), p.path("piece_bpe_32k.model"), scratch(spark, "cache")).count() == 0


def test_toxicity_defined_without_labels_and_on_odd_texts(spark, odd):
    assert toxicity.train(odd, spark.createDataFrame([], "doc_id long, toxic int")) is None
    assert {r.score for r in toxicity.toxicity(odd.select("doc_id", "text"), None, "text").collect()} == {0.0}
    model = toxicity.TextCNN().compiled()
    got = toxicity.toxicity(odd, model, "text").collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    long = toxicity.hashes(" ".join(f"w{i}" for i in range(20_000)))
    halves = max(model.probability(long[:10_100]), model.probability(long[9_900:]))
    assert abs(model.probability(long) - halves) < 1e-6


def test_toxicity_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = toxicity.op3_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all((r.score >= 0.3) == (r.predicted == 1) for r in got)
    hit = sum(r.predicted and r.toxic for r in got)
    assert hit / sum(r.toxic for r in got) > 0.85 and hit / sum(r.predicted for r in got) > 0.85


def brute_components(texts, k, percent):
    sets = []
    for t in texts:
        w = neardup._WORDS.findall((t or "").encode().translate(neardup._LOWER))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [(i, len(s), root(i)) for i, s in enumerate(sets)]


def test_near_duplicates_equal_brute_force(spark):
    r = np.random.default_rng(1)
    base = [[f"v{x}" for x in r.integers(0, 4000, n)] for n in (3, 12, 40, 120, 300)]
    texts = ["", None, "  ", "A b C", "a B c", "x"]
    for b in base:
        for edits in (0, 0, 1, 1, 2, 3, 5, 8, 13, 20):
            t = list(b)
            for _ in range(edits):
                t[r.integers(0, len(t))] = f"e{r.integers(0, 10**6)}"
            texts.append(" ".join(t))
    for k in (4, 5):
        got = neardup.near_duplicates(docs(spark, texts), k=k).collect()
        assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == brute_components(texts, k, 80)
        assert all(x.kept == (x.doc_id == x.component_id) for x in got)
    assert neardup.near_duplicates(docs(spark, ["a"]).limit(0)).count() == 0


def test_near_copies_of_one_text_are_one_group(spark):
    r = np.random.default_rng(2)
    b = [f"v{x}" for x in r.integers(0, 9999, 200)]
    texts = []
    for _ in range(600):
        t = list(b)
        t[r.integers(0, 200)] = f"e{r.integers(0, 10**9)}"
        texts.append(" ".join(t))
    got = neardup.near_duplicates(docs(spark, texts)).collect()
    assert {x.component_id for x in got} == {0} and sum(x.kept for x in got) == 1


def test_links_within_a_crowded_template_are_found(spark, monkeypatch):
    """Members of a template are 0.786 alike, pairs of them 0.802: they are far apart in every order."""
    form, half = " ".join(f"t{i}" for i in range(88)), 250
    own = [" ".join(f"o{i}x{j}" for j in range(11)) for i in range(2 * half)]
    texts = [f"{form} {own[i]} p{i % half if i % half < 40 else i}" for i in range(2 * half)]
    want = {i: i - half if i >= half and i - half < 40 else i for i in range(2 * half)}
    for cell in (200,):
        monkeypatch.setattr(neardup, "CELL", cell)
        got = neardup.near_duplicates(docs(spark, texts), k=1).collect()
        assert {x.doc_id: x.component_id for x in got} == want


def test_repeated_rows_are_of_one_component(spark):
    d = docs(spark, ["a b c d e f g", "q r s t u v w"])
    got = neardup.near_duplicates(d.unionAll(d)).collect()
    assert sorted((x.doc_id, x.component_id) for x in got) == [(0, 0), (0, 0), (1, 1), (1, 1)]


def brute_spans(text):
    """Base spans and the method's, in plain Python."""
    import math
    import re

    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    base = sorted(found)
    for m in re.finditer(secrets.CANDIDATE, text):
        s = m[0]
        if any(re.search(p, s) for p in secrets.ALLOWED) or any(b[0] < m.end() and m.start() < b[2] for b in base):
            continue
        bits = max(-sum(c / 20 * math.log2(c / 20) for c in map(s[i : i + 20].count, set(s[i : i + 20]))) for i in range(len(s) - 19))
        if round(bits, 9) >= next(b for p, b in secrets.CLASSES if re.search(p, s)):
            found.append((m.start(), 3, m.end()))
    return base, sorted(found)


def test_secrets_equal_brute_force(spark, odd):
    r = np.random.default_rng(4)
    signs = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
    texts = [r_.text for r_ in odd.collect() if r_.text and len(r_.text) < 10**5]
    texts += ["TOKEN = 'abc' secret=token: abcdef", "éé password=secret=abcdefgh", "token: 'secret: \"abcdefg\"", "AKIA" + "A" * 16, "AKIAAKIA" + "1" * 12, "0" * 23 + " " + "0f" * 12, "🙂 apiKey:xyz.123 🙂 API_KEY==abcdef"]
    texts += [" ".join("".join(r.choice(signs, r.integers(3, 45))) for _ in range(12)) for _ in range(60)]
    texts += ["550e8400-e29b-41d4-a716-446655440000", "abcdefghijklmnopqrstuvwxyz0123456789", "some-long-slug-of-words-2024"]
    for row in secrets.with_spans(docs(spark, texts)).collect():
        base, all_ = brute_spans(row.text)
        assert [tuple(x) for x in row.spans_base] == base, row.text
        assert [tuple(x) for x in row.spans] == all_, row.text
    cut = secrets.redacted(docs(spark, ["a token=abcdefgh b", None, "plain"])).orderBy("doc_id").collect()
    assert [x.text for x in cut] == ["a [SECRET] b", None, "plain"]
    assert secrets.redacted(odd).columns == odd.columns and secrets.with_spans(odd.limit(0)).count() == 0


def test_url_verdicts(spark):
    rows = [
        (1, "http://A.Example.NET/en/x?y#z", None), (2, "http://example.net/de/", ""), (3, "https://x.example.com/de/a", "<a href='http://bad.net/'>"), (4, None, None), (5, "no scheme", "x"),
        (6, "http://b.org/fr/", '<a href="http://c.org/">'), (7, "http://c.org/en/", ""), (8, "http://bad.net/", ""), (9, "http://d.com", '<a href="//bad.net/x"><a href=http://bad.net/y>'), (9, "http://d.com", '<a href="//bad.net/x">'),
        (10, "HTTP://net?x", None),
    ]
    got = {r.page_id: r for r in urlrank.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[1].host, got[1].path, got[1].rule, got[1].verdict] == ["a.example.net", "/en/x", "example.net/en/", "allow"]
    assert [got[2].rule, got[2].verdict] == ["net/", "block"] and got[3].verdict == "block" and got[8].verdict == "block"
    assert [got[4].host, got[4].path, got[4].rule, got[4].verdict] == ["", "", None, "allow"] and got[5].host == ""
    assert got[7].rule is None and got[7].trust > got[7].distrust and got[7].verdict == "allow"
    assert got[9].distrust > 0 and got[9].trust == 0 and got[6].distrust == 0
    assert [got[10].host, got[10].path, got[10].rule] == ["net", "", None]
    assert urlrank.judged(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_mixing_targets_and_copies(spark):
    r = np.random.default_rng(5)
    rows = [(i, " ".join("w" * int(n)), "en", s, 0, "x", 1, 0.5, "c") for i, (n, s) in enumerate(zip(r.integers(0, 60, 900), r.choice(["a", "b", "c", None], 900, p=[0.4, 0.1, 0.45, 0.05])))]
    d = spark.createDataFrame(rows, DOCS)
    got = mixing.copies(d).collect()
    again = mixing.copies(d.repartition(7)).collect()
    assert sorted((x._id, x.n) for x in got) == sorted((x._id, x.n) for x in again)
    size = {s: sum(x.size for x in got if x.source == s) for s in ("a", "b", "c", None)}
    # targets by resharing the excess until no source is above its cap
    weight = dict(zip(("a", "b", "c", None), (3, 1, 2, 3)))
    left, target, full = 1.5 * sum(size.values()), {}, set()
    while True:
        open_ = [s for s in size if s not in full]
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * size[s]
            full.add(s)
            left -= 2 * size[s]
    for s in size:
        own = [x for x in got if x.source == s]
        assert {round(x.target, 6) for x in own} == {round(float(target[s]), 6)} and {x.source_size for x in own} == {size[s]}
        assert all(0 <= x.n <= 2 for x in own)
        assert abs(sum(x.n * x.size for x in own) - target[s]) <= 30
    assert mixing.copies(d.limit(0)).count() == 0
    assert mixing.copies(docs(spark, ["", None])).count() == 2
    assert mixing.mixed(d).count() == sum(x.n for x in got)


def check_packing(rows, length):
    used = {}
    for x in rows:
        used.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in used.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= length
    return len(used)


def test_mixing_takes_rows_without_or_of_one_id_for_themselves(spark):
    rows = [(i % 3 if i % 2 else None, f"w{i} " * (5 + i % 7), "en", f"s{i % 3}", 0, "x", 1, 0.5, "c") for i in range(300)]
    d = spark.createDataFrame(rows, DOCS)
    got, words = mixing.mixed(d).collect(), {}
    for r in got:
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    targets = {r.source: r.target for r in mixing.copies(d).collect()}
    assert all(abs(words.get(s, 0) - t) <= 11 for s, t in targets.items())
    assert len({r.text for r in got if r.doc_id is None}) > 75


def test_packing(spark, odd):
    import public_tokenizers as p
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(p.path("word_bpe_49k.json"))
    got = packing.packed(odd, p.path("word_bpe_49k.json")).collect()
    check_packing(got, 4096)
    for r in odd.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        own = sorted((x for x in got if x.doc_id == r.doc_id), key=lambda x: x.piece)
        assert [(x.start, x.length) for x in own] == [(i, len(ids[i : i + 4096])) for i in range(0, len(ids), 4096)]
        assert [x.ids_crc32 for x in own] == [zlib.crc32(np.array(ids[i : i + 4096], "<u4").tobytes()) for i in range(0, len(ids), 4096)]
    assert packing.packed(odd.limit(0), p.path("word_bpe_49k.json")).count() == 0


def test_packing_ids_equal_the_library_on_documents():
    import duckdb
    import public_tokenizers as p

    ids = packing.WordIds(p.path("word_bpe_49k.json"))
    texts = [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    texts += ["It's 'twas o''clock ''s 's.'t \"'ve", "İ ǅ ﬁ ß ẞ Σς ΟΔΟΣ", "a\x1cb\x85c\xa0d e", "é é ́x", "<|startoftext|>x<|endoftext|>", "١٢٣ ²³¼ 12a34", "​﻿ zero", "🙂🙂 x🙂y"]
    for t in texts:
        assert ids(t) == ids.whole(t), t[:80]


def test_best_fit_is_close_to_the_bound():
    r = np.random.default_rng(6)
    sizes = np.minimum(4096, r.lognormal(6.3, 1.1, 20_000).astype(int) + 1).tolist()
    packer = packing.BestFit(4096, 256)
    fill = {}
    for n in sizes:
        b, o = packer.place(n)
        assert fill.get(b, 0) == o
        fill[b] = o + n
        assert fill[b] <= 4096 and packer.count <= 256
    assert len(fill) <= 1.04 * sum(sizes) / 4096


def test_main_text(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>"</script></head><body><nav><ul><li><a href=/a>Menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
    <article><h1>Head &amp; tail</h1><p>One <b>bold</b>\n  text.<p>Two&nbsp;three<br>four<div class="ad">Buy</div><p><b>Five<br><p>Six words are in this one paragraph</p></article>
    <section class="comments"><h3>Comments</h3><div class="comment"><p>I disagree with all of this</p></div></section><form><label>Name</label><button>Send</button></form><aside class="sidebar"><p>Related things</p></aside><footer>&copy; 2024</footer></body></html>"""
    model = htmltext.trained()
    assert htmltext.extract(page, model) == "Head & tail One bold text. Two three four Five Six words are in this one paragraph"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "just words"), (5, "u", "<p>unclosed <b>words <i>here"), (6, "u", "<script>x"), (7, "u", "<p>" * 3000 + "deep"), (8, "u", "<div>" * 3000 + "deep words")]
    got = htmltext.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id in (2, 3, 6)] == ["", "", ""]


def test_main_text_goes_on_after_graphics_and_unclosed_elements():
    model, words = htmltext.trained(), "several plain words of the article that everybody wants to read today"
    page = lambda x: f"<html><body><article><h1>Title of it</h1><p>{words} {x} and on it goes to the end</p><p>{words}</p></article></body></html>"
    want = lambda x: " ".join(f"Title of it {words} {x} and on it goes to the end {words}".split())
    for x in ('<svg width="1"/>', "<math/>", "<noscript>", "<select>", "<object>", "<canvas>", "<svg>", "<svg><svg/><svg><text>no</text></svg><text>no</text></svg>", "<noscript>no</noscript>"):
        assert htmltext.extract(page(x), model) == want(""), x
    assert htmltext.extract(page("<math><mi>energy</mi> <mo>equals</mo> <mi>mass</mi></math>"), model) == want("energy equals mass")
    assert htmltext.extract(page('<object data="x">fallback words</object>'), model) == want("fallback words")


def test_main_text_marginals_equal_enumeration():
    import itertools
    import math

    model = htmltext.trained()
    nodes = htmltext.flat(htmltext.parse("<div class=content><p>some words here<a href=x>link</a></p><nav>menu</nav></div>"))
    place = {id(x): i for i, x in enumerate(nodes)}
    total, content = 0.0, [0.0] * len(nodes)
    for states in itertools.product((0, 1), repeat=len(nodes)):
        s = 0.0
        for i, x in enumerate(nodes):
            s += sum(model.node.get(f, np.zeros(2))[states[i]] for f in htmltext.features(x))
            if x.parent is not None:
                s += model.edge.get(htmltext._TAG_GROUP.get(x.tag, "other"), model.plain_edge)[states[place[id(x.parent)]], states[i]]
        w = math.exp(s)
        total += w
        for i, v in enumerate(states):
            content[i] += w * v
    assert np.allclose(model.marginals(nodes), np.array(content) / total)


def test_main_text_equals_articles_of_the_test_pages(spark, sf):
    import html
    import re

    def truth(page):
        parts = re.split(r"<(?:/?p|/?h1|br)>", re.search("<article>(.*)</article>", page, re.S)[1])
        return " ".join(t for t in (" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in parts) if t)

    want = {r.page_id: truth(r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert {r.page_id: r.text for r in htmltext.op9_main_text(spark, sf).collect()} == want


def test_nearest_recall_and_scores(spark):
    d = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], float)
    norm = np.sqrt((x * x).sum(1))
    hits = n = 0
    got = {}
    for r in ann.op10_nearest(spark, d).collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == set(ids[ids % 50 == 0].tolist())
    for q, found in got.items():
        i = int(np.nonzero(ids == q)[0][0])
        s = (x @ x[i]) / (norm * norm[i])
        s[i] = -9
        best = sorted(range(len(ids)), key=lambda j: (-s[j], ids[j]))[:5]
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == [1, 2, 3, 4, 5]
        assert all(abs(r.score - s[ids == r.vec_id][0]) < 1e-12 for r in found)
        hits += len({r.vec_id for r in found} & {int(ids[j]) for j in best})
        n += 5
    assert hits / n >= 0.9


def test_nearest_small_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (10, []), (50, [-1.0, 0.0]), (50, [-1.0, 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 50), (0, 5, 50), (50, 1, 3), (50, 2, 0), (50, 3, 1), (50, 4, 2)]
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0
