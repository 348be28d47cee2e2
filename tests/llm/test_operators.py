"""Operators against brute force, and their defined cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidewell.llm import bagminhash, decontam, html_extract, mixing, quality, queries, secret_scan, spans, token_files, toxicity, winnow
from tidewell.llm._text import shingled, span_hashes

WORD = re.compile(r"(?:[^\x00-\x7f]|\w)+")
ODD = [(1, None), (2, ""), (3, " \n "), (4, "one two"), (5, "a b c d e f g h i j"), (5, "a b c d e f g h i j"), (6, "a b c d e f g h i j"), (None, "x y z"), (7, "é" * 50_000 + " word" * 3000), (8, "AKIA" + "B" * 16 + " password: hunter22 ſecret=abcdefgh İ token=abcdef1")]


def frame(spark, rows, more=True):
    rows = [(i, t, "en", "s", None, 7, "x") for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score long, bucket string")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


# secrets


def naive_spans(text):
    out = []
    for k, (p, ok) in enumerate(((secret_scan.ASSIGN, lambda m: len(m[2]) >= 6), (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24))):
        out += [(m.start(), k, m.end()) for m in p.finditer(text) if ok(m)]
    return sorted(out)


def test_secrets_match_plain_patterns(docs, texts):
    for r in secret_scan.find_secrets(docs).collect():
        base = naive_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(secret_scan.joined(base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == k for x in base) for k in range(3))


def test_secrets_random_strings():
    a, rng = secret_scan.automaton(), random.Random(5)
    bits = ["token", "TOKEN", "api_key", "apikey", "passwd", "password", "secret", "AKIA", "0123456789abcdef", "=", ":", " ", '"', "'", "abc", "XYZ09", "İ", "ſ", "K", "/", "."]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(25)))
        assert [x for x in secret_scan.scan(t, a) if x[1] < 3] == naive_spans(t), t


def test_checksummed_tokens():
    a, body = secret_scan.automaton(), "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    good = "ghp_" + body + secret_scan.checksum62(body)
    assert [x[1] for x in secret_scan.scan(f"see {good}.", a)] == [3]
    assert secret_scan.scan(f"see {good[:-1]}{'0' if good[-1] != '0' else '1'}", a) == []
    assert [x[1] for x in secret_scan.scan("npm_" + good[4:], a)] == [4]


# pages


def test_page_extraction():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav>
    <div class="cookie-notice">We use cookies</div><article><h1>Title &amp; more</h1><p>First&nbsp;para <b>bo</b>ld<p>Second one with quite a few words in it.
    <div class="ad">Buy now</div><ul><li>item one<li>item two</ul><p>End.</p></article><aside>Side text</aside><form>Name <input></form>
    <section id="comments"><p>Great post, I read all of it twice and more!</p></section><script>var a="</p>";</script><!-- no --><footer>Foot</footer></body></html>"""
    assert html_extract.extract(page) == "Title & more First para bold Second one with quite a few words in it. item one item two End."
    plain = "<body><div><a href=/>Home</a> | <a href=/a>About</a></div><div><p>Some long article text that goes on for a while, as they do.</p><p>And on.</p></div><div><a href=/b>Terms of use and other links</a></div>"
    assert html_extract.extract(plain) == "Some long article text that goes on for a while, as they do. And on."
    for odd in ("", "<", "<p", "text only", "<script>x", "<!-- x", "<p>a &am", "</p></div>", "<a title='x>y", "<p>" * 3000 + "deep"):
        html_extract.extract(odd)
    assert html_extract.extract("text only") == "text only" and html_extract.extract("<p>a</p>\n<p>b &lt; c") == "a b < c"


def test_pages_of_the_tables(spark, sf):
    import html

    for r in html_extract.extract_pages(spark.read.parquet(f"{sf}/pages.parquet")).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)(?:</article>|<footer|$)", r.html, re.S)[1]
        body = re.sub(r"<[^>]*$", "", body)
        want = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)[^>]*>", " ", body))).split())
        assert r.text == want and r.n_chars == len(want)


def test_weights_come_from_labelled_pages():
    w, names = html_extract.fit_weights()
    assert min(w[k] for k in ("text", "heading", "item", "table")) > 0 > w["tag"] and w["link"] < 0
    assert names["sidebar"] < names["discussion"] < names["side"] < 0 < names["article"] and names.of(["never-met"]) == 0
    few, _ = html_extract.fit_weights(['<div class="article"><p data-label="1">one two three four</p></div><p><a href="/">five</a></p>'])
    assert few["text"] > 0 > few["link"]


def test_best_run_equals_all_runs():
    rng = random.Random(12)
    for _ in range(400):
        values = [(rng.choice([-3.0, -1.0, 0.5, 2.0, 4.0]), rng.choice([0.0, -0.25, -2.5])) for _ in range(rng.randrange(9))]
        every = {(i, j): sum(g for g, _ in values[i:j]) + sum(c for _, c in values[i + 1 : j]) for i in range(len(values)) for j in range(i + 1, len(values) + 1)}
        top = max(every.values(), default=0.0)
        i, j = html_extract.best_run(values)
        assert (i, j) == (0, 0) and top <= 0 or every[i, j] == top > 0


def test_names_are_evidence_not_vetoes():
    p = "<p>Some long article text that goes on for a while, as they do, with more words after it.</p>"
    text = re.sub("<[^>]*>", "", p)
    got = lambda x: html_extract.extract(x).replace(text, "#")
    assert got(f'<nav><a href="/">Home</a></nav><div class="side-effects"><h2>Side effects</h2>{p}{p}</div><footer>Foot</footer>') == "Side effects # #"
    assert got(f'<article>{p}<section class="discussion"><h2>Discussion</h2>{p}</section></article><section class="comments">{p}</section>') == "# Discussion #"
    assert got(f'<article>{p}<p>Buy <span class="advert">BUY NOW</span> it <span style="display:none">no</span>here.</p></article>') == "# Buy it here."
    assert got(f'<article>{p}<p>One <span class="share">two three</p><p>four <i hidden>x</p></article>') == "# One two three four"
    assert got(f'<article>{p}<div class="newsletter-box"><p>Get our letter every day, it is free and short.</p></div>{p}</article><div class="side">{p}</div>') == "# #"
    assert got(f"<body><div>{p}{p}</div><div><p>Page 1 of 3</p></div><div><a href=/>Terms and other links</a></div>") == "# #"
    long = "<article>" + p * 3000 + "</article>"
    assert html_extract.extract(long) == " ".join([text] * 3000)


# decontamination


def words(t):
    return WORD.findall((t or "").lower())


def grams(t, k=5):
    w = words(t)
    return [tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []


def shared(text, item):
    """Shingles of an item, and how many of them a text holds; an item of fewer than five words is one of its own length."""
    w, b = words(text), words(item)
    k = min(5, len(b))
    cut = lambda x: {tuple(x[i : i + k]) for i in range(len(x) - k + 1)} if k else set()
    return len(cut(b)), len(cut(b) & cut(w))


def test_decontamination_matches_exact_containment(spark, docs, texts, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = set()
    items = [(b.item_id, set(grams(b.text))) for b in bench.collect()]
    assert all(len(words(b.text)) >= 5 for b in bench.collect())
    for i, t in texts.items():
        own = set(grams(t))
        want |= {(i, j, len(item & own)) for j, item in items if len(item & own) >= 0.8 * len(item) - 1e-9}
    got = {(r.doc_id, r.item_id, r.shared_shingles) for r in decontam.contaminated(spark, docs, bench).collect()}
    assert got == want and want


def test_decontamination_partial_and_sliced(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 60)))) for i in range(60)]
    items += [(i, " ".join(rng.choices(vocabulary, k=1 + i % 4))) for i in range(60, 72)] + [(72, "What is 2+2?")]
    rows = [(1000, "A long text that asks: what is 2 + 2? And goes on after it.")]
    for i in range(300):
        t = rng.choices(vocabulary, k=rng.randrange(0, 400))
        w = rng.choice(items)[1].split()
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = "zz"
        at = rng.randrange(len(t) + 1)
        rows.append((i, " ".join(t[:at] + w + t[at:])))
    rows += [(1001, None), (1002, items[70][1]), (1002, items[70][1]), (None, items[0][1])]
    want = Counter((i, j, *c, c[1] / c[0]) for i, t in rows for j, b in items for c in [shared(t, b)] if c[1] >= 0.8 * c[0] - 1e-9)
    assert any(x[:2] == (1000, 72) for x in want) and any(x[2] > 5 and x[3] < x[2] for x in want)
    docs, bench = frame(spark, rows), spark.createDataFrame([*items, (900, None), (901, " ,")], "item_id long, text string")
    assert Counter(map(tuple, decontam.contaminated(spark, docs, bench).collect())) == want
    clean = lambda: Counter(r.text for r in decontam.clean_rows(spark, docs, bench, ["doc_id", "text", "lang"]).collect())
    kept = clean()
    assert kept == Counter(t for i, t in rows if not any(shared(t, b)[1] >= 0.8 * shared(t, b)[0] - 1e-9 for _, b in items))
    monkeypatch.setattr(decontam, "SLICE_CHARS", 2000)  # the benchmark stays in tables
    assert Counter(map(tuple, decontam.contaminated(spark, docs, bench).collect())) == want and clean() == kept


# token files


@pytest.fixture(scope="module")
def reference_tokens():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_encoder_cuts_only_where_the_tokenizer_does(reference_tokens):
    encode, rng = token_files.Encoder(queries.tokenizer_path()), random.Random(1)
    bits = [" ", "  ", "\n", " \n", "\n ", "\t", "a", "word", "'s", "'", "9", "12", "é", "ü", ".", "!!", " ", " ", "日本", "<|endoftext|>", "\r\n", "😀", "İ", "\x1c", "\x85"]
    for _ in range(4000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        assert np.frombuffer(encode(t), "<u4").tolist() == reference_tokens(t), repr(t)


def test_token_files_round_trip(spark, sf, texts, reference_tokens):
    start = 0
    got = sorted(queries.op4_token_files(spark, sf).collect())
    assert len(got) == len(texts)
    for r in got:
        ids = [*reference_tokens(texts[r.doc_id]), 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("n", [1, 2, 3, 127, 128, 129, 1000, 5000])
def test_huffman_blocks(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.2, n), 40000).astype(np.int64)
    own, counts = np.unique(ids, return_counts=True)
    book = token_files.Codebook(own, token_files.code_lengths(counts))
    payload, checkpoints = book.encode(ids)
    assert (book.decode(payload, checkpoints, n) == ids).all()
    assert len(payload) == (int(book.bits[ids].sum()) + 7) // 8


def test_code_lengths_are_limited_and_optimal():
    import heapq

    rng = np.random.default_rng(0)
    for n in (2, 3, 10, 300):
        counts = rng.integers(1, 1000, n)
        heap = [int(c) for c in counts]
        heapq.heapify(heap)
        cost = 0
        while len(heap) > 1:
            x = heapq.heappop(heap) + heapq.heappop(heap)
            cost += x
            heapq.heappush(heap, x)
        assert int((token_files.code_lengths(counts) * counts).sum()) == cost
    fib = [1, 1]
    while len(fib) < 40:
        fib.append(fib[-1] + fib[-2])
    lengths = token_files.code_lengths(np.array(fib), 12)
    assert lengths.max() <= 12 and (2.0**-lengths).sum() <= 1


# quality and toxicity


def accuracy(rows, label):
    pairs = [(label[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in label]
    return sum(a == b for a, b in pairs) / len(pairs), len(pairs)


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = queries.op5_quality_classifier(spark, d).collect()
    share, n = accuracy(rows, label)
    assert n > 500 and share > 0.97
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_quality_equals_brute_force(spark, sf, docs, texts):
    """Statistics by plain Python, and every tree walked by itself."""
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert len(model.value) == quality.TREES
    rows = [*texts.values(), "", "One. one one\nTwo, two!\nTwo, two!\nÄé 12 x|y", "a" * 3_000_000]
    x = quality.statistics(pa.array(rows, pa.large_string()))
    assert x.shape == (len(rows), len(quality.FEATURES)) and np.isfinite(x).all()
    for t, own in zip(rows, x, strict=True):
        got, raw, w = dict(zip(quality.FEATURES, own, strict=True)), (t or "").encode(), words(t)
        n, lengths, tally = max(len(raw), 1), [len(v.encode()) for v in w], Counter(w)
        assert np.isclose(got["comma"], sum(chr(b) in ",;:" for b in raw) / n) and np.isclose(got["wide"], sum(b >= 128 for b in raw) / n)
        assert np.isclose(got["log_bytes"], np.log1p(len(raw))) and np.isclose(got["log_words"], np.log1p(len(w)))
        assert np.isclose(got["word_bytes"], np.mean(lengths) if w else 0) and np.isclose(got["word_spread"], np.std(lengths) if w else 0, atol=1e-5)
        assert np.isclose(got["distinct"], len(tally) / max(len(w), 1)) and np.isclose(got["top"], max(tally.values(), default=0) / max(len(w), 1))
        assert np.isclose(got["adjacent"], sum(a == b for a, b in zip(w, w[1:], strict=False)) / max(len(w), 1))
        assert np.isclose(got["repeated_shingles"], 1 - len(set(grams(t))) / len(grams(t)) if w else 0)
    plain = []
    for own in x:
        margin = model.base
        for feature, cut, value in zip(model.feature, model.cut, model.value, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if own[feature[node]] > cut[node] else 1)
            margin += value[node - len(feature)]
        plain.append(1 / (1 + np.exp(-margin)))
    assert np.allclose(model.score(x), plain, atol=1e-12)
    want = dict(zip(texts, plain, strict=False))
    assert all(abs(r.score - want[r.doc_id]) < 1e-12 for r in quality.score_quality(docs, model).collect())


def test_repeated_documents_are_learnt_alike(spark):
    rows = [(i, t) for i in range(60) for t in (f"good text number {i}, it is fine. " * 3, "JUNK||| " * (i + 1))]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    models = [quality.fit_quality(frame(spark, r).repartition(n), labels) for r, n in ((rows, 1), (rows[::-1], 7))]
    assert all(np.array_equal(getattr(models[0], k), getattr(models[1], k)) for k in ("feature", "cut", "value"))


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    english = {r.doc_id for r in spark.read.parquet(f"{d}/documents.parquet").where("lang = 'en'").collect()}
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect() if r.doc_id in english}
    rows = queries.op10_toxicity(spark, d).collect()
    share, n = accuracy(rows, label)
    assert n > 500 and share > 0.97
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_toxicity_on_held_out_rows_of_every_language(spark):
    d = "/root/testdata/sf0.1"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in queries.op10_toxicity(spark, d).collect() if r.held_out and r.doc_id in label]
    for x in ("en", "de", "fr", "es"):
        own = [(label[r.doc_id], r.predicted) for r in rows if lang[r.doc_id] == x]
        toxic = [p for t, p in own if t]
        assert len(toxic) >= 10 and sum(toxic) / len(toxic) > 0.8, x
        assert sum(t == p for t, p in own) / len(own) > 0.94, x


def test_toxicity_equals_brute_force(spark):
    """Scores from every example by plain dictionaries, weights from all documents, and calibration by bin."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    index = toxicity.fit_toxicity(docs, labels)
    assert len(index.vocabulary) >= 3 and index.labels.sum() > 5
    word = re.compile(r"\w+")
    texts = {r.doc_id: word.findall((r.text or "").lower()) for r in docs.collect()}
    own = {i: [[t for t in toxicity.terms_of(w) if t in index.vocabulary] for w in ws] for i, ws in texts.items()}
    for t, k in index.vocabulary.items():
        assert np.isclose(index.idf[k], np.log(1 + len(texts) / sum(any(t in x for x in ws) for ws in own.values())))

    def vector(i):
        tf = Counter(t for x in own[i] for t in x)
        w = {t: (1 + np.log(n)) * index.idf[index.vocabulary[t]] for t, n in tf.items()}
        length = sum(x * x for x in w.values()) + len({a for a, x in zip(texts[i], own[i], strict=True) if not x})
        return {t: x / np.sqrt(length) for t, x in w.items()}

    examples = [(i, y, vector(i)) for i, y in zip(index.ids.tolist(), index.labels.tolist(), strict=True)]
    scored = toxicity.score_toxicity(docs, index)
    for r in scored.collect():
        w = vector(r.doc_id)
        near = sorted(((-round(s, 12), i, y) for i, y, v in examples for s in [sum(x * v.get(t, 0.0) for t, x in w.items())] if s > 0))[: toxicity.NEAREST]
        a = sum(s * s for s, _, _ in near)
        want = (sum(s * s * y for s, _, y in near) + toxicity.PULL * index.base) / (a + toxicity.PULL)
        assert abs(r.score - want) < 1e-9, r.doc_id
    bins = toxicity.reliability(scored, labels).collect()
    assert sum(r.n for r in bins) == labels.where("toxic is not null").count() and all(r.bin <= r.mean_score * 10 + 1e-9 < r.bin + 1 + 1e-9 for r in bins)
    assert all(r.share > 0.6 for r in bins if r.bin >= 7) and all(r.share < 0.2 for r in bins if r.bin <= 1)


def test_block_max_search_is_exact():
    rng = np.random.default_rng(2)
    terms, n = 60, 700
    idf = rng.uniform(1, 3, terms)
    vectors = []
    for _ in range(n):
        at = np.sort(rng.choice(terms, rng.integers(0, 8), replace=False))
        w = rng.uniform(0.5, 2, len(at))
        vectors.append((at, w / np.sqrt((w**2).sum()) if len(at) else w))
    index = toxicity.BlockMaxIndex({str(i): i for i in range(terms)}, idf, np.arange(n), rng.integers(0, 2, n), vectors, 0.1)
    dense = np.zeros((n, terms))
    for i, (at, w) in enumerate(vectors):
        dense[i, at] = w
    for _ in range(200):
        at = np.sort(rng.choice(terms, rng.integers(1, 6), replace=False))
        w = rng.uniform(0.5, 2, len(at))
        rows, similarity = index.nearest(at, w)
        want = dense[:, at] @ w
        order = np.lexsort((np.arange(n), -np.round(want, 12)))[:16]
        order = order[want[order] > 0]
        assert index.ids[rows].tolist() == order.tolist() and np.allclose(similarity, want[order])


# sentence spans


def pieces(sentence, long=30, reach=8):
    """Cut before each word whose hash is the least of its neighbourhood, the first of equal ones."""
    raw = sentence.encode()
    at = [(len(sentence[: m.start()].encode()), len(sentence[: m.end()].encode()), m.start()) for m in WORD.finditer(sentence)]
    h = span_hashes(np.frombuffer(raw, np.uint8), np.array([x[0] for x in at], np.int64), np.array([x[1] for x in at], np.int64)).tolist()
    own = [i for i in range(1, len(h)) if all(h[j] > h[i] for j in range(max(0, i - reach), i)) and all(h[j] >= h[i] for j in range(i + 1, min(len(h), i + reach + 1)))]
    cuts = [0, *(at[i][2] for i in own if len(at) > long), len(sentence)]
    return [sentence[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def naive_dedup(rows, sentences=3, least=0):
    cut = {}
    for i, t in rows:
        cut[i] = [p for x in re.findall(r".+?(?:(?<=[.!?])[ \t\r\n\v\f]+|[ \t\r\v\f]*\n[ \t\r\n\v\f]*|\Z)", t, re.S) if x for p in pieces(x)]
    spans_of, first = {}, {}
    for i, ss in sorted(cut.items()):
        for a in range(len(ss)):
            for b in range(a + sentences, len(ss) + 1):
                w = WORD.findall(" ".join(ss[a:b]))
                if len(w) >= least:
                    spans_of[i, a] = b, tuple(w)
                    first.setdefault(tuple(w), (i, a))
                    break
    out = {}
    for i, ss in cut.items():
        drop = set()
        for a in range(len(ss)):
            if (i, a) in spans_of and first[spans_of[i, a][1]] != (i, a):
                drop |= set(range(a, spans_of[i, a][0]))
        out[i] = "".join(s for n, s in enumerate(ss) if n not in drop), len(drop), len(ss)
    return out


@pytest.mark.parametrize(("sentences", "least"), [(3, 0), (2, 25)])
def test_span_dedup_matches_brute_force(docs, texts, sentences, least):
    want = naive_dedup(texts.items(), sentences, least)
    got = spans.dedup_spans(docs, sentences, least).collect()
    assert len(got) == len(texts) and sum(r.n_removed for r in got) > 0
    for r in got:
        assert (r.text, r.n_removed, r.n_sentences) == want[r.doc_id], r.doc_id
        left, at = texts[r.doc_id], 0
        for s in reversed([x.split(":") for x in r.removed.split(",") if x]):
            left = left[: int(s[0])] + left[int(s[1]) :]
        assert left == r.text


def repeated_runs(rows, n=51):
    """doc_ids that hold a run of n words which also stands in a document of less doc_id."""
    seen, out = {}, set()
    for i, t in sorted(rows):
        w = WORD.findall(t)
        for a in range(len(w) - n + 1):
            if seen.setdefault(tuple(w[a : a + n]), i) != i:
                out.add(i)
    return out


def test_spans_of_few_words_and_of_long_sentences(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    passage = " ".join(word() for _ in range(80))
    rows = [(1, "It rained all day. Nobody came out. We read books there. Then one left."), (2, "He wrote this: It rained all day. Nobody came out. We read books there. Good."), (3, "It rained. Nobody came out. We read books there.")]
    rows += [(n, " ".join([*(word() for _ in range(11 * n)), passage, *(word() for _ in range(20))])) for n in (4, 5)]
    got = {r.doc_id: r for r in spans.dedup_spans(frame(spark, rows)).collect()}
    assert all(got[i].text == dict(rows)[i] for i in (1, 3, 4))
    assert got[2].text == rows[1][1]  # "He wrote this: It rained all day" is another sentence
    assert len(got[5].text.split()) < 11 * 5 + 80 + 20 - 30  # most of the passage, whatever stands before it
    rows[1] = (2, "He wrote. It rained all day. Nobody came out. We read books there. Good.")
    got = {r.doc_id: r for r in spans.dedup_spans(frame(spark, rows)).collect()}
    assert got[2].text == "He wrote. Good." and got[2].removed == f"10:{rows[1][1].index('Good')}"


def test_windowed_spans_leave_no_repeated_run(spark, docs, texts):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    passage = " ".join(word() for _ in range(51))
    # at other offsets of a sentence without end, across sentences of 30 words, and with sentences that end elsewhere
    rows = [(n, " ".join([*(word() for _ in range(7 * n + 3)), passage, *(word() for _ in range(40))])) for n in range(6)]
    rows += [(6, passage), (7, "One. " + passage.replace(" ", ". ", 30) + "."), (8, "ä" + passage + " é" + passage), (9, " ".join(word() for _ in range(300)))]
    got = {r.doc_id: r for r in spans.dedup_spans(frame(spark, rows), min_words=40, run_words=spans.RUN_WORDS, window=spans.WINDOW).collect()}
    assert len(repeated_runs(rows)) >= 6 and not repeated_runs([(i, r.text) for i, r in got.items()])
    assert got[0].text == rows[0][1] and got[9].text == rows[9][1] and got[6].n_removed > 0
    whole = spans.dedup_spans(docs, min_words=40, run_words=spans.RUN_WORDS, window=spans.WINDOW).collect()
    assert not repeated_runs([(r.doc_id, r.text) for r in whole])
    for given, r in [*((dict(rows), r) for r in got.values()), *((texts, r) for r in whole)]:
        left = given[r.doc_id]
        for s in reversed([x.split(":") for x in r.removed.split(",") if x]):
            left = left[: int(s[0])] + left[int(s[1]) :]
        assert left == r.text


# fingerprints


def test_fingerprints(docs, texts):
    got = {r.doc_id: r for r in winnow.fingerprints(docs).collect()}
    ids = sorted(texts, reverse=True)
    assert sorted(got) == sorted(texts)
    sets = {i: {x.split("@")[0] for x in got[i].fingerprint.split(",") if x} for i in ids}
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        t, n = texts[i], len(texts[i])
        edited = t[: n - n // 2] + texts[j][: n // 2]
        r = got[i]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own = {x.split("@")[0] for x in r.edited_fingerprint.split(",") if x}
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        assert abs(r.near_edited - like(sets[i], own)) < 1e-12 and abs(r.near_next - like(sets[i], sets[j])) < 1e-12
    by_text = defaultdict(set)
    for i in ids:
        by_text[texts[i]].add(got[i].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


def test_winnowing_selects_rightmost_minima(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices("ab", k=rng.randrange(0, 90)))) for i in range(60)]
    df = winnow.with_fingerprint(frame(spark, rows), "text", "packed").selectExpr("doc_id", "packed", "text")
    full, gram, window = (1 << 31) - 1, winnow.GRAM, winnow.WINDOW
    every = {}
    for r in df.collect():
        n = max(len(r.text.split()) - gram + 1, 1 if r.text.split() else 0)
        got = [(x >> 31, full - (x & full)) for x in r.packed]
        assert all(0 <= p < n for _, p in got) and [p for _, p in got] == sorted(p for _, p in got)
        for h, p in got:  # equal grams have equal hashes
            assert every.setdefault(tuple(r.text.split()[p : p + gram]), h) == h
        seen = [p for _, p in got]
        known = {g: h for g, h in every.items()}
        for s in range(max(n - window + 1, 1 if n else 0)):
            inside = [p for p in seen if s <= p < s + window]
            assert inside  # every window holds a selected position
            own = [tuple(r.text.split()[p : p + gram]) for p in range(s, min(s + window, n))]
            best = min(known[g] for g in own if g in known)
            assert s + max(i for i, g in enumerate(own) if known.get(g) == best) in seen


def test_fingerprints_share_what_texts_share(spark):
    """Six common words give a common hash, wherever they stand; buckets by a search in two steps."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    rows = []
    for i in range(0, 80, 2):
        passage = [word() for _ in range(winnow.GRAM + winnow.WINDOW - 1)]
        rows += [(i + j, " ".join([*(word() for _ in range(rng.randrange(30))), *passage, *(word() for _ in range(rng.randrange(30)))])) for j in (0, 1)]
    got = {r.doc_id: {x >> 31 for x in r.packed} for r in winnow.with_fingerprint(frame(spark, rows), "text", "packed").collect()}
    assert all(got[i] & got[i + 1] for i in range(0, 80, 2)) and sum(bool(got[i] & got[i + 3]) for i in range(0, 76, 2)) == 0
    cuts = sorted(rng.sample(range(1000), 200))
    for r in spark.range(1000).select("id", winnow.bucket_of(winnow.F.col("id"), cuts).alias("b")).collect():
        assert r.b == sum(c <= r.id for c in cuts)
    some = frame(spark, rows)
    plain = lambda: {r.doc_id: (r.near_edited, r.near_next, r.edited_sha256) for r in winnow.fingerprints(some).collect()}
    want = plain()
    rows_, window_ = winnow.with_next(some, 70)
    after = {r.doc_id: r.a for r in rows_.withColumn("a", winnow.F.lead("text").over(window_)).where("guard = 0").collect()}
    ids = sorted(dict(rows), reverse=True)
    assert after == {i: dict(rows)[j] for i, j in zip(ids, ids[1:] + ids[:1], strict=True)} and len(want) == len(ids)


# near duplicates


def weighted(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if both else 0.0


def naive_classes(rows, threshold=0.8):
    bags = {i: Counter(grams(t)) for i, t in rows}
    parent = {i: i for i in bags}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(set)
    for i, b in bags.items():
        for g in b:
            holders[g].add(i)
    for i, b in bags.items():
        for j in {j for g in b for j in holders[g] if j > i}:
            if weighted(b, bags[j]) >= threshold - 1e-12:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in bags}


def test_near_duplicates_match_brute_force(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) < 8000")
    rows = [(r.doc_id, r.text) for r in d.collect()]
    want = naive_classes(rows)
    got = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(d).collect()}
    assert got == want and len(set(want.values())) < len(want)


def test_near_duplicate_chains_and_spread_groups(spark):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(900)]
    rows, base = [], rng.choices(vocabulary, k=200)
    for i in range(150):  # copies edited to very different degrees, some of them copies of copies
        w = list(base if i % 3 else rows[-1][1].split() if rows else base)
        for _ in range(rng.randrange(0, 14)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(rng.choices(vocabulary, k=100))) for i in range(50)] + [(2000 + i, "go " * (300 + i)) for i in range(5)]
    want = naive_classes(rows)
    got = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == want and 3 < len(set(want.values())) < 205


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    n, size = 60, 120
    a = rng.integers(1, 2**63, (n, size)).astype(np.uint64)
    wa, wb = rng.integers(1, 9, (n, size)), rng.integers(0, 9, (n, size))
    share = np.minimum(wa, wb).sum(1) / np.maximum(wa, wb).sum(1)
    doc = np.repeat(np.arange(n), size)
    keep = wb.reshape(-1) > 0
    sa = bagminhash.signatures(doc, a.reshape(-1), wa.reshape(-1).astype(float), n, 256)
    sb = bagminhash.signatures(doc[keep], a.reshape(-1)[keep], wb.reshape(-1)[keep].astype(float), n, 256)
    got = (sa == sb).mean(1)
    assert abs((got - share).mean()) < 0.012 and np.abs(got - share).max() < 0.15


# mixing


def test_water_filling_goes_to_siblings_first():
    leaves = {("a", "x"): 10, ("a", "y"): 1000, ("b", "z"): 1000}
    got = mixing.budgets(leaves, 400, lambda p: 1.0)
    assert got == {("a", "x"): 10, ("a", "y"): 190, ("b", "z"): 200}
    got = mixing.budgets(leaves, 1500, lambda p: {("a",): 3.0}.get(p, 1.0))
    assert got == {("a", "x"): 10, ("a", "y"): 1000, ("b", "z"): 490}
    assert mixing.budgets(leaves, 10**9, lambda p: 1.0, 2) == {k: 2 * v for k, v in leaves.items()}
    assert sum(mixing.budgets({("a",): 7, ("b",): 7, ("c",): 7}, 10, lambda p: 1.0).values()) == 10


def test_mixing_takes_prefixes_of_seeded_epochs(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(mixing, "SLOT_ROWS", 2)
    d = queries.with_domain(docs)
    got = mixing.mix(d, queries.LEVELS, budget=0.5, weight=queries.target_weight, max_epochs=2, seed=3).collect()
    place = d.selectExpr("doc_id", "domain", "lang", "source", "text", "hex(xxhash64(text)) h").collect()
    leaves = defaultdict(list)
    for r in place:
        leaves[r.domain, r.lang, r.source].append((r.doc_id, len(r.text.split()), r.h))
    total = int(0.5 * sum(n for own in leaves.values() for _, n, _ in own))
    given = mixing.budgets({k: sum(n for _, n, _ in own) for k, own in leaves.items()}, total, queries.target_weight, 2)
    want = Counter()
    for k, own in leaves.items():
        left = given[k]
        for e in range(2):
            for i, n, _ in sorted(own, key=lambda x: hashlib.md5(f"3/{e}/{x[0]}/{x[2]}".encode()).hexdigest()):
                if n > left:
                    left = -1
                    break
                left -= n
                want[i, e] += 1
            if left < 0:
                break
    assert Counter((r.doc_id, r.mix_epoch) for r in got) == want


def test_mixing_with_odd_texts_and_clashing_columns(spark):
    odd = ["\n", "\nfoo", "a\n", " \t x  y\u000bz ", "", None, "one two"]
    d = spark.createDataFrame([(i, t, 3, "s") for i, t in enumerate(odd)], "doc_id long, text string, n long, source string")
    got = {r.doc_id: r.t for r in d.select("doc_id", mixing.word_tokens(d.text).alias("t")).collect()}
    assert [got[i] for i in range(len(odd))] == [len((t or "").split()) for t in odd]
    names = ["slots", "rest", "cut", "mix_epoch", "mix_slot", "mix_place", "mix_path", "c0", "domain", "Mix_Budget", "a.b"]
    more = d.selectExpr("doc_id", "text", "n", "n as source", "'en' as lang", *[f"n as `{c}`" for c in names])
    mixed = mixing.mix(queries.with_domain(more), queries.LEVELS, 1.0)
    assert sorted(mixed.columns) == sorted([*[c for c in more.columns if c not in ("mix_epoch", "Mix_Budget")], *mixing.OWN])
    rows = mixed.collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(odd))) and all(r.slots == r.cut == r["c0"] == r.mix_path == 3 for r in rows)


# defined cases


def test_defined_cases(spark, sf):
    d, bench = frame(spark, ODD), spark.createDataFrame([(1, None), (2, ""), (3, "a b c d e f g h i j"), (None, "one two")], "item_id long, text string")
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (5, None, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    n = len(ODD)
    assert secret_scan.find_secrets(d).count() == n
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(spark, d, bench).collect()} == {(5, 3), (6, 3), (4, None)}
    near = {(r.doc_id, r.class_id) for r in bagminhash.near_duplicates(d).collect()}
    assert near == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 5), (None, None), (7, 7), (8, 8)}
    assert bagminhash.near_duplicates(d).count() == n
    assert spans.dedup_spans(d).count() == n
    fp = winnow.fingerprints(d).collect()
    assert len(fp) == n and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in fp)
    assert mixing.mix(d.withColumn("domain", d.lang), queries.LEVELS, 1.0).count() == n
    model = quality.fit_quality(d, labels)
    assert quality.score_quality(d, model).count() == n
    assert toxicity.score_toxicity(d, toxicity.fit_toxicity(d, labels)).count() == n
    out = token_files.Scratch(spark, "t")
    token_files.write_tokens(d, queries.tokenizer_path(), out)
    assert token_files.read_tokens(spark, out.root).count() == n
    pages = spark.createDataFrame([(1, None, None), (None, "u", "<p>hi"), (1, None, "")], "page_id long, url string, html string")
    assert sorted(r.text for r in html_extract.extract_pages(pages).collect()) == ["", "", "hi"]


def test_empty_tables(spark):
    d, bench = frame(spark, ODD).where("1 = 0"), spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert secret_scan.find_secrets(d).count() == 0
    assert decontam.contaminated(spark, d, bench).count() == 0
    assert decontam.contaminated(spark, frame(spark, ODD), bench).count() == 0
    assert bagminhash.near_duplicates(d).count() == 0
    assert spans.dedup_spans(d).count() == 0
    assert winnow.fingerprints(d).count() == 0
    assert mixing.mix(d.withColumn("domain", d.lang), queries.LEVELS, 1.0).count() == 0
    assert quality.score_quality(d, quality.fit_quality(d, labels)).count() == 0
    assert toxicity.score_toxicity(d, toxicity.fit_toxicity(d, labels)).count() == 0
    out = token_files.Scratch(spark, "t")
    token_files.write_tokens(d, queries.tokenizer_path(), out)
    assert token_files.read_tokens(spark, out.root).count() == 0
    assert html_extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_shingles_equal_plain_ones():
    rng = random.Random(8)
    ts = ["".join(rng.choice(["a", "bé", "C", " ", ", ", "\n", "x_1", "日本"]) for _ in range(rng.randrange(60))) for _ in range(200)]
    ids = {}
    for row, h, begin, n in shingled(pa.array(ts)):
        for d in range(len(n)):
            want = grams(ts[row + d])
            assert n[d] == len(words(ts[row + d])) and begin[d + 1] - begin[d] == len(want)
            for x, g in zip(h[begin[d] : begin[d + 1]].tolist(), want, strict=True):
                assert ids.setdefault(g, x) == x
    assert len(set(ids.values())) == len(ids)


def test_pipeline_keeps_columns_and_ends_in_tokens(spark, sf):
    import corpus_pipeline as p

    d = spark.read.parquet(f"{sf}/documents.parquet")
    out = token_files.Scratch(spark, "p")
    for i, (name, stage) in enumerate(p.STAGES):
        before, d = d, out.table(str(i), stage(spark, d, sf))
        if i < 4:
            assert d.columns == p.COLUMNS and 0 < d.count() <= before.count()
        if i == 1:
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert {r.doc_id for r in d.collect()} == {i for i, c in naive_classes(rows).items() if i == c}
        if i == 2:
            assert decontam.contaminated(spark, d, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
    assert d.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(p.run(spark, sf).collect()) == sorted(d.collect())


def test_pipeline_stages_in_defined_cases(spark, sf):
    import corpus_pipeline as p

    odd = frame(spark, ODD).select("doc_id", "text", "lang", "source", "n_chars", "score", "bucket").withColumn("label", odd_label())
    for d, n in ((odd, len(ODD)), (odd.where("1 = 0"), 0)):
        for name, stage in p.STAGES[1:4]:
            got = stage(spark, d, sf)
            assert got.columns == p.COLUMNS and got.count() <= n
        assert p.quality_stage(spark, d, sf).columns == p.COLUMNS
        assert p.token_stage(spark, d, sf).count() == n
    a, b = "a b c d e f g h i j k l", "some other text that has more than five words"
    shared = p.near_dedup_stage(spark, frame(spark, [(1, a), (3, a), (3, b), (7, b), (8, None), (8, None), (None, a)]), sf).collect()
    assert sorted((str(r.doc_id), r.text) for r in shared) == sorted([("1", a), ("3", b), ("8", None), ("None", a)], key=str)
    kept = [(r.doc_id, r.text) for r in p.near_dedup_stage(spark, odd, sf).collect()]
    assert sorted(kept, key=str) == sorted([x for i, x in enumerate(ODD) if i not in (5, 6)], key=str)
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    mixed = frame(spark, [(None, f"before it {item} after it"), (1, item), (1, "a clean text of five words"), (2, None)])
    assert sorted((r.doc_id, r.text) for r in p.decontamination_stage(spark, mixed, sf).collect()) == [(1, "a clean text of five words"), (2, None)]


def odd_label():
    from pyspark.sql import functions as F

    return F.lit("x")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_their_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = queries.queries()[name](spark, sf).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert sorted(got[cols].round(9).itertuples(index=False, name=None)) == sorted(want[cols].round(9).itertuples(index=False, name=None))


def test_decontamination_sql_seeks_short_items(spark, tmp_path):
    import duckdb

    docs = frame(spark, [(1, "well, what is 2 + 2? let me see"), (2, "what is it"), (3, None), (4, "one two three four five six"), (5, "2")])
    bench = spark.createDataFrame([(1, "What is 2+2?"), (2, "two three"), (3, ""), (4, "2"), (5, "two three four five six")], "item_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    bench.coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = {tuple(r)[:2] for r in queries.op3_decontamination(spark, str(tmp_path)).collect()}
    assert got == {(1, 1), (1, 4), (4, 2), (4, 5), (5, 4)}
    assert got == {r[:2] for r in con.execute(queries.oracle_sql()["op3_decontamination"]).fetchall()}


def test_tasks_give_freed_memory_back(monkeypatch):
    """Workers stay between tasks, and what they hold counts with their executor."""
    import pyarrow as pa

    from tidewell.llm import bagminhash, quality, token_files
    from tidewell.llm.queries import tokenizer_path

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([0]), pa.array(["a b c d e f"])], ["a", "b", "text"])
    called = []
    for module in (bagminhash, quality, token_files):
        monkeypatch.setattr(module, "trim", lambda name=module.__name__: called.append(name))
    list(bagminhash._sign(iter([batch])))
    list(quality._features(iter([pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(0), batch.column(2)], list("abcd"))])))
    list(token_files._tokenise(tokenizer_path())(iter([batch])))
    assert len(called) == 3


def test_encoder_asks_the_model_once_for_a_word_and_its_stops(reference_tokens):
    encode, asked = token_files.Encoder(queries.tokenizer_path()), []
    words = encode.tail.words
    own = words.tokenize
    words.tokenize = lambda word: asked.append(word) or own(word)
    for t in ["x Abcdxyz. Abcdxyz, Abcdxyz", "x Abcdxyz.\nHijkxyz, Abcdxyz.\nHijkxyz, Abcdxyz.\nHijkxyz,"]:
        assert np.frombuffer(encode(t), "<u4").tolist() == reference_tokens(t)
    assert sum("Abcdxyz" in x for x in asked) == 1 and sum("Hijkxyz" in x for x in asked) == 1
