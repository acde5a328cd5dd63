"""Each operator against a plain version of its definition, on the defined cases."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hunkline.llm import annsearch, bpe, decontaminate, kneserney, langid, linededup, minhash, pages, store, toxicity
from hunkline.llm.queries import tokenizer
from tests.llm.cases import SCHEMA, documents, prose


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def crc(i, n):
    return None if i is None else zlib.crc32(str(i).encode()) % n


# --- language id ---------------------------------------------------------

def test_language_profiles_and_distance(spark, docs, empty):
    rows = [(i, ("the of and " * 5 + prose(i)) if i % 2 else ("der die und " * 5 + prose(i)), "en" if i % 2 else "de") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = langid.learn_and_predict(df).collect()
    assert all(r.lang_pred == ("en" if r.doc_id % 2 else "de") for r in got)
    assert all(r.held_out == (crc(r.doc_id, 3) == 1) for r in got)
    counts = Counter()
    for i, t, lang in rows:
        if lang == "en" and crc(i, 3) != 1:
            line = " " + t + " "
            counts.update(c for c in line if c != " ")
            counts.update(line[k:k + 2] for k in range(len(line) - 1))
            counts.update(line[k:k + 3] for k in range(len(line) - 2) if line[k + 1] != " ")
    code = {g: sum((1 if c == " " else ord(c)) << 21 * (len(g) - 1 - k) for k, c in enumerate(g)) for g in counts}
    want = [code[g] for g in sorted(counts, key=lambda g: (-counts[g], code[g]))[:langid.PROFILE]]
    assert langid.learn(df.filter((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3) != 1))["en"] == want
    edge = langid.learn_and_predict(docs).collect()
    assert len(edge) == docs.count() and all(0 <= r.score <= 1 for r in edge)
    assert {r.lang_pred for r in edge if r.doc_id in (5, 6, 7)} == {"und"}
    assert all(r.held_out for r in edge if r.doc_id is None)
    assert langid.learn_and_predict(empty).count() == 0


def test_ngrams_of_long_texts_do_not_depend_on_pieces(monkeypatch):
    text = prose(5, 400) + "x" * 300
    k, c = langid.ngrams(text)
    monkeypatch.setattr(langid, "_PIECE", 50)
    k2, c2 = langid.ngrams(text)
    assert k.tolist() == k2.tolist() and c.tolist() == c2.tolist()


# --- line dedup ----------------------------------------------------------

def plain_line_dedup(rows):
    """rows: distinct (id, text), in the order of (id, text hash)."""
    seen, gone = set(), defaultdict(set)
    for key, text in rows:
        content = [(i, x.strip(" \t\r\f\x0b")) for i, x in enumerate((text or "").split("\n"))]
        content = [c for c in content if c[1]]
        for a, b, c in zip(content, content[1:], content[2:]):
            window = (a[1], b[1], c[1])
            if window in seen:
                gone[key].update(range(a[0], c[0] + 1))
            seen.add(window)
    return {key: (None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone[key]), len(gone[key]))
            for key, text in rows}


def test_line_dedup(spark, docs, empty):
    lines = [prose(i, 4) for i in range(12)]
    rows = [(i, "\n".join(t)) for i, t in enumerate([
        lines[:6], lines[:6], lines[3:9], [*lines[:3], "", *lines[3:5]], [*lines[:2], "new", lines[2]], lines[:2], [],
        ["a", "b", "c", "a", "b", "c", "a"], [lines[0], "", " ", lines[1], "\t", lines[2] + "  "]])] + [(9, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: (r.text, r.n_removed) for r in linededup.dedup_lines(df).collect()}
    assert got == plain_line_dedup(rows)
    out = linededup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"] and out.count() == docs.count()
    assert all(r.row in ("r", None) and r.text is None for r in out.filter("doc_id = 6").collect())
    assert linededup.dedup_lines(empty).count() == 0
    assert linededup.dedup_lines(df.withColumn("n_lines", F.lit("x"))).columns == ["doc_id", "text", "n_lines", "n_removed"]


# --- near duplicates -----------------------------------------------------

def test_components_with_hot_keys(spark, monkeypatch):
    """A star and a chain, with every key hot and with none."""
    links = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(12)] + [(500, 600), (7, 300), (300, 301)]
    want = {i: 0 for i in [*range(60), 300, 301]} | {100 + i: 100 for i in range(13)} | {500: 500, 600: 500}
    df = spark.createDataFrame(links, "a bigint, b bigint")
    for hot in (1, 10, 1000):
        monkeypatch.setattr(minhash, "HOT_ROWS", hot)
        assert {r.node: r.label for r in minhash.components(df).collect()} == want


def plain_components(rows):
    def shingles(t):
        w = words(t)
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_near_duplicates_against_all_pairs(spark, docs, empty):
    import random

    rng, rows = random.Random(4), []
    for g in range(25):  # groups with more and fewer changes, also chains
        own = prose(1000 + g, 80).split()
        for _ in range(rng.choice([1, 2, 3, 12])):
            rows.append((len(rows), " ".join(own)))
            for _ in range(rng.choice([1, 2, 3])):
                own[rng.randrange(len(own))] = f"z{rng.random()}"
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()}
    assert got == plain_components(rows)
    out = minhash.near_duplicates(docs).collect()
    assert len(out) == docs.count()
    want = plain_components([(r[0], r[1]) for r in documents() if r[0] is not None])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out if r.doc_id is not None} == want
    assert all(r.kept and r.component_id is None for r in out if r.doc_id is None)
    assert minhash.near_duplicates(empty).count() == 0


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    own = prose(7, 100).split()
    rows = []
    for i in range(40):
        t = list(own)
        for k in range(3):
            t[(i * 7 + k * 31) % 100] = f"q{i}-{k}"
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()} == plain_components(rows)


def test_compare_all_equals_pairwise():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(1, 1 << 60, 200).astype(np.uint64))
    sets = {i: np.unique(np.concatenate([rng.choice(base, 150, replace=False), rng.integers(1, 1 << 60, rng.integers(0, 30)).astype(np.uint64)]))
            for i in range(30)}
    nodes = np.arange(30)
    links = minhash.compare_all(nodes, nodes, sets)
    assert all(minhash.linked(sets[a], sets[b]) for a, b in links)

    def groups(pairs):
        label = list(range(30))
        for _ in range(30):
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        return label

    assert groups(links) == groups([(a, b) for a in range(30) for b in range(a) if minhash.linked(sets[a], sets[b])])


# --- language model ------------------------------------------------------

def plain_kneser_ney(train, texts):
    end, start = object(), object()
    uni, bi = Counter(), Counter()
    for t in train:
        w = words(t)
        uni.update([*w, end])
        bi.update(zip([start, *w], [*w, end]))
    n, v = sum(uni.values()), len(uni)
    after, before = defaultdict(list), Counter()
    for (a, b), c in bi.items():
        after[a].append(c)
        before[b] += 1
    d = kneserney.discounts([sum(c == i for c in bi.values()) for i in (1, 2, 3, 4)])
    dl = kneserney.discounts([sum(c == i for c in before.values()) for i in (1, 2, 3, 4)])
    types = len(bi)
    cut = lambda c, d: 0 if not c else d[min(c, 3) - 1]
    mass = sum(cut(c, dl) for c in before.values()) / types
    low = lambda b: max(before[b] - cut(before[b], dl), 0) / types + mass / (v + 1)

    def p(a, b):
        if not after.get(a):
            return low(b)
        c, total = bi[a, b], sum(after[a])
        return max(c - cut(c, d), 0) / total + sum(cut(x, d) for x in after[a]) / total * low(b)

    assert abs(sum(p(start, b) for b in uni) + p(start, object()) - 1) < 1e-9
    out = []
    for t in texts:
        w = words(t)
        out.append((len(w) + 1, sum(uni[x] > 0 for x in [*w, end]), n,
                    sum(math.log10((uni[x] + 0.1) / (n + 0.1 * (v + 1))) for x in [*w, end]),
                    sum(math.log10(p(a, b)) for a, b in zip([start, *w], [*w, end]))))
    return out


def test_kneser_ney_against_counters(spark, docs, empty):
    rows = [(i, " ".join(prose(i % 7, 40).split()[: 10 + i % 30]) + " The end of") for i in range(50)] + [(50, None), (51, ""), (52, "new words")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = plain_kneser_ney([t for i, t in rows if crc(i, 10) != 0], [t for _, t in rows])
    got = {r.doc_id: r for r in kneserney.train_and_score(df).collect()}
    for (i, _), (n, known, total, base, score) in zip(rows, want):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, crc(i, 10) == 0)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)
    hops = kneserney.score(df, kneserney.train(df.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0), two_hops=1)).collect()
    assert {r.doc_id: r.score for r in hops} == {i: r.score for i, r in got.items()}
    edge = kneserney.train_and_score(docs).collect()
    assert len(edge) == docs.count() and all(math.isfinite(r.score) for r in edge)
    assert all(r.held_out for r in edge if r.doc_id is None)
    assert kneserney.train_and_score(empty).count() == 0
    untrained = kneserney.score(df, kneserney.train(empty)).collect()
    assert all(r.score == 0 and r.train_tokens == 0 for r in untrained)


def test_stores_of_small_ids_spread_over_shards(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(store, "SHARD_KEYS", 100)
    ids = spark.range(0, 20_000, 2).union(spark.range(-4, 4, 2)).union(spark.createDataFrame([(None,)], "id bigint"))
    known = store.save_keys(ids, str(tmp_path))
    sizes = np.diff(known.base)
    assert len(sizes) == 128 and sizes.sum() == 10_002 and sizes.max() < 200
    asked = np.sort(np.arange(-6, 20_010, dtype=np.int64).view(np.uint64))
    found = asked[known.lookup(asked)["id"] >= 0].view(np.int64)
    assert sorted(found.tolist()) == list(range(-4, 20_000, 2))


# --- page text -----------------------------------------------------------

SCHEMA_PAGES = "page_id bigint, url string, html string, text string, id string"


def page(body, head="<title>t</title>"):
    return f"<!DOCTYPE html><html><head>{head}<script>var t='</p>';</script></head><body>{body}</body></html>"


@pytest.mark.parametrize("source,want", [
    (page("<nav><a>Menu</a></nav><article><h1>A &amp; B</h1><p><b>one<br><p>two\n three</p></article><footer>f</footer>"), "A & B\none\ntwo three"),
    (page("<div class='ad'>buy</div><main><p>x<p>y &lt;i&gt; &eacute;</main><aside>s</aside>"), "x\ny <i> é"),
    (page("<header><h1>Site</h1></header><p>only <i>in</i>line</p><ul><li>a<li>b</ul><form>q</form><div id=comments><p>hi</div>"), "only inline\na\nb"),
    ("<article><header><h1>T</h1></header><p>cut off &am", "T\ncut off &am"),
    ("<p class=\"a>b\">q</p><p>r</p", "q\nr"), ("plain", "plain"), ("", ""), (None, ""), ("<nav>n</nav>", ""), ("<!-- c --><style>p{}</style>", ""),
    ("<article><p>a</p><section class=comments><p>no</p></section><table><tr><td>x<td>y</table></article>", "a\nx\ny"),
    ("a < b and c<d>e</d>", "a < b and c\ne"),
])
def test_main_text(source, want):
    assert pages.Page(source or "").main_text(set()) == want


def test_site_templates_go_and_content_stays(spark):
    shared = "<p>quoted on every page of the site</p>"
    rows = [(i, f"https://a.example/{i}", page(f"<div>Our shop<span>since 1990</span></div><div><p>text {i} of its own</p></div>"
                                                f"<section>promo {i // 6}</section>"), "t", "x") for i in range(12)]
    rows += [(100 + i, f"http://b.example/{i}", page(f"<div>bar</div><article><p>own {i}</p>{shared}<div>Share this</div></article>"), None, None) for i in range(6)]
    rows += [(200 + i, "https://c.example/", page("<div>same page</div>"), None, None) for i in range(9)]  # copies are one page
    rows += [(300, None, page("<div>no host</div>"), None, None), (301, "https://d.example", None, None, None), (None, "x", "", None, None)]
    df = spark.createDataFrame(rows, SCHEMA_PAGES).repartition(3)
    got = [(r.page_id, r.text, r.n_chars) for r in pages.extract(df).collect()]
    assert len(got) == len(rows) and all(n == len(t) for _, t, n in got)
    text = {i: t for i, t, _ in got}
    assert text[3] == "text 3 of its own" and text[9] == "text 9 of its own"
    assert text[102] == "own 2\nquoted on every page of the site"
    assert text[204] == "same page" and text[300] == "no host" and text[301] == "" and text[None] == ""
    assert pages.extract(spark.createDataFrame([], SCHEMA_PAGES)).count() == 0


@pytest.mark.parametrize("source,want", [
    ("<body class='no-sidebar'><p>text</p></body>", "text"),
    ("<div id='search-results' class='list has-sidebar'><p>text</p></div><div class='site-footer'>f</div>", "text"),
    ("<article class='post has-share related'><p>text</p><div class='post-share'>s</div></article>", "text"),
    ("<form id=f><nav>n</nav><p>all of the page</p><p>and more</p><select><option>o</select></form><div>bar</div><form><p>login</p></form>",
     "all of the page\nand more\nbar"),
    ("<form><div>bar</div><article><p>text</p><form><p>q</p></form></article></form>", "text"),
    ("<div class=widget><main><p>text</p><aside>a</aside></main></div><p>else</p>", "text"),
    ("<main><article><p>text</p></article><div id=comments><article class=comment><p>hi</p></article></div></main>", "text"),
])
def test_names_and_forms_never_hide_the_page(source, want):
    assert pages.Page(source).main_text(set()) == want


def test_near_copies_quotes_and_rare_templates_without_an_article(spark):
    body = "".join(f"<p>{prose(70 + i, 30)}</p>" for i in range(4))
    rows = [(i, "http://n.example/x", page(f"<div>{body}</div><p>read {i} times</p><div>bar</div>"), None, None) for i in range(5)]
    rows += [(10 + i, "http://m.example/x", page(f"<div>{prose(80, 90)}</div><div>seen {i}</div>"), None, None) for i in range(5)]
    quote, notice = f"<blockquote>{prose(90, 20)}</blockquote>", f"<section><p>{prose(91, 10)}</p></section>"
    rows += [(100 + i, "http://q.example/x", page(f"{notice}<div><p>{prose(2000 + i, 40)}</p>{quote if i < 12 else ''}</div>"
                                                   f"<div>{'rare' if i < 11 else i}</div>"), None, None) for i in range(1300)]
    df = spark.createDataFrame(rows, SCHEMA_PAGES).repartition(3)
    text = {r.page_id: r.text for r in pages.extract(df).collect()}
    for i in range(5):
        assert text[i] == "\n".join([*[prose(70 + k, 30) for k in range(4)], f"read {i} times"])
        assert prose(80, 90) in text[10 + i]
    assert text[100] == f"{prose(2000, 40)}\n{prose(90, 20)}"  # the quote stays; notice and rare template go
    assert text[111] == f"{prose(2011, 40)}\n{prose(90, 20)}\n11"


# --- byte-level BPE ------------------------------------------------------

@pytest.fixture(scope="module")
def codecs():
    import tiktoken

    path, pattern = tokenizer()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return bpe.codec(path, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def ids_of(codec, text):
    return np.frombuffer(b"".join(codec.encode(text)), "<u4").tolist()


def test_transducer_equals_library(codecs):
    import random

    own, library = codecs
    rng = random.Random(2)
    signs = ["a", "b", "the", " ", "  ", "\n", "\t", "\x1c", "\x85", "é", "ß", "中", "😀", "👨‍👩", "9", "½", "'s", "'", "!", "-", "\x00", "न", "ा", "A", "　", "\xa0"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 50))) for _ in range(800)]
    texts += ["".join(rng.choice("aeionrst") for _ in range(150)) for _ in range(200)]
    texts += ["a" * 3000, "=" * 999, " " * 500, "é" * 400, prose(1, 2000), "<|endoftext|>"]
    for t in texts:
        ids = ids_of(own, t)
        assert ids == library.encode_ordinary(t)
        assert "".join(own.decode(ids)) == t


def test_transducer_of_odd_merges():
    """A rank file whose order is not that of any training."""
    ranks = {bytes([i]): 100 + i for i in range(256)}
    ranks |= {b"abc": 1, b"ab": 7, b"bc": 9, b"aa": 3, b"aaa": 2, b"ca": 4, b"bca": 0}
    machine = bpe.Transducer(ranks)
    import itertools

    for n in range(1, 9):
        for t in itertools.product(b"abc", repeat=n):
            text = bytes(t)
            parts, _ = machine._merges(text)
            want = [ranks[text]] if text in ranks else [ranks[p] for p in parts]
            assert machine.encode(text) == want, text


def test_bounded_tables_give_the_same_ids(codecs, monkeypatch):
    path, pattern = tokenizer()
    monkeypatch.setattr(bpe, "STATE_LIMIT", 5)
    monkeypatch.setattr(bpe, "PIECE_LIMIT", 3)
    monkeypatch.setattr(bpe, "PAIR_LIMIT", 4)
    small = bpe.Codec(path, pattern)
    for i in range(20):
        assert ids_of(small, prose(i)) == ids_of(codecs[0], prose(i))


def test_states_hold_no_tokens_and_stay_bounded_in_long_pieces(codecs, monkeypatch):
    """Words that differ only in tokens further back share their states, and a
    piece of any length is read block by block with the same ids."""
    import random

    path, pattern = tokenizer()
    ranks, rng = bpe.read_ranks(path), random.Random(3)
    machine = bpe.Transducer(ranks)
    for word in (b" erortionen", b" thonerwhnthe"):
        machine.encode(word)
    assert all(isinstance(h, int) for state in machine.states.values() for h in state[bpe.OPEN])
    pieces = ["".join(rng.choice("aeionrstéß中") for _ in range(1500)) for _ in range(3)] + ["a" * 2000, "=" * 700, "人" * 300]
    want = [codecs[1].encode_ordinary(p) for p in pieces]
    monkeypatch.setattr(bpe, "STATE_LIMIT", 50)
    for block in (1, 7, 64):
        monkeypatch.setattr(bpe, "BLOCK", block)
        machine = bpe.Transducer(ranks)
        for piece, ids in zip(pieces, want):
            assert machine.encode(piece.encode()) == ids
            assert len(machine.states) <= 50 + 1 + block


def test_utf8_stream_at_every_cut():
    data = "aé中😀z".encode() + b"\xff\xe4\xb8x\xf0\x9f"
    for cut in range(len(data) + 1):
        for cut2 in range(cut, len(data) + 1):
            s = bpe.Utf8Stream()
            got = s.feed(data[:cut]) + s.feed(data[cut:cut2]) + s.feed(data[cut2:]) + s.end()
            assert got.replace("�", "") == data.decode("utf-8", "replace").replace("�", "")
            assert "�" in got


def test_bpe_rows(spark, docs, empty, codecs):
    rows = bpe.encode(docs, *tokenizer(), with_ids=True).collect()
    want = Counter()
    for r in documents():
        ids = codecs[1].encode_ordinary(r[1] or "")
        want[r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest(), tuple(ids)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in rows) == want
    back = bpe.decode(bpe.encode(docs, *tokenizer(), with_ids=True), *tokenizer()).collect()
    assert Counter(r.text for r in back) == Counter(r[1] or "" for r in documents())
    assert bpe.encode(empty, *tokenizer()).count() == 0


# --- toxicity ------------------------------------------------------------

def test_toxicity_held_out_and_unseen_spellings(spark, docs, empty):
    bad = ["horridus", "vilestus", "wretchum"]
    rows = [(i, prose(i, 50) + (" " + " ".join(bad) if i % 4 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in rows] + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    df = spark.createDataFrame(rows + [(1000, prose(5000, 30) + " horridum vilestum wretchus"), (1001, None), (1002, "")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in toxicity.learn_and_score(df, labels).collect()}
    assert len(got) == 403 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [r for r in got.values() if r.held_out and r.doc_id < 400]
    assert held and all(r.held_out == (crc(r.doc_id, 5) == 0) for r in got.values())
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
    assert got[1000].predicted == 1 and got[1001].score == got[1002].score
    edge = toxicity.learn_and_score(docs, labels).collect()
    assert len(edge) == docs.count() and toxicity.learn_and_score(empty, labels).count() == 0
    assert toxicity.learn_and_score(df, labels.limit(0)).count() == 403
    kept = toxicity.with_score(docs, toxicity.fit([], np.zeros(0, np.int64)))
    assert sorted(kept.columns) == sorted(docs.columns)  # score is replaced


def test_toxicity_one_long_text_does_not_take_the_sample(spark):
    rows = [(i, prose(i, 50) + (" horridus vilestus wretchum" if i % 4 == 0 else "")) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id bigint, toxic int")
    order = labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).orderBy(F.xxhash64("doc_id")).select("doc_id", "toxic").collect()
    long = {next(r.doc_id for r in order if r.toxic == t) for t in (0, 1)}  # the first of each label
    schema = "doc_id bigint, text string"
    alone = {r.doc_id: r.score for r in toxicity.learn_and_score(spark.createDataFrame(rows, schema), labels).collect()}
    big = prose(7, 2000) * 3400
    assert len(big) > 30 << 20
    got = {r.doc_id: r.score for r in toxicity.learn_and_score(spark.createDataFrame(
        [(i, big if i in long else t) for i, t in rows], schema), labels).collect()}
    others = [i for i in alone if i not in long]
    assert sum((got[i] >= 0.5) == (alone[i] >= 0.5) for i in others) >= 0.97 * len(others)
    assert sum(got[i] >= 0.5 for i in others if i % 4 == 0) >= 0.95 * 74


def test_toxicity_bags_and_scores_agree():
    rng = np.random.default_rng(1)
    model = toxicity.Model(rng.standard_normal(toxicity.BUCKETS).astype(np.float32), 0.3)
    texts = pa.array([prose(1), "", None, "a", "é b!c  D", prose(2, 500)])
    scores = model.scores(texts)
    for (ids, weights), score in zip(toxicity.bags(texts), scores):
        assert len(ids) == 0 or weights.sum() == pytest.approx(1)
        assert score == pytest.approx(1 / (1 + math.exp(-(float(model.table[ids] @ weights) + 0.3))))


# --- nearest neighbours --------------------------------------------------

@pytest.mark.parametrize("block_rows", [annsearch.BLOCK_ROWS, 30])  # one pass over 3 blocks, two passes over 30
def test_nearest_neighbours_against_all_distances(spark, block_rows):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((900, 24)).astype(np.float32)
    x[100:400] = x[50]  # a hot vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(901, None), (902, [0.0] * 24), (903, [float("nan")] * 24), (904, [1.0] * 23), (None, [1.0] * 24), (905, [None] + [1.0] * 23)]
    df = spark.createDataFrame(rows + bad + rows[:5], "vec_id bigint, embedding array<float>").repartition(3)
    got = defaultdict(list)
    index = annsearch.Index(df, block_rows=block_rows)
    assert (index.blocks.count() >= annsearch.TWO_PASSES) == (block_rows == 30)
    for r in index.search(F.col("id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    hit = 0
    for q in range(0, 900, 50):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(900), d)) if i != q][:10]
        assert [r for r, _, _ in got[q]] == list(range(1, 11))
        hit += len(set(order) & {v for _, v, _ in got[q]})
        assert all(s == pytest.approx(d[v], abs=1e-12) for _, v, s in got[q])
    assert hit >= 0.9 * 180 and len(got) == 18
    few = annsearch.Index(df.filter("vec_id < 4")).search(F.col("id") % 50 == 0).collect()
    assert [r["rank"] for r in few] == [1, 2, 3]
    assert annsearch.Index(df.limit(0)).search(F.col("id") % 50 == 0).count() == 0


def test_one_bit_estimates_keep_their_bound():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((2000, 64))
    turn = annsearch.rotation(64)
    codes, scalars = annsearch.encode(x, np.zeros(64), turn)
    q = rng.standard_normal(64)
    u = q @ turn / np.linalg.norm(q)
    signs = np.unpackbits(codes, axis=1, count=64) * 2.0 - 1
    estimate = signs @ u / 8 / scalars[:, 1]
    true = x @ q / np.linalg.norm(x, axis=1) / np.linalg.norm(q)
    width = annsearch.ERROR * np.sqrt(1 - scalars[:, 1] ** 2) / scalars[:, 1] / np.sqrt(63)
    assert (np.abs(estimate - true) <= width).mean() > 0.99


# --- decontamination -----------------------------------------------------

def plain_hits(docs, items):
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    out = []
    for key, text in docs:
        w, hit, found = split(text), set(), set()
        for item, item_text in items:
            iw = split(item_text)
            n = min(10, len(iw))
            for i in range(len(iw) - n + 1 if n else 0):
                for j in range(len(w) - n + 1):
                    if w[j:j + n] == iw[i:i + n]:
                        hit.update(range(j, j + n))
                        found.add("null" if item is None else str(item))
        out.append((key, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def test_decontamination(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 300)
    monkeypatch.setattr(decontaminate, "FILE_ITEMS", 3)
    base = prose(1).split()
    items = [(1, " ".join(base[5:30])), (2, "ONE, two!"), (3, ""), (4, None), (None, " ".join(base[40:])), (10, " ".join(base[5:17])), (5, "a a a"),
             (2, prose(77, 30)), (6, "straße élan")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    extra = [(50, "x a a a a y", None, None, None, None, None, None, None), (51, "one two one two " + " ".join(base[6:18]), None, None, None, None, None, None, None)]
    df = docs.union(spark.createDataFrame(extra, SCHEMA))
    got = Counter(tuple(r) for r in decontaminate.Index(df, bench).digest().collect())
    assert got == plain_hits([(r[0], r[1]) for r in documents() + extra], items)
    assert decontaminate.Index(empty, bench).digest().count() == 0
    none = decontaminate.Index(df, bench.limit(0)).digest().collect()
    assert len(none) == df.count() and not any(r.contaminated or r.n_hit for r in none)


def test_decontamination_postings_stay_out_of_spark(spark, monkeypatch):
    """Rows of the index that Spark handles are names: their bytes follow the blocks, not the words."""
    monkeypatch.setattr(decontaminate, "TASK_BLOCKS", 2, raising=False)
    rows = [(i if i % 7 else None, prose(i, 500)) for i in range(30)]
    items = [(1, " ".join(rows[3][1].split()[100:125])), (2, " ".join(rows[20][1].split()[:10]))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)  # each task writes a block
    index = decontaminate.Index(df, spark.createDataFrame(items, "item_id bigint, text string"))
    got = Counter(tuple(r) for r in index.digest().collect())
    assert got == plain_hits(rows, items)
    assert index.blocks.count() >= 2
    assert index.blocks.toArrow().nbytes < 200 * index.blocks.count()


def test_proximity_matches(spark):
    rows = [(1, "p q alpha beta gamma delta r"), (2, "alpha x beta gamma y delta"), (3, "delta gamma beta alpha"), (4, "alpha beta gamma z z z z z delta")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, "alpha beta gamma delta")], "item_id bigint, text string")
    got = {tuple(r) for r in decontaminate.Index(df, bench).matches(slop=2).collect()}
    assert got == {(1, "7", "phrase", 2, 4), (2, "7", "proximity", 0, 6), (3, "7", "proximity", 0, 4)}
