"""Token codes, the n-gram join, substring deduplication, and page text against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tablepact.llm import html_text, ngram_join, substring_dedup, textkit, token_codes
from tablepact.llm.store import Scratch

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def some_docs():
    """Copies, near copies, shared passages, null and empty texts, odd white space, repeated rows, one long text."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, passage = text(120), text(30)
    out = [base, base, base + " tail", "Other " + base, base.upper().replace("É", "é"), passage, f"{text(40)} {passage} {text(40)}", f"{passage}\n{text(20)}", None, "", " \t\n", "one", "one two three", "one  two\tthree", "ONE TWO THREE", "one two"]
    chain = text(100).split()
    for _ in range(8):  # each near the one before it, the last far from the first
        at = r.randrange(0, 95)
        chain = [*chain[:at], word(), *chain[at + 1 :]]
        out.append(" ".join(chain))
    core = text(60).split()
    for i in range(40):  # a group of near copies
        out.append(" ".join([*core[: i + 3], word(), *core[i + 3 :]]))
    out += [text(r.randint(5, 80)) for _ in range(30)]
    out += [" ".join([passage] * 60), "a " * 400, "x y z " + text(15), text(20) + "\x1c\x1d" + text(5), text(3000)]
    rows = [(7 * i + 3, t) for i, t in enumerate(out)]
    return rows + [rows[2], (None, base), (4, base + " tail more words here")]


DOCS = some_docs()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*d, 1, 2, "k", [1]) for d in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, n int, cid long, key string, anchors array<int>").repartition(3)


# -- words ------------------------------------------------------------------------------------


@settings(deadline=None, max_examples=150)
@given(st.lists(st.text(alphabet=st.sampled_from("aB z\t\n\r\x0b\x1c é0!_"), max_size=30) | st.none(), max_size=8), st.integers(1, 40))
def test_words_equal_regular_expressions(texts, limit):
    import pyarrow as pa

    for table, lower, pattern in ((textkit.SPACED, False, SPACED), (textkit.SPACED, True, SPACED), (textkit.ALNUM, True, ALNUM)):
        got = []
        for run in textkit.runs(pa.array(texts, pa.string()), table, lower, limit):
            words = [run.text(i).decode() for i in range(len(run.start))]
            got += [words[run.first[i] : run.first[i + 1]] for i in range(run.hi - run.lo)]
            assert len({(w, h) for w, h in zip(words, run.hashes().tolist())}) == len(set(words)) == len(set(run.hashes().tolist()))
        assert got == [pattern.findall(lowered(t) if lower else t or "") for t in texts]


def test_sequences_are_told_apart():
    h = textkit.mix(np.arange(50, dtype=np.uint64))
    same = textkit.sequence_hashes(np.concatenate([h, h]), np.array([3, 53]), 5)
    assert same[0] == same[1]
    a = textkit.sequence_hashes(np.concatenate([h, h[::-1]]), np.arange(0, 45), 5)
    assert len(set(a.tolist())) == 45


# -- token codes ------------------------------------------------------------------------------


@settings(deadline=None, max_examples=80)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 70_000) | st.integers(0, 300), max_size=1500))
def test_codes_round_trip(ids):
    x = np.array(ids, np.uint32)
    shard = token_codes.DacShard(token_codes.pack(x, np.array([len(x)], np.uint64)))
    assert shard.tokens().tolist() == ids and all(shard.token(i) == v for i, v in list(enumerate(ids))[::37])
    with pytest.raises(IndexError):
        shard.token(len(ids))


def test_pieces_are_coded_once(monkeypatch):
    """A piece is still known after the cache's turn, and words of letters at a line's start need no pattern."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from types import SimpleNamespace

    monkeypatch.setattr(token_codes, "CACHE_PIECES", 4)
    code, calls = token_codes.ByteBpe(public_tokenizers.path("byte_bpe_50k.json")), []
    model = code.model
    code.model = SimpleNamespace(tokenize=lambda said: calls.append(said) or model.tokenize(said))
    for text in ("ab cde fghé ij kl.", "cde, fghé ij;\nab\nij! kl", "a1b it's \u00e9t\u00e9.\n\"cde\" x\n.y"):
        assert np.frombuffer(code.encode(text), "<u4").tolist() == code.whole.encode(text, add_special_tokens=False).ids
        if "'" not in text:
            assert len(calls) <= 7, calls  # the five words, and two of them without a space
    code.pieces = None
    text = "Word\nOther, word.\nMore"
    assert np.frombuffer(code.encode(text), "<u4").tolist() == code.whole.encode(text, add_special_tokens=False).ids


def test_tokens_of_documents(spark, docs):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    got = sorted(token_codes.tokenize(docs, path).collect(), key=lambda r: r.start)
    rows = sorted(docs.select("doc_id", F.xxhash64("text"), "text").collect(), key=lambda d: (d[0] is not None, d[0] or 0, d[1]))
    everything, start = [], 0
    for r, (doc, _, text) in zip(got, rows, strict=True):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        everything += ids
    assert token_codes.tokenize(docs.limit(0), path).count() == 0
    # Shards of a few ids hold the same, and each id can be looked up in them.
    out = f"{Scratch(spark, 'shards').path}/small"
    token_codes.encode_documents(docs, out, path, shard_tokens=200)
    assert sorted(token_codes.read_documents(spark, out).collect(), key=lambda r: r.start) == got
    assert spark.read.parquet(out).count() > 10
    for i in (0, 1, 199, 200, 201, len(everything) // 2, len(everything) - 1):
        assert token_codes.read_token(spark, out, i) == everything[i]
    for i in (-1, len(everything)):
        with pytest.raises(IndexError):
            token_codes.read_token(spark, out, i)


_coded = []


@settings(deadline=None, max_examples=400)
@given(st.text(alphabet=st.sampled_from("aB'tsé \n\t\r1²३.,!?-_#\x1c\x85\xa0\u2003\u3000中😀ßǅ\u0301\u200d"), max_size=40) | st.text(max_size=40))
def test_ids_equal_the_librarys(text):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    if not _coded:
        _coded.append(token_codes.ByteBpe(public_tokenizers.path("byte_bpe_50k.json")))
    (code,) = _coded
    for t in (text, text, f"word {text} word"):  # the second time from the cache
        assert np.frombuffer(code.encode(t), "<u4").tolist() == code.whole.encode(t, add_special_tokens=False).ids


def test_cache_is_emptied_when_full(monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(token_codes, "CACHE_PIECES", 5)
    monkeypatch.setattr(token_codes, "CACHE_WORDS", 3)
    code = token_codes.ByteBpe(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("one two three four five six seven one two.", "one two three, one two! eight nine ten"):
        for _ in range(3):
            assert np.frombuffer(code.encode(text), "<u4").tolist() == code.whole.encode(text, add_special_tokens=False).ids
    assert len(code.small) <= 5 and len(code.words) <= 3


def test_words_of_a_run_are_coded_once(monkeypatch):
    """However little is kept, a word that recurs in a run of texts takes one call."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from types import SimpleNamespace

    monkeypatch.setattr(token_codes, "CACHE_PIECES", 1)
    monkeypatch.setattr(token_codes, "CACHE_WORDS", 0)
    code, calls = token_codes.ByteBpe(public_tokenizers.path("byte_bpe_50k.json")), []
    model = code.model
    code.model = SimpleNamespace(tokenize=lambda said: calls.append(said) or model.tokenize(said))
    text = "x" + " aa b\u00e9, cc. dd" * 50
    assert np.frombuffer(code.encode(text), "<u4").tolist() == code.whole.encode(text, add_special_tokens=False).ids
    assert len(calls) == 5, len(calls)
    calls.clear()
    assert list(code.encode_all(pa.array([text] * 3))) == [code.encode(text)] * 3 and len(calls) == 10


@settings(deadline=None, max_examples=300)
@given(st.lists(st.none() | st.text(alphabet=st.sampled_from("aZ9\u00e9\u00d7\u00f7\u00ff\u00c0'\u2019st.,-(_\n   \t\u0301\u4e2d\u00b2"), max_size=25), max_size=8), st.sampled_from([1, 20, 1 << 20]))
def test_ids_of_a_run_equal_the_librarys(texts, run):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    if not _coded:
        _coded.append(token_codes.ByteBpe(public_tokenizers.path("byte_bpe_50k.json")))
    (code,) = _coded
    want = [np.array(code.whole.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(token_codes, "RUN", run)
        for kind in (pa.string(), pa.large_string()):
            assert list(code.encode_all(pa.array(texts, kind))) == want
            assert list(code.encode_all(pa.array(["a b", *texts, "c"], kind).slice(1, len(texts)))) == want


def test_added_tokens_in_a_text():
    """As the library has them by default: a text's <|endoftext|> is one id."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, code = Tokenizer.from_file(path), token_codes.ByteBpe(path)
    assert code.cached and code.added
    for text in [x for t in code.added for x in (t, f"end {t} more", f"a{t}b {t}{t}\n{t}.", t[:-1], t.upper())] + ["end < |endoftext|> more", "none of it"]:
        assert np.frombuffer(code.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text
    assert np.frombuffer(code.encode("end <|endoftext|> more"), "<u4").tolist() == [437, 220, 50256, 517]


# -- n-gram join ------------------------------------------------------------------------------


def shingle_sets(rows, size=5):
    sets = []
    for _, text in rows:
        w = SPACED.findall(lowered(text))
        k = min(len(w), size)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    return sets


def plain_components(rows, size=5, percent=75):
    sets = shingle_sets(rows, size)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    names = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        names[find(i)].append(doc)
    smallest = {k: min((d for d in v if d is not None), default=None) for k, v in names.items()}
    return Counter((d, len(s), smallest[find(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("boundary", [None, 0, 10**6])
def test_ngram_join(spark, docs, monkeypatch, boundary):
    if boundary is not None:  # all sets heavy, and all light
        monkeypatch.setattr(ngram_join, "choose_boundary", lambda sizes: boundary)
    got = ngram_join.join(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_components(DOCS)


def test_ngram_join_of_long_lists(spark, docs, monkeypatch):
    """Lists in parts, each with a first member of its own; whole sets by a shuffled join."""
    monkeypatch.setattr(ngram_join, "LONG_LIST", 3)
    monkeypatch.setattr(ngram_join, "BROADCAST_KEYS", 0)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(docs).collect()) == plain_components(DOCS)


def test_ngram_join_lights_small_sets(spark, docs):
    """With its own costs, sets of a few shingles list subsets."""
    classes, rarity = ngram_join._survey(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), 5, Scratch(spark, "t"))
    costs = ngram_join._costs(classes, 75, rarity)
    assert {n for n, _, _ in costs} == {len(s) for s in shingle_sets(DOCS) if 1 < len(s) <= ngram_join.LIGHT_MOST}
    assert ngram_join.choose_boundary(costs) > min(n for n, _, _ in costs)


def test_ngram_join_names_classes_and_groups(docs):
    got = ngram_join.join(docs).collect()
    sets = {}
    for (doc, text), s in zip(DOCS, shingle_sets(DOCS)):
        sets.setdefault(frozenset(s), []).append(doc)
    smallest = {k: min((d for d in v if d is not None), default=None) for k, v in sets.items()}
    want = Counter((doc, smallest[frozenset(s)] if s else doc) for (doc, _), s in zip(DOCS, shingle_sets(DOCS)))
    assert Counter((r.doc_id, r.class_id) for r in got) == want
    groups = {}
    for r in got:
        groups.setdefault(r.group_id, set()).add(r.component_id)
    assert all(len(v) == 1 for k, v in groups.items() if k is not None)


def test_ngram_join_of_nothing(spark, docs):
    assert ngram_join.join(docs.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in ngram_join.join(docs.filter("text IS NULL")).collect()] == [(next(d for d, t in DOCS if t is None), 0, next(d for d, t in DOCS if t is None))]


def test_boundary_is_where_costs_cross():
    assert ngram_join.choose_boundary([(2, 1, 5), (10, 5, 6), (100, 900, 50)]) == 100
    assert ngram_join.choose_boundary([(2, 9, 5)]) == 2 and ngram_join.choose_boundary([]) == 0


# -- substrings -------------------------------------------------------------------------------


def plain_dedup(rows, window=13):
    last = 1 << 62
    words = [SPACED.findall(t or "") for _, t in rows]
    first = {}
    for (doc, _), w in zip(rows, words):
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, last), last if doc is None else doc)
    out = []
    for (doc, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (last if doc is None else doc):
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return Counter(out)


@pytest.mark.parametrize("small", [False, True])
def test_substrings(spark, docs, monkeypatch, small):
    if small:  # the way beyond the bitmap, and shards of few segments in parts
        monkeypatch.setattr(substring_dedup, "BITMAP_LOG2", 2)
        monkeypatch.setattr(substring_dedup, "SHARD_SEGMENTS", 20)
    got = substring_dedup.dedup(docs, texts=True).collect()
    assert Counter(map(tuple, got)) == plain_dedup(DOCS)


def test_substrings_of_nothing(spark, docs):
    assert substring_dedup.dedup(docs.limit(0)).count() == 0


# -- pages ------------------------------------------------------------------------------------

PAGES = [
    (None, ""), ("", ""), ("plain text only", "plain text only"), ("<p>a < b</p>", "a < b"), ("<script>var t='</p>';</script><p>x", "x"), ("<p>x<!-- never closed <p>y", "x"),
    ('<body><header class=x>Head</header><div id="content"><h1>T</h1><p>Para one is long enough &amp; ok.<p>Second&nbsp;para <span class="ad">BUY</span> here.<div class="comments"><p>hi</p></div></div><div class="sidebar">x</div></body>', "T Para one is long enough & ok. Second para here."),
    ('<main><p>a<p class="notice">n<p>b</main>', "a b"),
    ("<article><h1>x</h1><aside>q</aside><p>y</p><form>z<p>w</form><p>v</article><section class=comments><article><p>ccccccccccccccccccccccccc</article></section>", "x y v"),
    ("<ul><li><a href=x>menu</a><li><a href=y>menu2</a></ul><p>Body text that is long.</p><p>More</p>", "Body text that is long. More"),
    ("<article><p>x &lt;b&gt; y<!-- c --> z</p></article><scr", "x <b> y z"), ("<p>" + "long " * 50_000 + "</p>", ("long " * 50_000).strip()), ("<p>a</b></div></p></article><p>b", "a b"),
]


@pytest.mark.parametrize("page, want", PAGES, ids=range(len(PAGES)))
def test_main_text(page, want):
    assert html_text.main_text(page) == want


A, B = "The first half of a story.", "The other half, which is longer than it."
LINKS = "<ul{}><li><a href=x>one link</a><li><a href=y>two links</a><li><a href=z>three links</a></ul>"

UNMARKED = [
    (f"<div id=content><p>{A}</p>{LINKS.format(' class=related')}<p>{B}</p></div>", f"{A} {B}"),
    (f"<div id=content><p>{A}</p>{LINKS.format('')}<p>{B}</p></div>", f"{A} one link two links three links {B}"),
    (f"{LINKS.format('')}<div><div><p>{A}</p></div>{LINKS.format('')}<div><p>{B}</p></div></div>{LINKS.format('')}<p>Street 1", f"{A} {B}"),
    (f"<p>{A}</p>{LINKS.format(' class=menu')}<p>{B}</p>", f"{A} {B}"),
    (f"<div><p>{A}<p>See <a href=x>all of the other stories</a><p>© is a sign<p>{B}<p><a href=y>Source</a></div>", f"{A} See all of the other stories © is a sign {B} Source"),
]


@pytest.mark.parametrize("page, want", UNMARKED, ids=range(len(UNMARKED)))
def test_unmarked_content_is_kept_whole(page, want):
    assert html_text.main_text(page) == want


STORY, CARD = f"<h1>Title</h1><p>{A}</p><p>{B}</p>", "<section><article><p>Teaser.</p></article></section>"

CHOSEN = [
    (f"<main>{STORY}</main>{CARD}", f"Title {A} {B}"),
    (f"{CARD}<div id=x>{STORY}</div>", f"Title {A} {B}"),
    (f"<main><article>{STORY}</article><p>more</p></main>{CARD}", f"Title {A} {B}"),
    (f"<article><p>{A}</p></article><article><p>{B}</p></article>{CARD}", f"{A} {B}"),
    (f"<div><div><article><p>{A}</p></article></div><div><article><p>{B}</p></article></div></div>", f"{A} {B}"),
    (f"<article><p>{A}</p></article><div><p>{B}</p></div>", f"{A} {B}"),
    *[(f"<div class='{c}'>{STORY}<div class='{x}'>apart</div></div>", f"Title {A} {B}") for c, x in (("post has-sidebar", "sidebar"), ("no-comments", "post-comments"), ("elementor-widget", "ad_slot-1"), ("page-with-header", "site-footer"), ("entry-header", "shareButtons"))],
]


@pytest.mark.parametrize("page, want", CHOSEN, ids=range(len(CHOSEN)))
def test_content_is_chosen_by_its_text(page, want):
    assert html_text.main_text(page) == want


@settings(deadline=None, max_examples=200)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "<article>", "</article>", "<nav>", "</nav>", "<li>", "<a href='x'>", "</a>", "<!--", "-->", "<script>", "</script>", "text ", "&amp;", "&", "<", ">", '"', "<br>", "<p class=\"ad\">"]), max_size=40))
def test_any_markup_gives_some_text(parts):
    text = html_text.main_text("".join(parts))
    assert text == " ".join(text.split())


def test_pages(spark):
    pages = spark.createDataFrame([(i, f"u{i}", p, "t", 1) for i, (p, _) in enumerate(PAGES)] + [(0, "u0", None, "t", 1)], "page_id long, url string, html string, text string, n_chars int")
    got = sorted(map(tuple, html_text.extract(pages).collect()))
    assert got == sorted([(i, f"u{i}", w, len(w)) for i, (_, w) in enumerate(PAGES)] + [(0, "u0", "", 0)])
    assert html_text.extract(pages.limit(0)).count() == 0


@settings(deadline=None, max_examples=300)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-1, 1), st.integers(0, 4)), max_size=40), st.lists(st.integers(0, 40), max_size=6))
def test_lists_are_read_across_batches(rows, cuts):
    import pyarrow as pa

    # key, part (from 0, or -1 in a key that isn't dealt out), class; its place follows from the class
    rows = sorted((k, p if k % 2 else -1, 5 - c, c) for k, p, c in rows if not k % 2 or p >= 0)
    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int64()))]
    batch = pa.RecordBatch.from_arrays([*columns, pa.array([7 + r[3] for r in rows], pa.int32())], ["key", "part", "pos", "cid", "n"])
    cuts = [0, *sorted(min(c, len(rows)) for c in cuts), len(rows)]
    got = [r for b in ngram_join.read_lists(batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:])) for r in zip(*(c.to_pylist() for c in b.columns))]
    lists = defaultdict(list)
    for r in dict.fromkeys(rows):
        lists[r[:2]].append(r)
    want = [(k, c, 7 + c, pos, v[0][3], 7 + v[0][3], v[0][2]) for v in lists.values() if len(v) > 1 or v[0][1] >= 0 for k, _, pos, c in v]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("part", ['<script "', '<a "', "<a '\"", "<b>", "<h1>", "<a <a ", "<", "<p>", "<!-- ", "&"], ids=range(10))
def test_long_markup_takes_linear_time(part):
    import time

    def took(n):
        start = time.process_time()
        html_text.main_text(part * (n // len(part)) + ">" + "</i>" * 1000)
        return time.process_time() - start

    took(10_000)
    assert took(400_000) < 2


def test_quotes_in_tags():
    for page, want in (("<p title='a>b'>x", "x"), ('<p title="it\'s > that">x', "x"), ("<p title='a>x", "<p title='a>x"), ("a < b > c", "a < b > c"), ("<p>x</p><!x", "x"), ("<script>'</script><p>y", "y")):
        assert html_text.main_text(page) == want, page


def test_workers_let_go_of_what_other_work_kept():
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    textkit.kept.clear()
    code = token_codes.coder(path)
    list(textkit.freed(iter, "token_codes")([]))
    assert token_codes.coder(path) is code
    list(textkit.freed(iter)([]))
    assert not textkit.kept
