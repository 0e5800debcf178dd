"""Language models, the classifier, page extraction, the join and the pipeline."""

import random
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

import corpus_pipeline
from driftline.llm import html_extraction, language_id, line_dedup, ngram_join, packing, toxicity
from driftline.llm.common import components, table
from driftline.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
given_tables = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="needs the given tables")


# ---- language identification -----------------------------------------------------------------


def _words(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def language_docs(spark):
    rng = random.Random(5)
    kinds = {"aa": ["ka", "ro", "mi", "tu"], "bb": ["sch", "ein", "ung", "ß"]}
    rows = [(i, _words(rng, kinds[lang], 40), lang, "p", "s", None) for i, lang in enumerate(["aa", "bb"] * 40)]
    rows += [(90, None, "aa", "p", "s", None), (91, "", "bb", "p", "s", None), (92, "123 ... !", "aa", "p", "s", None),
             (93, _words(rng, kinds["aa"], 20_000), None, "p", "s", None), (94, "ΩΨΦ ΔΣ ЖЯ ЫЭ " * 20, None, "p", "s", None),
             (None, "karomi", None, "p", "s", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, gram string, n long")


def test_language_id(spark, language_docs):
    model = language_id.fit(language_docs)
    out = language_id.identify(language_docs, model)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == language_docs.count() and "gram" in out.columns
    assert all(r.lang_pred == r.lang and not r.rejected and 0 <= r.score <= 1 for i, r in got.items() if i is not None and i < 90)
    assert [got[i].lang_pred for i in (90, 91, 92)] == ["und"] * 3 and all(got[i].rejected for i in (90, 91, 92))
    assert got[93].lang_pred == "aa" and not got[93].rejected and got[94].rejected and got[None].lang_pred == "aa"
    nothing = language_id.fit(language_docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(language_docs, nothing).collect()} == {"und"}
    assert language_id.identify(language_docs.limit(0), model).count() == 0


def test_predictions_equal_a_plain_version_in_any_number_of_parts(language_docs):
    """Language, score and rejection from plain dictionaries of log-probabilities, text by text."""
    docs = language_docs.where("doc_id is null or doc_id <> 93")
    whole = language_id.fit(docs)
    assert whole.parts == 1
    fold, texts = language_id._folded(), {r.doc_id: r.text for r in docs.collect()}
    expected = {}
    for key, text in texts.items():
        windows = language_id._grams([text], fold)[0]
        if not len(windows):
            expected[key] = ("und", 0.0, True)
            continue
        logs = whole.log_probabilities(windows).astype(float)
        entropy = [-sum(row[i] for row in logs) / len(logs) for i in range(2)]
        best = min(range(2), key=lambda i: entropy[i])
        odds = [np.exp(-(e - entropy[best]) * min(len(logs), language_id.EVIDENCE)) for e in entropy]
        limit = whole.mean[best] * (1 + language_id.SLACK) + language_id.STANDARD_ERRORS * whole.spread[best] * (
            language_id.ORDER / len(logs)) ** 0.5
        expected[key] = (whole.languages[best], 1 / sum(odds), bool(entropy[best] > limit))
    for rows in (1 << 20, 150, 30):
        places, parts = language_id._places(whole.values, rows)
        assert (parts > 1) == (rows <= 150) and (parts > 2 or rows != 30)
        assert all(sum(len(h) for o in range(2, 5) for h, _ in (t.grams[o], t.contexts[o])) < 4 * rows
                   for t in [language_id.Model(**{**vars(whole), "places": places, "parts": parts}).tables(parts - 1)])
        model = language_id.Model(**{**vars(whole), "places": places, "parts": parts})
        got = {r.doc_id: (r.lang_pred, r.score, r.rejected) for r in language_id.identify(docs, model).collect()}
        assert got.keys() == expected.keys()
        for key, (lang, score, rejected) in expected.items():
            assert got[key] == (lang, pytest.approx(score, rel=1e-4, abs=1e-9), rejected)


def test_unseen_grams_meet_no_stranger(language_docs):
    """Every gram has its own entry: unseen ones always back off."""
    tables = language_id.fit(language_docs).tables(0)
    rng = np.random.default_rng(3)
    unseen = rng.integers(0, 1 << 63, 200_000, dtype=np.uint64)
    for order in range(1, 5):
        known = np.isin(language_id._hash(unseen), tables.grams[order][0])
        assert len(language_id._look_up(*tables.grams[order], unseen)[1]) == len(unseen) - known.sum()
        assert len(np.unique(tables.grams[order][0])) == len(tables.grams[order][0])


def test_kneser_ney_against_a_plain_version(language_docs):
    model = language_id.fit(language_docs)
    fold = language_id._folded()
    for at, lang in enumerate(model.languages):
        texts = [r.text for r in language_docs.where(f"lang = '{lang}' and text is not null").collect()]
        counts = defaultdict(int)
        for t in texts:
            for g in language_id._grams([t], fold)[0].tolist():
                counts[g] += 1
        tables = {4: dict(counts)}
        for order in (3, 2, 1):
            tables[order] = defaultdict(int)
            for g in tables[order + 1]:
                tables[order][g & ((1 << 16 * order) - 1)] += 1

        def p(order, g):
            if order == 0:
                return float(np.exp(model.unknown))
            t = tables[order]
            n1, n2 = (sum(v == k for v in t.values()) for k in (1, 2))
            d = n1 / (n1 + 2 * n2) if n1 else 0.5
            own = [v for k, v in t.items() if k >> 16 == g >> 16]
            lower = p(order - 1, g & ((1 << 16 * (order - 1)) - 1))
            return (max(t.get(g, 0) - d, 0) + d * len(own) * lower) / sum(own) if own else lower

        grams = [*list(counts)[:15], (ord("k") << 48) | (ord("q") << 32) | (ord("a") << 16) | ord("i"), *[g ^ 1 for g in list(counts)[:5]]]
        got = model.log_probabilities(np.array(grams, dtype=np.uint64))[:, at]
        assert got == pytest.approx([np.log(p(4, g)) for g in grams], rel=1e-4)


# ---- toxicity --------------------------------------------------------------------------------


def test_swaps_are_penalised():
    """A term of a group that toxic texts name more often raises scores, unless swaps are penalised."""
    bad, group, other, plain = 0, 1, 2, 3
    rows = [[bad, group]] * 30 + [[group, plain]] * 5 + [[plain, other]] * 30 + [[plain]] * 30
    swapped = [[other if f == group else group if f == other else f for f in r] if {group, other} & set(r) else None for r in rows]
    toxic = [1] * 30 + [0] * 65
    free, _ = toxicity.train(rows, swapped, toxic, np.ones(95), 4, pairing=0.0)
    held, intercept = toxicity.train(rows, swapped, toxic, np.ones(95), 4, pairing=100.0)
    assert abs(held[group] - held[other]) < 0.1 * abs(free[group] - free[other])
    assert intercept + held[bad] + held[group] > 0 > intercept + held[group] + held[plain]


def test_toxicity(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(400):
        words = [f"w{rng.randrange(300)}" for _ in range(30)]
        if i % 4 == 0:
            words[rng.randrange(30)] = rng.choice(["vileness", "vilely", "scum"])
        rows.append((i, " ".join(words), "x", "y"))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(500, None, "", ""), (501, "", "", ""), (None, "scum", "", ""), (502, "scum " * 50_000, "", ""), (502, "scum", "", "")]
    labels += [(None, 1, 1), (3, None, None), (999, 0, 1), (0, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, toxic string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs.where("doc_id % 5 <> 0"), marks)
    out = toxicity.score(docs, model)
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    hits = [(r.predicted, int(r.doc_id % 4 == 0)) for r in got if r.doc_id is not None and r.doc_id < 400]
    assert sum(a == b for a, b in hits) >= 396
    assert {r.predicted for r in got if r.doc_id is None or r.doc_id == 502} == {1}
    assert {r.predicted for r in got if r.doc_id in (500, 501)} == {0}
    untaught = toxicity.fit(docs, marks.limit(0))
    assert len(set(r.score for r in toxicity.score(docs, untaught).collect())) == 1
    assert toxicity.score(docs.limit(0), model).count() == 0


# ---- page extraction -------------------------------------------------------------------------


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";if(a<b)x()</script></head><body>
<header class=top><h1>Site</h1></header><nav><ul><li><a href=/a>Menu {n}<li>Two</ul></nav>
<div class="cookie-notice">We use cookies {n}</div><aside>Side {n}</aside>
<{main}><h2>Title {n}</h2><p>First&nbsp;&amp; <b>bold {n}<br>line<p>Second   paragraph {n}
<div>Follow us on the usual channels</div><!-- <p>no</p> --><div class='ad'>Buy {n}</div>
<blockquote>Quote {n}</blockquote></{main}>
<div id="comments"><p>Reader {n}</p></div><form><p>Mail</p></form><footer>&copy; {n}</footer>"""


def _expected(n):
    return f"Title {n}\n\nFirst & bold {n} line\n\nSecond paragraph {n}\n\nQuote {n}"


def test_wrapper_induction(spark):
    rows = [(i, f"https://User@Host.example:80/{i}", PAGE.format(n=f"number {i} " * 9, main="article"), 0) for i in range(9)]
    rows += [(20 + i, f"http://copies.example/{i}", PAGE.format(n="same", main="article"), 0) for i in range(6)]
    rows += [(40, "http://one.example/", PAGE.format(n="1", main="section"), 0), (41, None, None, 0), (42, "x", "", 0),
             (43, "http://one.example/b", "<p>" + "long text " * 30_000, 0), (44, "http://one.example/c", "a < b <x <!-- open", 0),
             (44, "http://one.example/c", "a < b <x <!-- open", 0), (None, "u", "<p>t", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    got = {r.page_id: r for r in html_extraction.extract(pages).collect()}
    for i in range(9):
        assert got[i].text == _expected(" ".join(["number", str(i)] * 9)), i
        assert got[i].n_chars == len(got[i].text)
    # copies of one page are no template of each other
    assert got[20].text == _expected("same").replace("\n\nQuote", "\n\nFollow us on the usual channels\n\nQuote")
    assert got[40].text.startswith("Title 1") and "Menu" not in got[40].text and "Reader" not in got[40].text
    assert (got[41].text, got[42].text, got[None].text) == ("", "", "t") and got[43].n_chars == len("long text " * 30_000) - 1
    assert html_extraction.extract(pages).count() == len(rows) and html_extraction.extract(pages.limit(0)).count() == 0


@given(st.lists(st.sampled_from(["<", ">", "p", "/", "div", "\"", "'", " ", "<p>", "</p>", "<li>", "<!--", "-->", "a", "&amp"]), max_size=60).map("".join))
@settings(max_examples=300, deadline=None)
def test_any_markup_is_read(page):
    assert isinstance(html_extraction.main_text(page), str)


def _plain_matching(a, b):
    """Simple tree matching as defined, every pair of children weighed."""
    if a.tag != b.tag or a.mark != b.mark:
        return 0
    if not a.tag and not a.children and not b.children:
        return 3 if a.text == b.text else 1
    table = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children):
        for j, y in enumerate(b.children):
            w = _plain_matching(x, y)
            table[i + 1][j + 1] = max(table[i][j] + w, table[i][j + 1], table[i + 1][j])
    return 1 + table[-1][-1]


markup = st.lists(st.sampled_from(["<div>", "</div>", "<p>", "<section>", "</section>", "x", "y", "<hr>", "<ul><li>", "</ul>"]), max_size=40).map("".join)


@given(markup, markup)
@settings(max_examples=300, deadline=None)
def test_tree_matching_equals_the_plain_version(left, right):
    a, b, pairs = html_extraction.parse(left), html_extraction.parse(right), []
    assert html_extraction.match_trees(a, b, pairs) == _plain_matching(a, b)
    weights = [3 if not x.tag and not x.children and not y.children and x.text == y.text else 1 for x, y in pairs]
    assert sum(weights) == _plain_matching(a, b)
    assert all(x.tag == y.tag and x.mark == y.mark for x, y in pairs)


@pytest.mark.parametrize("cells", [None, 3000])
def test_large_trees_are_matched_as_small_ones(monkeypatch, cells):
    """The largest matching of trees far beyond 2^14 pairs of nodes: pairs far off their place, few equal subtrees, and
    ways back too many to hold. Each node has one partner, and order and parentage are kept."""
    if cells:
        monkeypatch.setattr(html_extraction, "CELLS", cells)
    rng = random.Random(8)
    moved = rng.sample(range(200), 200)
    listed = "<li><div>name {0}</div><p>text {0}</p><ul><li>Reply<li>{1}</ul>"
    tokens = ["<div>", "</div>", "<p>", "<section>", "</section>", "x", "y", "<hr>", "<ul><li>", "</ul>"]
    cases = [
        ["<p>x</p>" * 150 + "<p>y</p>" * 80, "<p>y</p>" * 80 + "<p>x</p>" * 150],
        ["".join(f"<p>text {i}</p>" for i in places) for places in (range(200), moved)],
        ["".join(listed.format(i, i % kinds) for i in places if i < 70) for places, kinds in ((range(200), 7), (moved, 5))],
        *(["<body>" + "".join(rng.choices(tokens, k=900)) for _ in range(2)] for _ in range(4)),
    ]
    for left, right in cases:
        a, b, pairs = html_extraction.parse(left), html_extraction.parse(right), []
        assert html_extraction.match_trees(a, b, pairs) == _plain_matching(a, b) and a.size * b.size > 1 << 14
        assert sum(3 if not x.tag and not x.children and not y.children and x.text == y.text else 1 for x, y in pairs) == _plain_matching(a, b)
        partner = {id(x): y for x, y in pairs}
        place, above = ({id(n): i for i, n in enumerate(html_extraction._nodes(b))},
                        {id(c): id(n) for t in (a, b) for n in html_extraction._nodes(t) for c in n.children})
        met = [place[id(partner[id(n)])] for n in html_extraction._nodes(a) if id(n) in partner]
        assert met == sorted(set(met)) and len(met) == len(pairs)
        assert all(id(partner[above[id(x)]]) == above[id(y)] for x, y in pairs if id(x) in above)


@pytest.mark.parametrize("n", [2000, 5000])
def test_long_and_deep_pages(n):
    """Neither many paragraphs nor deep nesting stop a task, and constants are found on both ends and between."""
    def page(k):
        body = "".join(f"<p>text {k} {i}</p>" + ("<h4>constant middle</h4>" if i == n // 2 + k else "") for i in range(n))
        return f"<div><div>constant top</div>{body}<div>constant end</div></div>"

    wrapper = html_extraction._wrapper(html_extraction.induce([page(k) for k in range(4)]))
    blocks = html_extraction.main_text(page(7), wrapper).split("\n\n")
    assert blocks == [f"text 7 {i}" for i in range(n)]
    deep = [f"{'<div>' * n}banner<p>own words {k}{'</div>' * n}" for k in range(4)]
    wrapper = html_extraction._wrapper(html_extraction.induce(deep))
    assert html_extraction.main_text(deep[2], wrapper) == "own words 2" and html_extraction.main_text(deep[2]) == "banner\n\nown words 2"


def test_layouts_and_large_templates(spark):
    """Every layout of a host has a wrapper, also where template is most of a page; copies make none."""
    rng = random.Random(4)

    def own(n=12):
        return _words(rng, ["ka", "ro", "mi", "tu", "sel", "van", "dor"], n)

    texts = {i: own() for i in range(200)}
    rows = [(i, "http://two.example/", f"<body><div class=red><div>Banner of red</div><p>{texts[i]}</p></div>" if i % 2 else
             f"<body><section id=blue><p>{texts[i]}</p><div>Banner of blue</div></section>") for i in range(24)]
    large = "".join(f"<div>Template sentence number {j} that all pages of this host have</div>" for j in range(6))
    rows += [(i, "http://large.example/", f"<body>{large}<p>{texts[i]}</p>") for i in range(30, 54)]
    rare = "<div class=green><div>Banner of green</div><p>{}</p></div>"  # 5 of 105 pages
    rows += [(i, "http://rare.example/", f"<body>{rare.format(texts[i])}" if i < 65 else f"<body><main><p>{texts[i]}</p></main>") for i in range(60, 165)]
    article = "".join(f"<p>{own(20)}</p>" for _ in range(10))
    near = {i: article + f"<p>changed {texts[i]}</p>" for i in range(170, 180)}
    rows += [(i, "http://near.example/", f"<body>{near[i]}") for i in near]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extraction.extract(pages).collect()}
    for i in [*range(24), *range(30, 54), *range(60, 165)]:
        assert got[i] == texts[i], i
    for i, page in near.items():
        assert got[i] == page[3:-4].replace("</p><p>", "\n\n")


@pytest.mark.parametrize("page, text", [
    ("<p><a href=x>A long linked sentence of the article</a>.</p><ul><li><a href=y>Menu</a></ul>", "A long linked sentence of the article."),
    ("<article><p>One</p><section class=discussion><p>Two</p></section><section class='related-work'><p>Three</p></section>"
     "<div class=related-posts>No</div><div class=comments>No</div></article>", "One\n\nTwo\n\nThree"),
    ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> hold</p></article>", "Let x=1 hold"),
    ("<div class=discussion><p>No</p></div><p>Yes</p>", "Yes"),
])
def test_nothing_of_an_article_is_dropped(page, text):
    assert html_extraction.main_text(page) == text


def test_simple_tree_matching():
    a = html_extraction.parse("<div><p>x</p><ul><li>1<li>2</ul></div>")
    b = html_extraction.parse("<div><ul><li>1<li>3<li>2</ul><p>x</p></div>")
    pairs = []
    assert html_extraction.match_trees(a, a) == 1 + 1 + (1 + 3) + 1 + 2 * (1 + 3)
    # order forbids both the paragraph and the list; the list is larger
    assert html_extraction.match_trees(a, b, pairs) == 1 + 1 + 1 + 2 * (1 + 3)
    assert sorted(x.text for x, _ in pairs if x.text) == ["1", "2"]


# ---- n-gram join -----------------------------------------------------------------------------


@given(st.lists(st.lists(st.integers(0, 12), unique=True).map(sorted), max_size=14), st.integers(1, 8))
@settings(max_examples=400, deadline=None)
def test_divide_skip_against_counting(lists, least):
    lists = [x for x in lists if x]
    counts = defaultdict(int)
    for values in lists:
        for v in values:
            counts[v] += 1
    assert sorted(ngram_join.occurring(lists, least)) == sorted((k, n) for k, n in counts.items() if n >= least)


def _joined(texts):
    """Brute force over all pairs, on word tuples."""
    sets = {}
    for i, t in texts:
        words = (t or "").encode().lower().split()
        sets[i] = {tuple(words[k:k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed, n=160):
    """Copies, near copies on both sides of the threshold, shared passages, short texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(2000)}"
    bases = [[word() for _ in range(rng.randrange(1, 120))] for _ in range(12)]
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4, 6])):
            words[rng.randrange(len(words))] = word()
        if rng.random() < 0.2:
            words = [word() for _ in range(rng.randrange(30, 90))] + passage
        texts.append(" ".join(words).upper() if rng.random() < 0.2 else "\n".join(words))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_join_against_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "RESIDENTS_PER_BLOCK", 7)
    monkeypatch.setattr(ngram_join, "MEMBERS_PER_GROUP", 5)
    monkeypatch.setattr(ngram_join, "VISITORS_PER_PART", 3)
    monkeypatch.setattr(ngram_join, "FREQUENT", 6)
    if seed == 2:  # no likely relatives: all links by search; broadcasts refused
        monkeypatch.setattr(ngram_join, "_relatives", lambda c: c.selectExpr("node", "node as leader").limit(0))
        monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    texts = [*enumerate(corpus(seed)), (1000, None), (1001, ""), (1002, " \n"), (1003, "two words"), (1004, "TWO  words"), (1005, "x " * 30_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "'z' as node", "1 as n", "2 as hash")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_components(docs).collect()}
    assert got == _joined(texts)


def test_all_pages_of_a_layout_vote(spark):
    """Near copies do not keep a layout from its wrapper, however many there are and wherever their hashes lie."""
    shape = "<body><div class='top'><p>notice {n}</p></div><p>banner of the host</p><p>{text}</p><p>closing words</p></body>"
    near = " ".join(f"same{i}" for i in range(60))
    rows = [(k, "http://a.example/", shape.format(n=1, text=f"{near} {k}" + (" " + near) * 2)) for k in range(120)]
    rows += [(200 + k, "http://a.example/", shape.format(n=1, text=" ".join(f"own{k}w{i}" for i in range(40 + k)))) for k in range(4)]
    texts = {page: text.split("<p>")[3].split("</p>")[0] for page, _, text in rows}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extraction.extract(pages).collect()}
    assert all(got[k] == texts[k] for k in range(200, 204))


def test_pages_are_parsed_once_for_their_layout_and_their_host(spark, monkeypatch):
    """Votes on a layout's wrapper and on its host's come from one pass; layouts of few pages take the host's."""
    handed, plain = [], html_extraction.map_batches
    monkeypatch.setattr(html_extraction, "map_batches", lambda df, *rest: handed.append(df.columns) or plain(df, *rest))
    texts = {i: f"own words of page number {i} " * (1 + i % 5) for i in range(40)}
    shape = "<body><div><div>Banner of the host</div><div class=box{}><p>{}</p></div></div>"
    # boxes of 12, 12, 2 and 2 pages, and a host of one layout and two pages
    boxes = {i: i % 2 if i < 24 else 2 + i % 2 for i in range(28)}
    rows = [(i, "http://many.example/", shape.format(boxes[i], texts[i])) for i in boxes]
    rows += [(i, "http://few.example/", shape.format(9, texts[i])) for i in (30, 31)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    layouts = pages.select("page_id", html_extraction.layout_of(pages["html"]).alias("n")).collect()
    assert len({r.n for r in layouts}) == 5
    got = {r.page_id: r.text for r in html_extraction.extract(pages).collect()}
    for i in boxes:
        assert got[i] == texts[i].strip(), i
    assert got[30] == f"Banner of the host\n\n{texts[30].strip()}"
    assert sum("html" in columns for columns in handed) == 2  # votes, then texts


def test_elements_told_before_are_told_alike():
    """What is remembered of an element depends on its attributes and on whether it is inside an article."""
    page = "<div class=legal>No</div><article><div class=legal>Yes</div><div class=menu>No</div></article>"
    for _ in range(2):
        tree = html_extraction.parse(page)
        skips = [(n.tag, n.mark, n.inside, n.skip) for n in html_extraction._nodes(tree) if n.tag == "div"]
        assert skips == [("div", "legal", False, True), ("div", "legal", True, False), ("div", "menu", True, True)]
    every = "".join(map(chr, range(0x110000)))
    spaces = html_extraction.parse("x".join(c for c in every if c.isspace()))
    assert [n.text for n in spaces.children] == [" ".join("x" * (sum(map(str.isspace, every)) - 1))]


def test_join_visits_only_sets_of_like_size(spark, monkeypatch):
    """Documents that share a passage but differ much in size, or share one minimum, are not compared."""
    seen, plain = [], (ngram_join._relatives, ngram_join._search)
    monkeypatch.setattr(ngram_join, "RESIDENTS_PER_BLOCK", 7)
    monkeypatch.setattr(ngram_join, "_relatives", lambda c: seen.append(r := plain[0](c)) or r)
    monkeypatch.setattr(ngram_join, "_search", lambda sets, routes: seen.append(routes) or plain[1](sets, routes))
    passage = " ".join(f"p{i}" for i in range(14))
    texts = [(k, " ".join([passage, *(f"d{k}w{i}" for i in range(20 * 2 ** (k % 5)))])) for k in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_components(docs).collect()}
    assert got == _joined(texts)
    sizes = {k: n for k, (n, _) in got.items()}
    relatives, routes = (rows.collect() for rows in seen)
    assert all(0.5 < sizes[r.node] / sizes[r.leader] < 2 for r in relatives)
    for block in {r.block for r in routes}:
        here = [[sizes[r.node] for r in routes if r.block == block and r.role == role] for role in (0, 1)]
        assert all(3 * max(here[0]) >= 2 * n and 2 * min(here[0]) <= 3 * n for n in here[1])


def test_join_of_odd_rows(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (7, "A b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join_components(docs).collect()), key=str)
    assert got == [(5, 2, 5), (5, 2, 5), (7, 2, 5), (None, 2, None)]
    assert ngram_join.join_components(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, rng.randrange(101, 160)) for _ in range(80)] + [(7, 7), (300, 301)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[301] == 300
    assert {got[b] for a, b in links if a == 100} == {100}


# ---- pipeline and queries --------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(11)
    syllables = ["ka", "ro", "mi", "tu", "sel", "van"]
    texts = [_words(rng, syllables, rng.randrange(30, 90)) for _ in range(60)]
    texts = [t + "\nHome and contact" for t in texts]
    texts[10] = texts[3]
    texts[11] = texts[4].replace("\n", " x\n")
    item = _words(rng, syllables, 40)
    texts[12] += "\n" + item
    texts += ["?? 12 !!", "", None]
    rows = [(i, t, "aa", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = table(spark, str(tmp_path), "documents"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept["language_id"]) == set(range(60))
    assert not any("Home and contact" in t for t in kept["line_dedup"].values())
    brute = _joined(kept["line_dedup"].items())
    assert set(kept["ngram_join"]) == {i for i, (_, c) in brute.items() if i == c}
    assert set(kept["ngram_join"]) == set(range(60)) - {10, 11}
    assert set(kept["decontamination"]) == set(kept["ngram_join"]) - {12}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(kept["decontamination"])
    assert sum(r.length for r in packed) == sum({r.doc_id: r.doc_tokens for r in packed}.values())


@given_tables
@pytest.mark.parametrize("name", ["op1_ngram_join", "op5_language_id", "op6_html_extraction"])
def test_queries_on_the_given_tables(spark, name):
    rows = QUERIES[name](spark, SF_DIR).collect()
    if name == "op1_ngram_join":
        texts = [(r.doc_id, r.text) for r in table(spark, SF_DIR, "documents").collect()]
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == _joined(texts)
    if name == "op5_language_id":
        langs = {r.doc_id: r.lang for r in table(spark, SF_DIR, "documents").collect()}
        own = [r.lang_pred == langs[r.doc_id] for r in rows if r.held_out]
        assert sum(own) >= 0.95 * len(own)
    if name == "op6_html_extraction":
        assert all(r.n_chars == len(r.text) for r in rows) and any(r.text for r in rows)


def test_parameters():
    assert ngram_join.WORDS == 5 and (ngram_join.NUMERATOR, ngram_join.DENOMINATOR) == (75, 100)
    assert packing.WIDTH == 1024 and 0 < line_dedup.RATIO < 1
