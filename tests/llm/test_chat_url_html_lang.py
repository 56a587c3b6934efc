import hashlib
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import chat, html_extract, language_id, url_filter
from tidemark.llm.common import Scratch, table
from tidemark.llm.queries import HOSTILE, URL_RULES, op6_html_extraction, op8_url_filter, op9_chat_format

BITS = st.lists(st.sampled_from([*chat.CONTROLS, "\\", " ", "x", "<", "[", "\n", "é"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool"]) | BITS, BITS), max_size=5))
def test_template_is_reversible(turns):
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    assert all(c not in chat.escape(t) for _, t in turns for c in chat.CONTROLS)


def paths_of(nodes):
    """All root-to-leaf paths by brute force: {tree: [(score, path)]}."""
    out = {}
    for tree in {n[0] for n in nodes}:
        known = {n[1]: n for n in nodes if n[0] == tree}
        parents = {n[2] for n in known.values() if n[2] in known}
        for leaf in known:
            path, at = [], leaf
            while at in known and at not in path:
                path.append(at)
                at = known[at][2]
            if leaf not in parents and at not in path:
                out.setdefault(tree, []).append((sum(known[x][3] or 0 for x in path), path[::-1]))
    return out


def test_reply_trees_against_brute_force(spark):
    import random

    rng = random.Random(4)
    nodes = [(t, i, rng.randrange(i) if i and rng.random() < 0.95 else None, float(rng.randrange(5))) for t in range(6) for i in range(40)]
    nodes += [(9, i, i - 1 if i else None, 1.0) for i in range(70)]  # deep
    nodes += [(10, 1, 2, 1.0), (10, 2, 1, 1.0), (10, 3, 1, 1.0), (11, 5, 77, None)]  # a cycle; an unknown parent
    df = spark.createDataFrame(nodes, "tree long, node long, parent long, score double")
    got = {}
    for r in chat.ranked_paths(df, Scratch(spark, "t"), keep=None).collect():
        got.setdefault((r.tree, r["rank"]), []).append((r.pos, r.node))
    want = paths_of(nodes)
    assert 10 not in want
    seen = {}
    for (tree, rank), path in got.items():
        assert [p for p, _ in sorted(path)] == list(range(len(path)))
        seen.setdefault(tree, []).append((rank, [n for _, n in sorted(path)]))
    for tree, paths in want.items():
        order = [p for _, p in sorted(paths, key=lambda x: (-x[0], -len(x[1]), x[1][-1]))]
        assert [p for _, p in sorted(seen[tree])] == order
    best = chat.ranked_paths(df, Scratch(spark, "t"), keep=1)
    assert {r["rank"] for r in best.collect()} == {1}


def test_conversations_against_brute_force(spark, sf_dir):
    convs = {-1: [("user", HOSTILE), ("assistant", HOSTILE)]}
    for r in table(spark, sf_dir, "conversations").orderBy("conv_id", "turn").collect():
        convs.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    got = {r.conv_id: r for r in op9_chat_format(spark, sf_dir).collect()}
    assert got.keys() == convs.keys()
    for c, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_odd_conversations(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (1, 1, "user", ""), (2, None, "assistant", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.digests(chat.format_trees(chat.linear_trees(turns), Scratch(spark, "t"))).collect()}
    assert out[1].n_turns == 3 and out[1].loss_chars == 0 and out[2].loss_chars == 1
    assert chat.format_trees(chat.linear_trees(turns.limit(0)), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("broadcast", ["10485760", "-1"])
def test_turns_without_an_id_are_one_conversation(spark, broadcast):
    rows = [(None, 2, "assistant", "b"), (None, 1, "user", "a"), (0, 1, "user", "c"), (None, 3, "user", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        out = {r.tree: r.formatted for r in chat.format_trees(chat.linear_trees(turns), Scratch(spark, "t")).collect()}
        trees = [(None, 1, None, 0.0), (None, 2, 1, 1.0), (None, 3, 1, 2.0), (None, 4, 3, None), (0, 1, None, 0.0)]
        paths = chat.ranked_paths(spark.createDataFrame(trees, "tree long, node long, parent long, score double"), Scratch(spark, "t"), keep=None)
        got = sorted(((r.tree is None, r["rank"], r.pos, r.node) for r in paths.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert out == {None: chat.render([("user", "a"), ("assistant", "b"), ("user", None)])[0], 0: chat.render([("user", "c")])[0]}
    assert got == [(False, 1, 0, 1), (True, 1, 0, 1), (True, 1, 1, 3), (True, 1, 2, 4), (True, 2, 0, 1), (True, 2, 1, 2)]


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    k = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    path = rest[k:]
    path = path[: next((i for i, c in enumerate(path) if c in "?#"), len(path))]
    return rest[:k].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), path


URLS = [None, "", "x", "://", "http://", "HTTP://A.Example.COM/en/7x?y#z", "http://example.com/en/6", "http://com/en/", "http://xcom/en/", "http://a.example.net/de/8", "http://a.example.net/de/7", "http://b.org?x=/es/", "http://b.org/es/#a", "ftp://é.org/es/a://b", "http://a#b/en/", "a\n://b.com/en/\nx"]


def test_rules_against_brute_force(spark):
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id long, url string, rule string")
    for r in url_filter.judge(df, URL_RULES).collect():
        host, path = host_path(URLS[r.page_id])
        fits = [x for x in URL_RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.name), default=None)
        assert (r.host, r.path, r.rule) == (host, path, best and best.name)
        assert r.verdict == (best.verdict if best else "block" if r.score >= 0.5 else "allow")
    assert url_filter.judge(df.limit(0), URL_RULES).count() == 0


def right(model, rows):
    w, b = model
    return sum((w[f].sum() / len(f) ** 0.5 + b >= 0) == bool(y) for h, p, y in rows for f in [url_filter.features(h, p)])


def test_model_on_held_out_hosts():
    """Five folds of whole host names: no URL of a judged host is trained on."""
    rows = url_filter.LABELLED
    hosts = sorted({h for h, _, _ in rows})
    found = 0
    for fold in range(5):
        held = set(hosts[fold::5])
        found += right(url_filter.train([r for r in rows if r[0] not in held]), [r for r in rows if r[0] in held])
    assert len(hosts) == 238 and found >= 0.9 * len(rows)


def test_labelled_table_has_no_host_of_the_pages(spark, sf_dir):
    given = {host_path(r.url)[0] for r in table(spark, sf_dir, "pages").select("url").collect()}
    names = {part for h in given for part in h.split(".")} - {"", "com", "org", "net", "www"}
    assert not given & {h for h, _, _ in url_filter.LABELLED}
    assert not names & {part for h, _, _ in url_filter.LABELLED for part in h.split(".")}


def test_url_query_against_brute_force(spark, sf_dir):
    """Host, path, rule and verdict of every page, by plain Python."""
    w, b = url_filter.train(url_filter.LABELLED)
    urls = {r.page_id: r.url for r in table(spark, sf_dir, "pages").collect()}
    rows = op8_url_filter(spark, sf_dir).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path = host_path(urls[r.page_id])
        fits = [x for x in URL_RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.name), default=None)
        model = "block" if right((w, b), [(host, path, 1)]) else "allow"
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best and best.name, best.verdict if best else model)


def test_crf_on_held_out_templates():
    model = html_extract.trained()
    errors = total = 0
    for page in html_extract.labelled_pages(150, seed=77):
        blocks, labels = html_extract.labelled_blocks(page)
        errors += sum(a != b for a, b in zip(model.label(blocks), labels, strict=True))
        total += len(blocks)
    assert errors <= 0.01 * total


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("<p></p>", ""), ("<html><body><article><p>One  &amp;\n two&nbsp;<b>th</b>ree.<p>Four &lt; five &am", "One & two three.\nFour < five &am"),
        ("<body><nav><a href='/'>Home</a></nav><article><h1>Title of it</h1><p>Some text is here.</p></article><footer>&copy; x</footer>", "Title of it\nSome text is here."),
        ("<article><p>Left text.<script>var a='</p>';<!-- </script> right text.</p><style>p{}</style><!-- <p>no</p> --></article>", "Left text. right text."),
        ("<body><article><h1>T is it</h1><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul><p>Text here is long enough.</p></article>", "T is it\nOne\nTwo\nText here is long enough."),
        ("<article><p>Some text before <button>Click</button> and after.</p></article>", "Some text before\nand after."),
        ("<body><div><p>We use cookies.</p><button>Accept all</button></div><article><p>Some text of it is here.</p></article></body>", "Some text of it is here."),
        ("<table><tr><td><a href='/a'>Home</a></td><td><a href='/b'>News</a></td></tr></table><div class=content><p>This is the text of the page, it is long.</p></div>", "This is the text of the page, it is long."),
        ("<article><p>A sentence.</p></article><section class='comments'><p>First reader says this.</p></section>", "A sentence."),
    ],
)
def test_extraction_cases(page, want):
    assert html_extract.trained().extract(page) == want


def test_viterbi_is_the_best_labelling():
    from itertools import product

    model = html_extract.Crf({}, ((0.3, -1.0), (-0.4, 0.8)))
    for scores in ([0.1, -0.7, 2.0, -0.2, 0.4], [-0.5], []):
        value = lambda y: sum(s for s, k in zip(scores, y, strict=True) if k) + sum(model.step[a][b] for a, b in zip(y, y[1:], strict=False))
        assert value(model.decode(scores)) == max(map(value, product((0, 1), repeat=len(scores))))


@pytest.mark.parametrize("fold", range(4))
def test_crf_on_pages_of_other_templates(fold):
    """A quarter of all shells, templates and element names is in no training page, the test pages have no others."""
    model = html_extract.fit([html_extract.labelled_blocks(page) for page in html_extract.labelled_pages(300, fold=fold)])
    errors = total = 0
    for page in html_extract.labelled_pages(150, seed=77, fold=fold, held=True):
        blocks, labels = html_extract.labelled_blocks(page)
        errors += sum(a != b for a, b in zip(model.label(blocks), labels, strict=True))
        total += len(blocks)
    assert errors <= 0.2 * total


class Article(HTMLParser):
    """The text of ``<article>`` by the standard library's parser, a line per paragraph or heading."""

    def __init__(self, page):
        super().__init__()
        self.lines, self.inside = [[]], False
        self.feed(page or "")
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("p", "h1", "article"):
            self.lines.append([])
        if tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if tag in ("p", "h1"):
            self.lines.append([])

    def handle_data(self, data):
        if self.inside:
            self.lines[-1].append(data)

    @property
    def text(self):
        lines = (" ".join("".join(line).split()) for line in self.lines)
        return "\n".join(line for line in lines if line)


def test_pages_table(spark, sf_dir):
    """Every page's text equals its article's, and no other text is given."""
    want = {r.page_id: (r.url, Article(r.html).text) for r in table(spark, sf_dir, "pages").collect()}
    rows = op6_html_extraction(spark, sf_dir).collect()
    assert {r.page_id: (r.url, r.text) for r in rows} == want and len(rows) == len(want)
    assert all(r.n_chars == len(r.text) for r in rows)


def test_languages_of_held_out_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = language_id.identify(docs).where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.98 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_language_edge_cases(spark, docs):
    rows = [(i, "the house is of the and with this", "en", None, None) for i in range(8)] + [(20 + i, "la casa es de los que con una", "es", None, None) for i in range(8)]
    rows += [(40, None, "en", None, None), (41, "", None, None, None), (42, "12 $$ !!", "es", None, None), (None, "the house", None, None, None), (43, "the house " * 20000, None, None, None)]
    out = {r.doc_id: r for r in language_id.identify(docs(rows)).collect()}
    assert [out[k].lang_pred for k in (40, 41, 42, None, 43, 0, 20)] == ["und", "und", "und", "en", "en", "en", "es"]
    assert language_id.identify(docs([])).count() == 0
    alone = language_id.identify(docs(rows).withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in alone] == ["und"]
    assert {r.doc_id for r in language_id.reject(docs(rows)).collect()} == {*range(8), *range(20, 28), None, 43}


def test_numbers_are_no_letters(spark, docs):
    rows = [(i, "the house is of the and with this", "en", None, None) for i in range(8)] + [(20 + i, "la casa es de los que con una", "es", None, None) for i in range(8)]
    odd = {100: "½ ²", 101: "① Ⅻ", 102: "_ 7 ١", 103: "½ é", 104: "中"}
    out = {r.doc_id: r for r in language_id.identify(docs(rows + [(k, t, "es", None, None) for k, t in odd.items()])).collect()}
    assert [(out[k].lang_pred == "und", out[k].score == 0) for k in odd] == [(True, True)] * 3 + [(False, False)] * 2


def test_rejection_keeps_the_callers_columns(spark, docs):
    rows = [(i, "the house is of the and with this", "en", None, None) for i in range(8)] + [(20 + i, "la casa es de los que con una", "es", None, None) for i in range(8)]
    names = ("score", "held_out", "Lang_Pred", "a.b")
    wide = docs(rows)
    for n in names:
        wide = wide.withColumn(n, F.concat(F.lit(n), "doc_id"))
    kept = language_id.reject(wide)
    assert kept.columns == wide.columns and kept.count() == 16
    assert all(r[n] == f"{n}{r.doc_id}" for r in kept.collect() for n in names)
    assert language_id.identify(wide).columns == [c for c in wide.columns if c not in names[:3]] + ["lang_pred", "score", "held_out"]
