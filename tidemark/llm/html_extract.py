"""Main text of web pages: a linear-chain CRF over the leaf blocks of the DOM."""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import session

#: Elements that end a run of text; all others are inline.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead tr ul".split()
)
#: Elements whose content is no text of the page.
SKIPPED_TAGS = frozenset("script style noscript template iframe object svg math title audio video canvas noframes xmp".split())
#: Elements that an opening tag of the same group closes.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Block elements without content.
EMPTY_TAGS = frozenset({"hr"})
#: Elements that end an open paragraph: all blocks but those that live inside text.
_PLAIN = frozenset({"div", "body", "html", "span"})

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[a-zA-Z/][^>]*(?:>|\Z)|(?P<text>[^<]+)|<",
    re.DOTALL,
)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WORDS = re.compile(r"[^\W\d_]+")
#: What notices, forms and the like say, in several languages: phrases of the labelled pages.
PHRASES = (
    "We use cookies to improve your experience", "Accept all cookies", "Accept all", "Reject all", "Manage preferences", "Privacy policy", "Terms of service", "All rights reserved", "Copyright 2024",
    "Subscribe to our newsletter", "Enter your email address", "Sign in", "Sign up", "Log in to comment", "Forgot your password", "Create an account", "Leave a reply", "Post a comment", "Read more comments",
    "Share this page", "Share on Facebook", "Follow us on Twitter", "Related articles", "Recommended for you", "You may also like", "Read more", "Load more", "Next page", "Previous page", "Back to top", "Skip to content",
    "Search this site", "Advertisement", "Sponsored content", "Download our app", "Contact us", "About us", "Site map", "Your cart is empty", "Show menu", "Print this page", "Report abuse",
    "Wir verwenden Cookies", "Alle akzeptieren", "Datenschutz", "Impressum", "Jetzt anmelden", "Passwort vergessen", "Werbung", "Alle Kommentare anzeigen", "Kommentar schreiben", "Weiterlesen", "Teilen",
    "Nous utilisons des cookies", "Tout accepter", "Mentions légales", "Connexion", "Publicité", "Laisser un commentaire", "Tous droits réservés", "Partager", "Abonnez-vous",
    "Utilizamos cookies", "Aceptar todo", "Aviso legal", "Publicidad", "Iniciar sesión", "Deja un comentario", "Todos los derechos reservados", "Compartir", "Suscribirse",
)
#: Their longer words: each is a feature of a short block, and training gives it its weight.
VOCABULARY = frozenset(w for phrase in PHRASES for w in _WORDS.findall(phrase.lower()) if len(w) > 4)


@dataclass
class Block:
    """A run of text: the elements around it and its words; ``linked`` characters stand in links."""

    path: tuple[tuple[str, ...], ...]
    text: str
    linked: int


@lru_cache(maxsize=65536)
def element_features(tag: str, attrs: str) -> tuple[str, ...]:
    """An element's tag and the words of its class, id and role."""
    out = [] if tag in _PLAIN else [f"tag={tag}"]
    for name, *values in _ATTR.findall(attrs):
        value = html.unescape("".join(values))
        kind = "role" if name.lower() == "role" else "name"
        out += sorted({f"{kind}={w.lower()}" for w in _NAME.findall(value)})
    return tuple(dict.fromkeys(out))


def blocks_of(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order, with white space collapsed and character references decoded."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    linked, links, skip = 0, 0, ""

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(tuple(f for _, f in stack), text, linked))
            pieces.clear()
        linked = 0

    page = page or ""
    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        if m["text"] is not None:
            text = html.unescape(m["text"])
            pieces.append(text)
            if links:
                linked += len(text.strip())
            continue
        if m["tag"] is None:
            if m[0] == "<":
                pieces.append("<")
            continue
        tag = m["tag"].lower()
        if m["close"]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCK_TAGS:
                flush()
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
            continue
        if tag in SKIPPED_TAGS:
            if not m["attrs"].endswith("/"):
                skip = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.IGNORECASE)
                close = skip.search(page, at)
                at = close.end() if close else end
            if tag not in ("svg", "math"):
                pieces.append(" ")
        elif tag == "a":
            links += 1
        elif tag == "br":
            pieces.append(" ")
        elif tag in BLOCK_TAGS:
            flush()
            links = 0
            if tag in CLOSES:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in CLOSES[tag]:
                        del stack[k:]
                        break
                    if stack[k][0] not in ("p", "dt", "dd", "td", "th", "li"):
                        break
            elif stack and stack[-1][0] == "p":
                stack.pop()
            if tag not in EMPTY_TAGS:
                stack.append((tag, element_features(tag, m["attrs"])))
    flush()
    return out


def text_features(block: Block, before: Block | None) -> list[str]:
    """Length, links, punctuation, words of the vocabulary, and whether the element changed."""
    text = block.text
    n = len(text)
    words = _WORDS.findall(text.lower()) if n < 200 else None
    out = ["bias", f"len={min(6, int(math.log2(n + 1)))}", f"link={min(3, 4 * block.linked // n)}"]
    if text[-1] in ".!?…。»”\"":
        out.append("sentence")
    if "©" in text or "(c)" in text.lower():
        out.append("copyright")
    if words:
        said = VOCABULARY.intersection(words)
        out += [f"word={w}" for w in sorted(said)]
        if 2 * sum(w in said for w in words) >= len(words):
            out.append("phrase")
    if block.path:
        out.append("in=" + (block.path[-1][0] if block.path[-1] else "plain"))
    if before is not None and before.path == block.path:
        out.append("same")
    return out


@dataclass(frozen=True)
class Crf:
    """Two labels, 0 boilerplate and 1 content: weights of label 1 against 0, and four transitions."""

    weights: dict[str, float]
    step: tuple[tuple[float, float], tuple[float, float]]

    def decode(self, scores: Sequence[float]) -> list[int]:
        """Viterbi: the most likely labels of a page."""
        if not scores:
            return []
        (t00, t01), (t10, t11) = self.step
        a, b = 0.0, scores[0]
        back = []
        for s in scores[1:]:
            x, y = (a + t00, 0) if a + t00 >= b + t10 else (b + t10, 1)
            z, k = (a + t01, 0) if a + t01 > b + t11 else (b + t11, 1)
            back.append((y, k))
            a, b = x, z + s
        label = int(b > a)
        out = [label]
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return out[::-1]

    def label(self, blocks: Sequence[Block]) -> list[int]:
        get = self.weights.get
        known: dict[tuple, float] = {}
        scores = []
        before = None
        for block in blocks:
            total = 0.0
            for features in block.path:
                if (s := known.get(features)) is None:
                    s = known[features] = sum(get(f, 0.0) for f in features)
                total += s
            scores.append(total + sum(get(f, 0.0) for f in text_features(block, before)))
            before = block
        return self.decode(scores)

    def extract(self, page: str | None) -> str:
        """The content blocks, joined by newlines."""
        blocks = blocks_of(page)
        return "\n".join(b.text for b, keep in zip(blocks, self.label(blocks), strict=True) if keep)


def all_features(blocks: Sequence[Block]) -> list[list[str]]:
    return [[f for fs in b.path for f in fs] + text_features(b, blocks[i - 1] if i else None) for i, b in enumerate(blocks)]


def fit(pages: Sequence[tuple[list[Block], list[int]]], rounds: int = 12, rate: float = 0.3, decay: float = 1e-3) -> Crf:
    """Maximum likelihood by AdaGrad on labelled pages; gradients from the forward-backward recursions."""
    data = [(all_features(blocks), labels) for blocks, labels in pages if blocks]
    weights: dict[str, float] = {}
    seen: dict[str, float] = {}
    step, step_seen = [[0.0, 0.0], [0.0, 0.0]], [[1e-6, 1e-6], [1e-6, 1e-6]]

    def add(x: float, y: float) -> float:
        return max(x, y) + math.log1p(math.exp(-abs(x - y)))

    for k in range(rounds):
        order = list(range(len(data)))
        random.Random(k).shuffle(order)
        for i in order:
            feats, labels = data[i]
            n = len(feats)
            s = [sum(weights.get(f, 0.0) for f in fs) for fs in feats]
            fwd = [(0.0, s[0])]
            for j in range(1, n):
                a, b = fwd[-1]
                fwd.append((add(a + step[0][0], b + step[1][0]), add(a + step[0][1], b + step[1][1]) + s[j]))
            bwd = [(0.0, 0.0)] * n
            for j in range(n - 2, -1, -1):
                c, d = bwd[j + 1]
                bwd[j] = (add(step[0][0] + c, step[0][1] + s[j + 1] + d), add(step[1][0] + c, step[1][1] + s[j + 1] + d))
            z = add(*fwd[-1])
            grad: dict[str, float] = {}
            for j in range(n):
                gap = math.exp(fwd[j][1] + bwd[j][1] - z) - labels[j]
                for f in feats[j]:
                    grad[f] = grad.get(f, 0.0) + gap
            moves = [[0.0, 0.0], [0.0, 0.0]]
            for j in range(1, n):
                for x in (0, 1):
                    for y in (0, 1):
                        moves[x][y] += math.exp(fwd[j - 1][x] + step[x][y] + (s[j] if y else 0.0) + bwd[j][y] - z) - (labels[j - 1] == x and labels[j] == y)
            for f, g in grad.items():
                g += decay * weights.get(f, 0.0)
                seen[f] = seen.get(f, 1e-6) + g * g
                weights[f] = weights.get(f, 0.0) - rate * g / math.sqrt(seen[f])
            for x in (0, 1):
                for y in (0, 1):
                    g = moves[x][y] + decay * step[x][y]
                    step_seen[x][y] += g * g
                    step[x][y] -= rate * g / math.sqrt(step_seen[x][y])
    return Crf(weights, (tuple(step[0]), tuple(step[1])))


# --- labelled pages -----------------------------------------------------------------------------

_CONTENT_SHELLS = (
    "<article>{}</article>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="main-content">{}</div>', '<div class="post-body">{}</div>',
    '<section class="entry-content">{}</section>', "<main>{}</main>", '<div class="article-text">{}</div>', '<div class="story">{}</div>', '<div role="main">{}</div>', "<article class=\"post\"><div class=\"text\">{}</div></article>", "{}",
)
_CONTENT_BLOCKS = ("<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<p>{}</p>", "<p>{}</p>", "<ul><li>{}</li><li>{}</li></ul>", "<blockquote>{}</blockquote>", "<h2>{}</h2>", "<pre>{}</pre>", "<figure><figcaption>{}</figcaption></figure>", "<table><tr><td>{}</td><td>{}</td></tr></table>", "<ol><li>{}<li>{}</ol>", '<p>{} <a href="/x">{}</a> {}</p>', "<div>{}</div>", "<dl><dt>{}</dt><dd>{}</dd></dl>")
#: Content blocks that only a named shell tells from menus.
_LINKED_BLOCKS = ('<ul><li><a href="/x">{}</a></li><li><a href="/y">{}</a></li></ul>', '<p><a href="/x">{}</a></p>', '<ol><li><a href="/x">{}</a> {}</li></ol>', '<p>{}<button>{w}</button></p>', '<p>{} <button>{w}</button> {}</p>')
_TOP = (
    '<table><tr><td><a href="/a">{w}</a></td><td><a href="/b">{w}</a></td><td><a href="/c">{w}</a></td></tr></table>', "<div><p>{n}</p><button>{n}</button></div>", "<div>{n}</div>", '<div><a href="/s">{n}</a> <a href="/t">{n}</a></div>',
    '<nav><ul><li><a href="/a">{w}</a></li><li><a href="/b">{w}</a></li></ul></nav>', '<header><div class="logo">{w}</div><p>{s}</p></header>', '<div class="menu"><a href="/">{w}</a> <a href="/2">{w}</a></div>',
    '<div class="ad">{s}</div>', '<div class="advert">{s}</div>', '<div class="cookie-notice"><p>{s}</p><button>{w}</button></div>', '<div id="header"><h2>{w}</h2></div>', '<div class="breadcrumbs"><a href="/">{w}</a></div>',
    '<form class="search"><label>{w}</label><button>{w}</button></form>', '<div role="navigation"><a href="/q">{w}</a></div>', '<div class="notice">{s}</div>', '<div id="top-banner">{s}</div>', '<div class="consent" role="dialog"><p>{s}</p></div>', '<div class="alert">{s}</div>',
)
_SIDE = (
    "<aside><h3>{w}</h3><p>{s}</p></aside>", '<div class="sidebar"><p>{s}</p><ul><li><a href="/r">{t}</a></li></ul></div>', '<div class="related"><a href="/r">{t}</a></div>', '<div class="sponsored">{s}</div>', '<div id="sidebar"><h3>{w}</h3><p>{s}</p></div>',
    '<div class="widget">{s}</div>', '<div class="promo"><p>{s}</p></div>', '<div class="share"><a href="/s">{w}</a></div>', '<aside class="ads">{s}</aside>', '<div class="newsletter"><form><p>{s}</p><label>{w}</label></form></div>', '<div class="social">{w}</div>',
)
_END = (
    "<div><p>{n}</p></div>", "<div><label>{n}</label><button>{n}</button></div>", '<ul><li><a href="/p">{n}</a></li><li><a href="/i">{n}</a></li></ul>', "<div><h3>{n}</h3><p>{s}</p></div>",
    "<footer>&copy; {w} &middot; {s}</footer>", '<div class="footer"><p>{s}</p></div>', '<div id="footer">&copy; 2024 {t}</div>', '<section class="comments"><h3>{w}</h3><div class="comment"><p>{s}</p></div><div class="comment"><p>{s}</p><p>{s}</p></div></section>',
    '<div id="comments"><ol class="comment-list"><li><p>{s}</p></li><li>{s}</li></ol></div>', '<div class="reader-comments"><p>{s}</p></div>', '<form><label>{w}</label><textarea>{s}</textarea><button>{w}</button></form>', '<div class="copyright">{s}</div>',
    '<div class="pagination"><a href="/2">2</a></div>', '<ul class="tags"><li><a href="/t">{w}</a></li></ul>', '<div class="disclaimer"><p>{s}</p></div>', '<footer><p>{s}</p><ul><li><a href="/c">{w}</a></li></ul></footer>', '<div class="replies"><p>{s}</p></div>',
)

#: Words that name boilerplate elements, roles and elements of it, and words that name content (the pages' vocabulary of markup).
_BOILER_NAMES = (
    "ad ads advert adverts advertisement adslot sponsor sponsored promo promotion banner billboard nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar widget widgets related recommended "
    "share sharing social follow cookie cookies consent gdpr privacy notice notices alert warning announcement newsletter subscribe subscription signup login register search form contact comment comments "
    "respond reply replies discussion disqus feedback reviews footer copyright legal disclaimer terms header masthead topbar toolbar logo tagline pagination pager tags categories meta popup modal overlay dialog skip sitemap"
).split()
_BOILER_ROLES = ("navigation", "banner", "complementary", "contentinfo", "search", "alert", "dialog", "menu", "form")
_BOILER_TAGS = ("nav", "aside", "footer", "form", "dialog", "menu", "header")
_CONTENT_NAMES = "content article post entry main story body text prose copy document chapter blog news page".split()
_WRAPS = ("<div {}><p>{{s}}</p></div>", "<div {}>{{s}}</div>", "<section {}><h3>{{w}}</h3><p>{{s}}</p><p>{{s}}</p></section>", "<div {}><ul><li><a href='/x'>{{t}}</a></li><li>{{s}}</li></ul></div>", "<p {}>{{s}}</p>", "<div {}><div><b>{{w}}</b><p>{{s}}</p></div></div>")


def labelled_pages(n: int = 800, seed: int = 5, fold: int | None = None, held: bool = False) -> list[str]:
    """Pages made of templates; the marks U+0001 and U+0002 stand around each content text.

    Their prose is made of syllables, so only structure, shape and the phrases
    of notices can be learned. Boilerplate runs to whole sentences, stands
    before, after and within the content, and content may be short, linked or
    in lists. With ``fold`` (0 to 3) a quarter of all shells, templates and
    element names is left out, or with ``held`` used alone: then no page is made
    like one of the others.
    """
    rng = random.Random(seed)

    def part(items: Sequence[str]) -> list[str]:
        return [x for k, x in enumerate(items) if fold is None or (k % 4 == fold) == held]

    shells, blocks, linked, top, side, end, wraps = map(part, (_CONTENT_SHELLS, _CONTENT_BLOCKS, _LINKED_BLOCKS, _TOP, _SIDE, _END, _WRAPS))
    comments = part([t for t in _END if "comment" in t or "repl" in t])
    boiler_names, boiler_roles, boiler_tags, content_names = map(part, (_BOILER_NAMES, _BOILER_ROLES, _BOILER_TAGS, _CONTENT_NAMES))
    syllables = [a + b for a in "bdfgklmnprstvw" for b in ("a", "e", "i", "o", "an", "er", "is", "é", "ö")]

    vocabulary = sorted(VOCABULARY)

    def word() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.choice((1, 2, 2, 3))))

    def sentence(most: int = 25) -> str:
        words = [word() for _ in range(rng.randint(1, most))]
        if len(words) > 5 and rng.random() < 0.1:  # a word of the notices says little in a sentence
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        return " ".join(words).capitalize() + "."

    def prose() -> str:
        text = " ".join(sentence() for _ in range(rng.choice((1, 1, 2, 3, 5))))
        return text if rng.random() < 0.7 else text[:-1] + rng.choice(("", "", ":", ";", "%", ")"))

    def phrase() -> str:
        return rng.choice(PHRASES) + rng.choice(("", "", ".", "!", "?"))

    def boiler(template: str) -> str:
        for mark, make in (("{w}", word), ("{s}", prose), ("{t}", lambda: sentence(6)[:-1]), ("{n}", phrase)):
            while mark in template:
                template = template.replace(mark, make(), 1)
        return template

    def named_boiler() -> str:
        kind = rng.random()
        if kind < 0.15:
            tag = rng.choice(boiler_tags)
            return boiler(f"<{tag}><p>{{s}}</p></{tag}>" if rng.random() < 0.5 else f"<{tag}>{{s}}</{tag}>")
        if kind < 0.3:
            mark = f'role="{rng.choice(boiler_roles)}"'
        else:
            name = rng.choice(boiler_names)
            name += rng.choice(("", "", "-" + rng.choice(("box", "area", "wrap", "inner", "list", "1")), "_" + rng.choice(boiler_names)))
            mark = rng.choice(('class="{}"', 'id="{}"', 'class="box {}"')).format(rng.choice(("", "", "site-", "page-", "user-")) + name)
        return boiler(rng.choice(wraps).format(mark))

    def content_block(named: bool) -> str:
        if named and rng.random() < 0.06:  # an article may say what notices say
            return f"<p>\u0001{phrase()}\u0002</p>"
        template = boiler(rng.choice(linked if named and rng.random() < 0.15 else blocks))
        while "{}" in template:
            template = template.replace("{}", f"\u0001{prose() if rng.random() < 0.8 else sentence(3)}\u0002", 1)
        return template

    pages = []
    for _ in range(n):
        shell = rng.choice(shells) if rng.random() < 0.6 else f'<div class="{rng.choice(content_names)}{rng.choice(("", "-" + rng.choice(content_names)))}">{{}}</div>'
        inner = [f"<h1>\u0001{sentence(9)}\u0002</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.randint(1, 9)):
            inner.append(content_block(shell != "{}"))
            if rng.random() < 0.12:
                inner.append(boiler(rng.choice(side)))
        if rng.random() < 0.2:
            inner.append(boiler(rng.choice(comments)))
        parts = [boiler(t) for t in rng.sample(top, rng.randint(0, 3))] + [named_boiler() for _ in range(rng.randint(0, 4))]
        body = shell.format("".join(inner))
        parts += [boiler(rng.choice(side))] * (rng.random() < 0.3) + [body] + [boiler(t) for t in rng.sample(side, rng.randint(0, 2))] + [boiler(t) for t in rng.sample(end, rng.randint(0, 3))] + [named_boiler() for _ in range(rng.randint(0, 3))]
        page = f"<html><head><title>{sentence(5)}</title><style>p{{}}</style></head><body>{''.join(parts)}"
        pages.append(page if rng.random() < 0.2 else page + "</body></html>")
    return pages


def labelled_blocks(page: str) -> tuple[list[Block], list[int]]:
    """A marked page's blocks without the marks, and their labels."""
    blocks = blocks_of(page)
    labels = [int("\u0001" in b.text or "\u0002" in b.text) for b in blocks]
    for b in blocks:
        b.text = " ".join(b.text.replace("\u0001", "").replace("\u0002", "").split())
    return blocks, labels


@lru_cache(maxsize=4)
def trained(n: int = 800, seed: int = 5) -> Crf:
    """The CRF fitted on :func:`labelled_pages`."""
    return fit([labelled_blocks(page) for page in labelled_pages(n, seed)])


def extract_pages(pages: DataFrame, model: Crf | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: page_id, url, text (empty if none), n_chars.

    A map over whole pages without a shuffle; the model is a few hundred weights.
    Null html counts as empty; broken and cut-off markup is read as far as it
    goes; repeated rows give repeated results; other columns are ignored.
    """
    session(pages)
    crf = model or trained()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [crf.extract(page) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col)).mapInArrow(extract, "page_id long, url string, text string, n_chars long")
