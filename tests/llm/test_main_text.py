import html.parser
import random

import pytest

from keystrata.llm.main_text import extract_main_text, main_text

ARTICLE = "<article><h1>Title &amp; more</h1><p>First para with <b>bold</b> and <a href=x>a link</a>.</p><p>Second\n  para&nbsp;here<br>after break &lt;tag&gt;</p></article>"
TEXT = "Title & more\nFirst para with bold and a link.\nSecond para here after break <tag>"
AROUND = "<nav><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></nav>{}<footer>&copy; site</footer>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("   ", ""), ("<html><body></body></html>", ""), ("plain words only", "plain words only"),
        (f"<html><body>{AROUND.format(ARTICLE)}</body></html>", TEXT),
        (f"<body>{AROUND.format('<!-- x --><div class=ad>Buy now</div>' + ARTICLE)}", TEXT),
        (f"<body><header><h1>Site</h1><p>slogan</p></header>{ARTICLE}<aside>side</aside><form><p>subscribe</p></form>", TEXT),
        (f"<body><script>if (a < b) x('</p>')</script><style>p>a{{}}</style>{ARTICLE}<div id='cookie-notice'><p>We use cookies</p></div>", TEXT),
        (f"<body><main>{ARTICLE}</main><section class='comments'><article class=comment><p>I liked this a lot and wrote a long comment about it.</p></article></section>", TEXT),
        (ARTICLE.replace("</article>", "<div class='reader-comments'><p>nice</p></div><div class='share'>tweet</div></article>"), TEXT),
        ("<article><p>open one<p>open two<ul><li>a point<li>b point</ul></article>", "open one\nopen two\na point\nb point"),
        ("<div><div class=body><h2>Head</h2><p>Long enough paragraph of plain text, one.</p><p>Long enough paragraph of plain text, two.</p></div><div class='sidebar'><p>x</p></div></div>", "Head\nLong enough paragraph of plain text, one.\nLong enough paragraph of plain text, two."),
        ("<div id=wrap><div class=topnav><p>Home page of ours</p></div><div><section><h2>One</h2><p>First section of the text, long enough.</p></section><section><h2>Two</h2><p>Second section of the text, long enough.</p></section><section><h2>Three</h2><p>Third section of the text, long enough.</p></section></div><div class=sitefooter><p>Imprint and more</p></div></div>", "One\nFirst section of the text, long enough.\nTwo\nSecond section of the text, long enough.\nThree\nThird section of the text, long enough."),
        ("<article><p>unclosed <b>bold<br><p>next</article>", "unclosed bold\nnext"),
        ("<article><p>x &am y &amp z &#x41;&#66;</article>", "x &am y & z AB"),
        ("<article><p>a</p><!-- never closed <p>b</p></article>", "a"),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(("sections", "paragraphs"), [(3, 8), (2, 4), (4, 12), (6, 20)])
def test_wrapped_sections_stay_whole(sections, paragraphs):
    texts = [f"{s}.{p} ".ljust(250, "w") for s in range(sections) for p in range(paragraphs)]
    parts = ["".join(f"<p>{t}</p>" for t in texts[s * paragraphs : (s + 1) * paragraphs]) for s in range(sections)]
    page = "<body>" + "".join(f"<section><div class=inner>{x}</div></section>" for x in parts) + "</body>"
    assert main_text(page) == "\n".join(texts)


@pytest.mark.parametrize("part", ["<table><tr><td>{}</td></tr></table>", "<pre>{}</pre>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<div>{}</div>"])
def test_dense_parts_without_paragraphs_stay(part):
    first, other, last = ("abc " * 60).strip(), ("def " * 75).strip(), ("ghi " * 75).strip()
    links = "".join(f"<p><a href={k}>link {k}</a></p>" for k in range(12))
    page = f"<body><div>{links}</div><div>{part.format(last)}<div>{part.format(other)}<div>" + f"<p>{first}</p>" * 8 + "</div></div></div></body>"
    assert main_text(page) == "\n".join([last, other, *[first] * 8])


P = ("Long enough paragraph of plain text in an article. " * 4).strip()
L = '<a href="/x">{}</a>'


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<article><p title="the hidden side">{P}</p><p>{P}</p></article>', f"{P}\n{P}"),
        (f'<article><p data-note="display: none">{P}</p><p aria-hidden=false>{P}</p><p hidden>{P}</p><div style="x:y;display :none">{P}</div></article>', f"{P}\n{P}"),
        (f'<article><h2 id="search-and-rescue">Search and rescue</h2><p>{P}</p></article>', f"Search and rescue\n{P}"),
        (f'<article><p class="market-share">{P}</p><p>{P}</p></article>', f"{P}\n{P}"),
        (f'<article><p>{P}</p><section id="related-work"><h2>Related work</h2><p>{P}</p></section></article>', f"{P}\nRelated work\n{P}"),
        (f"<article><p>{P}</p><ol><li>{L.format('Smith 2001')}<li>{L.format('Jones 2002')}</ol></article>", f"{P}\nSmith 2001\nJones 2002"),
        (f"<article><p>{P}</p><ul><li>{L.format('Smith, On the theory of texts')}<li>{L.format('Jones, An answer to Smith')}</ul></article>", f"{P}\nSmith, On the theory of texts\nJones, An answer to Smith"),
        (f"<article><p>{P}</p><ul><li>{L.format('News')}<li>{L.format('Mail')}</ul></article>", P),
        (f"<body><article><h1>One</h1><p>{P}</p></article><article><h1>Two</h1><p>{P}</p><p>{P}</p></article></body>", f"One\n{P}\nTwo\n{P}\n{P}"),
        (f'<body><div class="cookie-notice"><p>{P * 3}</p></div><div><p>{P}</p><p>{P}</p></div><div class="sidebar-left"><p>{P}</p></div></body>', f"{P}\n{P}"),
        (f"<body><article><p>{P}</p><p>{P}</p></article><div><p>{P}</p></div></body>", f"{P}\n{P}"),
        (f"<body><div><p>{P}</p></div><article>{L.format('Next')}</article><div><div>{L.format('a') * 9}</div><section><p>{P}</p><p>{P}</p><p>{P}</p></section></div></body>", "\n".join([P] * 4)),
    ],
)
def test_names_and_density_decide(page, text):
    assert main_text(page) == text


class Plain(html.parser.HTMLParser):
    """A separate, plain version for pages whose blocks are closed and whose boilerplate is marked by element or whole class."""

    def __init__(self):
        super().__init__()
        self.path, self.blocks = [], []

    def out(self):
        return any(t in ("head", "script", "style", "nav", "footer", "aside", "form") or c in ("ad", "sidebar", "comments", "cookie-notice") for t, c in self.path)

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.blocks and self.blocks[-1].append(" ")
            return
        self.path.append((tag, dict(attrs).get("class")))
        if tag not in ("b", "i", "a"):
            self.blocks.append([])

    def handle_endtag(self, tag):
        self.path.pop()
        if tag not in ("b", "i", "a"):
            self.blocks.append([])

    def handle_data(self, data):
        if self.blocks and not self.out():
            self.blocks[-1].append(data)


def test_against_a_separate_version_on_generated_pages():
    rng = random.Random(12)

    def sentence(n):
        return " ".join(rng.choice(["word", "other", "text &amp; more", "<b>bold</b>", "über", "x&lt;y", "<a href=1>one</a>"] if rng.random() < 0.1 else ["some", "plain", "words", "of", "prose\n", "here"]) for _ in range(n))

    for _ in range(60):
        body = "".join(rng.choice([f"<p>{sentence(rng.randint(25, 60))}</p>"] * 5 + [f"<ul><li>{sentence(25)}</li><li>{sentence(25)}</li></ul>", f"<blockquote>{sentence(40)}</blockquote>", f"<div class=ad>{sentence(8)}</div>", "<aside><p>side</p></aside>"]) for _ in range(rng.randint(3, 9)))
        text = rng.choice(["<article>{}</article>", "<main>{}</main>", "<div class=body>{}</div>", "<div><section>{}</section></div>"]).format(f"<h1>{sentence(5)}</h1>{body}<p>{sentence(40)}</p>")
        around = ["<nav><ul><li><a href=1>Home</a></li></ul></nav>", "<div class=sidebar><p>x y</p></div>", "<form><p>mail</p></form>", "<footer><p>end</p></footer>", f"<div class=comments><p>{sentence(30)}</p></div>", f"<div class=cookie-notice><p>{sentence(20)}</p></div>"]
        cut = rng.randint(0, 6)
        page = f"<html><head><title>t</title><style>p</style></head><body>{''.join(around[:cut])}{text}{''.join(around[cut:])}</body></html>"
        plain = Plain()
        plain.feed(page)
        want = [" ".join("".join(x).split()) for x in plain.blocks]
        assert main_text(page) == "\n".join(x for x in want if x)


def test_hostile_pages_end():
    assert main_text("<" * 3000)
    assert main_text("<div>" * 5000 + "x") == "x"
    assert main_text("<p " + "a='" * 3000) is not None
    assert len(main_text("<article>" + "<p>word word</p>" * 50_000)) == 50_000 * 10 - 1


def test_rows(make_pages):
    rows = [(1, "u", ARTICLE), (1, "u", ARTICLE), (2, None, None), (None, "v", "<p>a"), (3, "w", "")]
    got = sorted((tuple(r) for r in extract_main_text(make_pages(rows)).collect()), key=str)
    assert got == sorted([(1, "u", TEXT, len(TEXT)), (1, "u", TEXT, len(TEXT)), (2, None, "", 0), (None, "v", "a", 1), (3, "w", "", 0)], key=str)


def test_empty_table(make_pages):
    assert extract_main_text(make_pages([])).collect() == []
