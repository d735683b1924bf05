import html
import random
import re

from hyperloom.llm import html_text
from hyperloom.llm.html_text import main_text

PROSE = "The river runs to the sea and it is said that the old town on the hill was built for those who came with the first boats in spring."


def test_given_pages_are_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", " ", inner))).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


def test_parts_that_are_no_article():
    page = f"""<!doctype html><html><head><title>x</title><style>p{{}}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
    <div class="cookie-notice"><p>{PROSE}</p></div><nav><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></nav><script>var a = "<p>{PROSE}</p>";</script>
    <main><article id=main-article><header><h1>Short &lt;title&gt;</h1></header><p>{PROSE}<br>Tail&nbsp;here <a href="x>y">link</a>.<p>Be.</p><form><p>{PROSE}</p></form>
    <aside><p>{PROSE}</p></aside><div class="advert">{PROSE}</div><p>{PROSE.upper()}</p><!-- <p>hidden</p> --></article>
    <section id="comments"><article><p>{PROSE}</p></article></section></main><footer>&copy; {PROSE}</footer></body></html>"""
    assert main_text(page) == f"Short <title> {PROSE} Tail here link. Be. {PROSE.upper()}"


def test_pages_without_an_article():
    page = f"<body><div id=menu>Home | About</div><div><h2>Heading</h2><p>{PROSE}</p><p>Yes.</p></div><ul><li><a href=1>one two three four</a></li></ul><div role='contentinfo'>{PROSE}</div>"
    assert main_text(page) == f"Heading {PROSE} Yes."
    assert main_text("<p>Hello   there</p>\n<p>you</p>") == "Hello there you" and main_text("plain &amp; simple") == "plain & simple"


def test_odd_pages(spark):
    for page in (None, "", "<", "<p", "<script>x", "<!-- never ends <p>x</p>", "<div class='x>" * 50, "</p></div>", "<style>a"):
        assert main_text(page) in ("", "<", "<p", "<div class='x>" * 50, " ".join(["<div class='x>"] * 50)), page
    assert main_text("<p>a<b>b</b>c &#233;&eacute; &unknown; &am") == "abc éé &unknown; &am"
    rng = random.Random(1)
    for _ in range(200):
        main_text("".join(rng.choice(["<p>", "</p>", "<div>", "</div>", "<a ", "href='", ">", "<", "\"", "x y ", "&", "<script>", "</article>", "<article>", "<!--", "-->"]) for _ in range(60)))
    long = "<article>" + "".join(f"<p>{PROSE}</p>" for _ in range(4000)) + "</article>"
    assert main_text(long) == " ".join([PROSE] * 4000)
    df = spark.createDataFrame([(1, None, "t"), (1, "<p>x</p>", "t")], "page_id long, html string, Text string")
    assert sorted(r.text for r in html_text.extract(df).collect()) == ["", "x"] and html_text.extract(df.limit(0)).count() == 0


def test_anchors_without_an_end_or_an_address():
    lead, tail = PROSE + " One.", PROSE + " Two."
    assert main_text(f'<article><p><a name="x">{lead}</p><p>{tail}</p></article>') == f"{lead} {tail}"
    assert main_text(f'<article><p>{lead}</p><p><a href="x">Go on</p><p>{tail}</p></article>') == f"{lead} {tail}"
    assert main_text(f'<article><p>{lead}</p><p><a href="x">Go on <b>there</b></a></p><p>{tail}</p></article>') == f"{lead} {tail}"


def test_an_articles_own_head_captions_and_formulas_stay():
    page = f'<header class="site-header">Site</header><article><div class="entry-header"><h1>Title of it</h1></div><p>{PROSE}</p><figure><figcaption>A boat.</figcaption></figure><p>So <math><mi>x</mi></math> is {PROSE}</p></article>'
    assert main_text(page) == f"Title of it {PROSE} A boat. So x is {PROSE}"
    assert main_text(f'<div class="page-header">Site</div><div class="post"><div class="post-header"><h1>Title of it</h1></div><p>{PROSE}</p></div>') == f"Title of it {PROSE}"


def test_deep_pages_take_linear_time():
    import time

    began = time.time()
    assert main_text("<div>" * 100_000 + PROSE + "</div>" * 100_000) == PROSE
    assert main_text("<p>" + "</b></i>" * 100_000 + PROSE) == PROSE and time.time() - began < 6


# pages labelled by hand: (page, the article's blocks, what else it says)
LABELLED = [
    (f"<body><nav>Home News</nav><main><h1>Old boats</h1><p>{PROSE}</p><p>They sank.</p><ul><li>First, the mast and the sail of it.</li><li>Then the rest.</li></ul></main><footer>All rights reserved</footer>", ["Old boats", PROSE, "They sank.", "First, the mast and the sail of it.", "Then the rest."], ["Home News", "All rights reserved"]),
    (f"<table><tr><td class=sidebar><a href=1>Link one</a></td><td><h2>Bread</h2>{PROSE}<br><br>Bake it well.</td></tr></table><div class='ad-slot'>Buy now</div>", ["Bread", PROSE, "Bake it well."], ["Link one", "Buy now"]),
    (f"<div id=content><div class=post-body><p>{PROSE}<p>Short one.<blockquote>{PROSE} quoted</blockquote></div><div id=comments><p>{PROSE} I say</p></div><form>Name <input></form></div>", [PROSE, "Short one.", PROSE + " quoted"], [PROSE + " I say", "Name"]),
    (f"<article><h1>Les bateaux</h1><p>Le fleuve va vers la mer et on dit que la vieille ville est pour ceux qui sont venus avec les bateaux.</p><div class='related'><a href=2>Voir aussi</a></div></article><div role=dialog class=cookie-banner>Nous utilisons des cookies pour vous</div>", ["Les bateaux", "Le fleuve va vers la mer et on dit que la vieille ville est pour ceux qui sont venus avec les bateaux."], ["Voir aussi", "Nous utilisons des cookies pour vous"]),
    (f"<header><h1>Site</h1><p>{PROSE} of the site</p></header><section><h2>Part</h2><p>{PROSE}</p><pre>x = 1</pre><p>{PROSE} again</p></section><aside>{PROSE} aside</aside>", ["Part", PROSE, "x = 1", PROSE + " again"], [PROSE + " of the site", PROSE + " aside"]),
]


def test_precision_and_recall_on_labelled_pages():
    good = bad = missed = 0
    for page, article, other in LABELLED:
        text = main_text(page)
        for x in sorted(other, key=len, reverse=True):
            bad += x in text
            text = text.replace(x, "\0")
        for x in sorted(article, key=len, reverse=True):
            found = x in text
            good, missed, text = good + found, missed + (not found), text.replace(x, "\0", 1)
    assert good / (good + missed) >= 0.9 and good / (good + bad) >= 0.9, (good, bad, missed)
