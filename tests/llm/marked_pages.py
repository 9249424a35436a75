"""Pages marked by hand: what stands between ⟦ and ⟧ is an article's block, all else is not. Layouts and names vary."""

from __future__ import annotations

import html
import re

ONE = "The harbour was rebuilt in stone after the great storm, and the town grew around it within thirty years."
TWO = "Most families lived from fishing, although a few of them had begun to trade in timber with the north."
THREE = "When the railway came, the old market lost its place; nobody had asked the traders what they thought of it."
FOUR = "Today the warehouses hold workshops, a library and two small theatres."
NAV = '<ul><li><a href="/">Home</a><li><a href="/n">News</a><li><a href="/c">Contact us</a></ul>'
LINKS = '<a href="/a">Home</a> <a href="/b">About</a> <a href="/c">Archive</a> <a href="/d">Contact</a>'

PAGES = [
    f'<div class="col-8"><p>⟦{ONE}⟧</p><p>⟦{TWO}⟧</p><p>⟦{THREE}⟧</p><p>⟦{FOUR}⟧</p><p>⟦{ONE}⟧</p></div>',
    f"<html><body><p>⟦{ONE}⟧</p><p>⟦{TWO}⟧</p><p>⟦{THREE}⟧</p></body></html>",
    f"<p>⟦{ONE}⟧<p>⟦{TWO}⟧<p>⟦{THREE}⟧<p>⟦{FOUR}⟧",
    f"<body><article><h1>⟦A harbour town⟧</h1><p>⟦{ONE}⟧</p><p>⟦{TWO}⟧</p><ul><li>⟦stone⟧</li><li>⟦timber and tar⟧</li><li>⟦rope⟧</li></ul></article></body>",
    f"<body><nav>{NAV}</nav><article><header><h1>⟦A harbour town⟧</h1></header><p>⟦{ONE}⟧</p><p>⟦{TWO}⟧</p></article><footer>&copy; The town paper</footer></body>",
    f'<body><div class="content-related-text"><p>⟦{ONE}⟧</p><p>⟦{TWO}⟧</p></div><div class="footer">Imprint and terms</div></body>',
    f"<body><article><h1>⟦Sums⟧</h1><p>⟦The value <math><mi>x</mi>=5</math> holds here, as was shown before.⟧</p><p>⟦{TWO}⟧</p></article></body>",
    f"<body><header><div>The Town Paper</div><nav>{NAV}</nav></header><main><h1>⟦Old stones⟧</h1><p>⟦{ONE}⟧</p><h2>⟦Trade⟧</h2><p>⟦{THREE}⟧</p></main><aside><h3>Read next</h3>{NAV}</aside></body>",
    f'<body><div id="nav">{LINKS}</div><div id="post"><h2>⟦Old stones⟧</h2><p>⟦{ONE}⟧</p><blockquote>⟦We were not asked.⟧</blockquote><p>⟦{TWO}⟧</p></div><div id="comments"><h3>Two replies</h3><div class="comment"><p>Ann</p><p>I remember my grandfather telling me about that storm.</p></div><div class="comment"><p>Bo</p><p>Very nice text, thank you for it.</p></div></div></body>',
    f'<body><table><tr><td><ul class="menu"><li><a href="/1">One</a><li><a href="/2">Two</a></ul></td><td><p>⟦{ONE}⟧</p><p>⟦{THREE}⟧</p></td></tr></table></body>',
    f'<body class="home has-sidebar"><div class="wrap"><div class="entry"><p>⟦{ONE}⟧</p><p>⟦{FOUR}⟧</p></div><div id="sidebar"><h4>About</h4><p>We write on the history of small towns.</p></div></div></body>',
    f'<body><div class="cookie-notice"><p>We use cookies to make this site better. You can say no.</p></div><section><h1>⟦The railway⟧</h1><p>⟦{THREE}⟧</p><p>⟦{TWO}⟧</p></section></body>',
    f'<body><article><h1>⟦The railway⟧</h1><p>⟦{THREE}⟧</p><div class="ad">Buy two tickets and pay for one.</div><p>⟦{TWO}⟧</p></article></body>',
    f"<body><article><p>⟦{ONE}⟧</p><table><tr><th>⟦Year⟧</th><td>⟦1862⟧</td></tr><tr><th>⟦Ships⟧</th><td>⟦41⟧</td></tr></table></article></body>",
    f'<body><form action="/s"><label>Search</label><input name="q"><button>Go</button></form><main><p>⟦{ONE}⟧</p><p>⟦{TWO}⟧</p><p>⟦{THREE}⟧</p></main></body>',
    f'<body><div class="main-menu">{LINKS}</div><div class="row"><div class="col-md-12"><h1>⟦Workshops⟧</h1><div>⟦{FOUR}⟧</div><div>⟦{ONE}⟧</div></div></div><div id="footer"><p>All rights with the authors</p></div></body>',
    f'<body><main><article><h1>⟦Fish⟧</h1><p>⟦{TWO}⟧</p><footer>Posted in History</footer></article><section class="comments"><h2>Comments</h2><p>Well said, and I would like to read more.</p></section></main></body>',
    f'<body><div class="x7f3a"><div class="q1"><p>⟦{ONE}⟧</p><p>⟦Yes.⟧</p><p>⟦{THREE}⟧</p></div></div></body>',
    f"<body><article><h1>⟦Recipe⟧</h1><ol><li>⟦Clean the fish and salt it.⟧</li><li>⟦Let it rest for an hour.⟧</li><li>⟦Smoke it over alder wood.⟧</li></ol><p>⟦{FOUR}⟧</p></article></body>",
    f'<body><article><p>⟦{ONE}⟧</p><aside class="related"><h3>More</h3>{NAV}</aside><p>⟦{TWO}⟧</p><h2>⟦Sources⟧</h2></article></body>',
    f'<body><div class="masthead"><h1>Town Paper</h1><p>Every week since 1901</p></div><div class="story"><p>⟦{THREE}⟧</p><p>⟦{ONE}⟧</p></div><div class="newsletter"><p>Get our letter every Friday by post.</p></div></body>',
    f"<body><nav>{NAV}</nav><pre>⟦{ONE}⟧</pre><p>⟦{TWO}⟧</p></body>",
    f'<body><div class="articleBody"><h3>⟦Theatres⟧</h3><p>⟦{FOUR}⟧</p><p>⟦{TWO}⟧</p></div><div class="shareBar">Share this page with friends</div></body>',
    f'<body><div role="navigation">{LINKS}</div><div role="main"><p>⟦{ONE}⟧</p><p>⟦{FOUR}⟧</p></div><div role="contentinfo">Town Paper, 12 Quay Street</div></body>',
    f'<body><section id="intro"><h1>⟦A walk⟧</h1><p>⟦{FOUR}⟧</p></section><section id="more"><h2>⟦The quay⟧</h2><p>⟦{ONE}⟧</p><dl><dt>⟦Length⟧</dt><dd>⟦Four hundred metres⟧</dd></dl></section></body>',
    f'<body><a href=/x/>Skip</a><div class=menu>{LINKS}</div><div class=text><p>⟦{TWO}⟧</p><p>⟦{ONE}⟧</p></div></body>',
    f'<body><article class="post"><h1>⟦Rope⟧</h1><p>⟦{ONE}⟧</p><figure><img src="a"><figcaption>⟦The rope walk in 1880⟧</figcaption></figure><p>⟦{THREE}⟧</p></article><div class="promo"><p>Join the museum as a friend today.</p></div></body>',
    f'<body><header>Town Paper</header><nav>{NAV}</nav><aside><p>Weather: rain in the morning, dry later on.</p></aside><footer><p>Town Paper, 12 Quay Street</p></footer></body>',
    f'<body><div><div><div><p>⟦{TWO}⟧</p><p>⟦{THREE}⟧</p><p>⟦See also <a href="/q">the quay</a> and <a href="/r">the rope walk</a> for more on this.⟧</p></div></div></div></body>',
    f'<body><div id="header"><a href="/">Town Paper</a></div><div id="main"><div class="post"><h2>⟦Storm⟧</h2><p>⟦{ONE}⟧</p></div><div class="post"><h2>⟦Rails⟧</h2><p>⟦{THREE}⟧</p></div></div><div id="side">{NAV}</div></body>',
    f'<body><main><h1>⟦Tar⟧</h1><p>⟦{TWO}⟧</p><div class="notice">This text is older than ten years.</div><p>⟦{ONE}⟧</p><p>⟦{FOUR}⟧</p></main><div class="legal"><p>Terms apply to all use.</p></div></body>',
    f'<body><ul class="breadcrumbs"><li><a href="/">Home</a><li><a href="/h">History</a></ul><div class="page"><h1>⟦Timber⟧</h1><p>⟦{TWO}⟧</p><ul><li>⟦pine from the north⟧<li>⟦oak from the hills⟧</ul></div><footer>(c) 2020 Town Paper</footer></body>',
]


def page(marked: str) -> str:
    return marked.replace("⟦", "").replace("⟧", "")


def article_lines(marked: str) -> list[str]:
    """The article's lines as marked."""
    return [" ".join(html.unescape(re.sub("<[^>]*>", "", m)).split()) for m in re.findall("⟦(.*?)⟧", marked, re.S)]
