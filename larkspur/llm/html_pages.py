"""Labelled pages from which the extraction weights are learned.

Each page is a list of (region, html): region 1 is main content, 0 is not.
They are written for this library and cover common page layouts: semantic
elements, layouts built of classes only, and pages with neither.  Names that
pages give to the parts beside an article, and to the article itself, label
blocks in pages of one pattern each.
"""

from __future__ import annotations

_HEAD = '<!DOCTYPE html><html><head><meta charset="utf-8"><title>Page title words</title><style>p{margin:0}</style><script>var a=1;</script></head><body>'
_MENU = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">About us</a></li><li><a href="/d">Contact</a></li></ul></nav>'
_FOOT = "<footer><p>&copy; 2020 Some Company, all rights reserved.</p><ul><li><a>Terms</a></li><li><a>Privacy</a></li></ul></footer></body></html>"
_AD = '<div class="ad">Buy our product today, limited offer for all readers.</div>'
_TEXT = "<p>The river had risen in the night and by the morning the lower fields were under water, so the farmers moved the cattle to the hill.</p>"
_MORE = "<p>Nobody had expected it, <b>least of all</b> the mayor, who had said a week before that the new dam would <i>hold any flood</i>.<br>He was wrong.</p>"
_LIST = "<ul><li>Keep the doors closed at night.</li><li>Move all cars to the upper road before noon.</li></ul>"
_QUOTE = "<blockquote>We have seen worse, and we will see worse again, she said.</blockquote>"
_TABLE = "<table><tr><th>Day</th><th>Level</th></tr><tr><td>Monday</td><td>two metres</td></tr></table>"

#: Names of blocks beside an article, and of those that hold one.
BESIDE = (
    "ad ads advert advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager "
    "footer header masthead comment comments respond disqus notice cookie cookies consent gdpr popup modal overlay share sharing social related recommended "
    "newsletter subscribe signup login search toolbar widget complementary contentinfo alert dialog"
).split()
HOLDING = "content article post entry story main body prose".split()


def _named(name: str) -> list[list[tuple[int, str]]]:
    """Pages whose block beside the article has the name: after it, between its paragraphs, and before a page of no names."""
    beside = f'<div class="{name}">Words that stand beside the text and are no part of it at all.</div>'
    return [
        [(0, f'{_HEAD}<div class="content">'), (1, "<h1>Water in town</h1>" + _TEXT + _MORE), (0, f"</div>{beside}</body></html>")],
        [(0, f'{_HEAD}<div id="c1">'), (1, _TEXT + _MORE), (0, beside), (1, _TEXT), (0, "</div></body></html>")],
        [(0, f"{_HEAD}{beside}<div>"), (1, "<h2>Water in town</h2>" + _TEXT + _LIST + _QUOTE), (0, "</div></body></html>")],
    ]


def _holding(name: str) -> list[tuple[int, str]]:
    """A page whose article and its parts have the name."""
    head = f'<div class="{name}-header"><h1>The flood came at night</h1><p>What the river took and what it left</p></div>'
    return [(0, f'{_HEAD}{_MENU}<div class="{name}">'), (1, f'{head}<div class="{name}-body">{_TEXT}{_MORE}</div>'), (0, f"</div>{_FOOT}")]


PAGES: list[list[tuple[int, str]]] = [
    [(0, _HEAD + _MENU + _AD + "<article>"), (1, "<h1>The flood came at night</h1>" + _TEXT + _MORE), (0, "</article>" + _FOOT)],
    [(0, _HEAD + "<header><h1>Daily Paper</h1><p>News for everyone since long ago</p></header>" + _MENU + "<main>"), (1, "<h2>A wet spring</h2>" + _TEXT + _LIST + _MORE), (0, '</main><aside><h3>Most read</h3><ul><li><a>Ten facts about cats</a></li><li><a>What the stars say</a></li></ul></aside>' + _FOOT)],
    [(0, _HEAD + '<div id="menu"><a href="/">Start</a> <a href="/x">All topics</a></div><div class="content">'), (1, "<h1>Water levels</h1>" + _TEXT + _TABLE + _QUOTE + _TEXT), (0, '</div><div class="sidebar"><p>Sign up for our letter and read more every week.</p></div><div class="footer">Imprint, contact, privacy notice</div></body></html>')],
    [(0, _HEAD + '<div class="cookie-notice">We use cookies to improve this site. <button>Accept all</button></div>' + _MENU + "<article>"), (1, "<h1>Short note</h1><p>It rained again.</p>"), (0, '</article><section class="comments"><h3>Comments</h3><p>I do not believe a word of what is written here, said a reader.</p><p>Me neither, and I live there.</p></section>' + _FOOT)],
    [(0, _HEAD), (1, _TEXT + _MORE + _TEXT), (0, "</body></html>")],
    [(0, _HEAD + _MENU + '<form action="/s"><label>Search the site</label><input name="q"><select><option>All years</option><option>This year</option></select></form><section>'), (1, "<h1>Rain</h1>" + _TEXT + "<h2>Later</h2>" + _MORE + _QUOTE), (0, "</section>" + _FOOT)],
    [(0, _HEAD + '<div class="banner ads">A better bank for your savings and mine</div><table><tr><td>'), (1, _MORE + _TEXT + "<pre>level = 2</pre>"), (0, '</td></tr></table><div class="related"><a>Another story about a river</a><a>And one about the sea</a></div></body></html>')],
    [(0, _HEAD + _MENU + '<main><article>'), (1, "<h1>Long story</h1>" + _TEXT * 6 + _LIST + _MORE * 3), (0, '<div class="share"><a>Share this</a><a>Send by mail</a></div></article></main>' + _AD + _FOOT)],
    [(0, _HEAD + "<div><p><a>Home</a> | <a>Blog</a> | <a>Archive</a></p></div><div>"), (1, "<h1>Blog entry</h1><div>" + _TEXT + "</div><div>" + _MORE + "</div>"), (0, "</div><div><a>Older entry</a> <a>Newer entry</a></div></body></html>")],
    [(0, _HEAD + _MENU + "<article>"), (1, '<header class="entry-header"><h1>The flood came at night</h1><p>What the river took and what it left behind</p></header><div class="entry-content"><div><div>' + _TEXT + _LIST + "</div><div>" + _MORE + "</div></div></div><section><h2>Later</h2>" + _TEXT + "</section>"), (0, "<footer>Filed under rivers and floods by our desk</footer></article>" + _FOOT)],
    *[page for name in BESIDE for page in _named(name)],
    *[_holding(name) for name in HOLDING],
]
