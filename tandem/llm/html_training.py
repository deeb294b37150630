"""Labelled pages for the text extraction model.

Built from page parts written for this purpose: articles in several markups and the parts that
surround them -- menus, headers, footers, sidebars, notices, adverts, forms, comments of readers.
``y="1"`` marks main text, ``y="0"`` everything else; a node without a mark has its parent's.
"""

import re

_WORDS = ("the council met on Tuesday to discuss a new bridge, which has been delayed since spring. Engineers said that its "
          "foundations are sound, but the steel must be tested again before work goes on. Residents are losing patience with "
          "the builders, and the mayor hopes for a better year.").split()
#: Placeholders: a long, middle and short text with a full stop, and a bare one without; words at least and at most.
_LENGTHS = {"@L": (20, 90), "@M": (8, 30), "@S": (2, 8), "@B": (1, 12)}
_LONG, _MID, _SHORT, _BARE = _LENGTHS
_NAV = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("Home", "News", "Sport", "Contact", "About us"))
_LINKS = "".join(f'<li><a href="/s/{i}">{t}</a></li>' for i, t in enumerate(
    ("Ten walks for the autumn", "Why bread got dearer", "The harbour in pictures", "Readers' questions answered")))

ARTICLES = (
    f'<article><h1>{_BARE}</h1><p>{_LONG}</p><p>{_MID}</p><p>{_SHORT}</p></article>',
    f'<main><h1>{_BARE}</h1><p>{_LONG}</p><h2>Costs</h2><p>{_MID} <a href="/x">More</a></p><ul><li>{_SHORT}</li>'
    f'<li>{_MID}</li><li>{_BARE}</li></ul></main>',
    f'<div id="content"><div class="post"><h1>{_BARE}</h1><p>{_MID}</p><p>{_LONG}</p><blockquote>{_SHORT}</blockquote></div></div>',
    f'<section class="article-body"><h2>{_BARE}</h2><p>{_LONG} {_MID}</p><p>{_SHORT}</p><pre>wind  98 km/h\nrain  31 mm</pre>'
    '<table><tr><th>Day</th><th>Rain</th></tr><tr><td>Monday</td><td>31 mm</td></tr></table></section>',
    f'<article><header><h1>{_BARE}</h1></header><div><p>{_LONG}</p><figure><img><figcaption>{_BARE}</figcaption></figure>'
    f'<aside y="0" class="promo"><p>Also read: <a href="/q">our guide to flour</a></p></aside><p>{_MID}</p></div></article>',
    f'<div class="page"><div class="entry-content"><h3>{_BARE}</h3><p>{_MID}</p><ol><li>{_MID}</li><li>{_SHORT}</li></ol><p>{_LONG}</p></div></div>',
    f'<main class="story"><h1>{_BARE}</h1><div>{_LONG}<br>{_SHORT}</div><dl><dt>Place</dt><dd>The old port.</dd></dl></main>',
    f'<p>{_LONG}</p><p>{_MID}</p><p>{_SHORT}</p><h2>{_BARE}</h2><p>{_LONG}</p>',
    f'<article class="text main"><h1>{_BARE}</h1><p>{_BARE}</p><p>{_MID}</p><section><h2>Later</h2><p>{_SHORT}</p></section></article>',
    f'<div class="article"><h1>{_BARE}</h1><div class="body text"><p>{_LONG}</p><p>{_BARE}</p></div></div>',
    f'<article><h1>{_BARE}</h1><p>{_SHORT}</p><ul><li>{_MID}</li><li>{_SHORT}</li><li>{_BARE}</li><li>{_LONG}</li></ul><p>{_MID}</p>'
    f'<ol><li>{_BARE}</li><li><p>{_MID}</p></li><li>{_BARE}</li></ol></article>',
    f'<main><article><h2>{_BARE}</h2><ul><li>{_BARE}</li><li>{_BARE}</li><li>{_MID}</li><li>{_BARE}</li></ul><p>{_LONG}</p><table><tr><th>{_BARE}</th>'
    f'<td>{_SHORT}</td></tr><tr><th>{_BARE}</th><td>{_MID}</td></tr></table></article></main>',
    f'<article><header><h1>{_BARE}</h1><p>{_MID}</p></header><nav y="0"><a href="#a">{_BARE}</a> <a href="#b">{_BARE}</a></nav><p>{_LONG}</p><p>{_SHORT}</p>'
    f'<footer y="0"><p>{_MID}</p></footer></article>',
    f'<main><header y="0"><a href="/">Example</a> {_BARE}</header><section><h2>{_BARE}</h2><p>{_MID}</p><p>{_LONG}</p></section><footer y="0">{_BARE}</footer></main>',
    f'<div class="content"><div class="post"><h2>{_BARE}</h2><p>{_LONG}</p><p>{_SHORT}</p></div><div y="0" class="comments"><div class="comment"><p>{_MID}</p></div>'
    f'<div class="comment"><p>{_SHORT}</p></div></div></div>',
    f'<div class="text"><p>{_LONG}</p><div y="0" class="share">{_BARE}</div><div y="0" class="ad">{_MID}</div><p>{_MID}</p><form y="0"><p>{_SHORT}</p><input></form><p>{_LONG}</p></div>',
    f'<div><div><div>{_LONG}</div><div>{_MID}</div></div><div><p>{_MID}</p></div></div>',
    f'{_LONG}<br>{_SHORT}<br>{_MID}',
    f'<article><h1>{_BARE}</h1><p>{_SHORT}</p></article>',
    f'<article><p>{_LONG}</p><blockquote>{_BARE}<p>{_MID}</p>{_SHORT}</blockquote><p>{_MID}</p><blockquote><p>{_LONG}</p></blockquote></article>',
    f'<div><div><article><p>{_MID}</p><p>{_SHORT}</p></article></div></div>',
    f'<article><h1>{_SHORT}</h1><p><b>{_SHORT}<br></article>',
)
BEFORE = (
    f'<nav><ul>{_NAV}</ul></nav>',
    '<header><a href="/">Example</a><p>The paper of the town</p></header>',
    '<div id="header"><div class="logo">Example</div><div class="menu"><a href="/a">A</a> <a href="/b">B</a></div></div>',
    f'<div class="ad">{_MID}</div>',
    f'<div class="ad">{_LONG} {_SHORT}</div>',
    '<div class="cookie-notice"><p>We use cookies to improve your visit, and by going on you accept them.</p><button>Accept</button></div>',
    '<nav class="breadcrumb"><a href="/">Home</a> &gt; <a href="/n">News</a></nav>',
    f'<div class="banner advert advertisement"><p>{_MID}</p><p>Save now!</p></div>',
    f'<header><h2>{_BARE}</h2><p>{_SHORT}</p></header>',
    f'<header><h1>{_BARE}</h1><p>{_MID}</p></header>',
    f'<div class="masthead header"><h1>{_BARE}</h1><p>{_SHORT}</p></div>',
    '<div class="topbar"><span>Log in</span></div>',
    '<div class="alert warning notice"><p>This site is read-only for maintenance.</p></div>',
    f'<header class="site-header"><h1>Example</h1><p>{_MID}</p><nav><ul>{_NAV}</ul></nav></header>',
    '<div class="consent popup" role="dialog"><p>Your privacy matters to us. We and our partners store data.</p></div>',
    f'<ul class="menu navigation">{_NAV}</ul>',
)
AFTER = (
    '<footer>&copy; 2020 Example &middot; All rights reserved.</footer>',
    f'<footer>&copy; 2020 Example &middot; {_MID} {_SHORT}</footer>',
    f'<footer><p>{_MID}</p><ul>{_LINKS}</ul></footer>',
    f'<aside><h3>Related</h3><ul>{_LINKS}</ul></aside>',
    f'<aside class="sidebar"><h3>About</h3><p>{_LONG}</p></aside>',
    f'<div class="comments" id="comments"><h3>Comments</h3><div class="comment"><p>Great article, thank you! {_MID}</p></div>'
    f'<div class="comment"><p>I do not agree at all. {_SHORT}</p></div></div>',
    f'<section id="comments" class="comment-list"><article><p>{_LONG}</p></article><article><p>{_SHORT}</p></article></section>',
    f'<div class="sidebar"><p>Follow us</p><ul>{_LINKS}</ul></div>',
    '<div id="footer">Contact | Terms | 2020</div>',
    '<form><label>Your mail</label><input name="m"><p>Sign up for our letter.</p></form>',
    '<div class="share social">Share this</div>',
    f'<div class="widget popular"><h4>Popular</h4><ul>{_LINKS}</ul></div>',
    f'<div class="newsletter subscribe"><p>Subscribe to our newsletter. {_MID}</p></div>',
    '<div role="contentinfo"><p>&copy; Example</p></div>',
    '<ul class="pagination"><li><a href="?p=1">1</a></li><li><a href="?p=2">2</a></li></ul>',
    f'<div class="sponsored promo"><p>{_LONG}</p></div>',
    f'<div class="related recommended"><p>{_MID}</p><ul>{_LINKS}</ul></div>',
    f'<form action="/search"><p>{_MID}</p><input name="q"></form>',
    '<table class="footer nav"><tr><td><a href="/i">Imprint</a></td><td><a href="/p">Privacy</a></td></tr></table>',
    f'<ol class="comments responses"><li class="comment"><p>{_LONG}</p></li><li class="comment reply">{_BARE}</li></ol>',
)


def _filled(page: str) -> str:
    """The page with every placeholder replaced by running words, of ever new lengths."""
    at, turn, out = 0, 0, []
    for piece in re.split(r"(@[LMSB])", page):
        if piece in _LENGTHS:
            low, high = _LENGTHS[piece]
            n = low + (turn * 11 + len(page)) % (high - low + 1)
            text = " ".join(_WORDS[(at + j) % len(_WORDS)] for j in range(n)).rstrip(".,")
            out.append(text[0].upper() + text[1:] + "." * (piece != "@B"))
            at, turn = at + n, turn + 1
        else:
            out.append(piece)
    return "".join(out)


def _marked(part: str) -> str:
    """``y="0"`` on a part's outer element."""
    end = part.index(">")
    return part[:end] + ' y="0"' + part[end:]


def labelled_pages(n: int = 120, articles=ARTICLES, before_=BEFORE, after_=AFTER) -> list[str]:
    """Page ``i`` has article ``i`` of the list, three parts before and four after it; each article meets many
    parts, and is a page of its own."""
    pages = []
    for i in range(n):
        before = [_marked(before_[(i * 3 + k) % len(before_)]) for k in range(3)]
        after = [_marked(after_[(i * 7 + k * 3) % len(after_)]) for k in range(4)]
        inner = "".join([*before, articles[i % len(articles)], *after])
        pages.append(_filled(f'<html y="1"><body>{inner}</body></html>' if i % 3
                             else f'<html y="1"><body><div class="container">{inner}</div></body></html>'))
    return pages + [f'<html y="1">{_filled(a)}</html>' for a in articles]
