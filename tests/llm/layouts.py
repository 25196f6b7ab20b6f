"""Page layouts made by hand, apart from those the network is trained on. Each page is (body, main text)."""

P1 = "The council met on Tuesday evening to discuss the new bridge over the river, which has been planned for years."
P2 = "Costs are expected to rise & fall again, said one member, who did not wish to be named in this report."
P3 = "Work starts in May."
H = "Council discusses bridge"
A, B, C, T = (f"<p>{p.replace('&', '&amp;')}</p>" for p in (P1, P2, P3, H))
H1 = f"<h1>{H}</h1>"
BOTH, ALL, TITLED = f"{P1} {P2}", f"{P1} {P2} {P3}", f"{H} {P1} {P2}"
NAV = "<nav><ul><li><a href=/>Home</a></li><li><a href=/world>World</a></li><li><a href=/sport>Sport</a></li></ul></nav>"
MENU = '<div class="menu"><a href="/">Home</a> <a href="/shop">Shop</a> <a href="/about">About us</a></div>'
HEADER = '<header><a href="/">The Daily Post</a></header>'
FOOTER = "<footer>© 2024 The Daily Post. All rights reserved.</footer>"
FOOT = '<div id="footer"><p>Copyright 2023 by us</p><a href="/imprint">Imprint</a></div>'
SIDE = '<aside><h3>Most read</h3><ul><li><a href="/1">Ten tips for your garden</a></li><li><a href="/2">Five ways to cook rice</a></li></ul></aside>'
SIDEBAR = '<div id="sidebar" class="widget-area"><div class="widget"><h4>Recent posts</h4><ul><li><a href="/p/1">An older post about trains</a></li><li><a href="/p/2">Another one</a></li></ul></div></div>'
COMMENTS = '<section id="comments"><h3>2 Comments</h3><div class="comment"><p>I think this is a very long comment by a reader who has quite a lot to say about the bridge and the river.</p></div><div class="comment"><p>Me too.</p></div></section>'
RESPOND = '<ol class="commentlist"><li class="comment"><p>Great news, thank you for telling us about it!</p></li><li class="comment"><p>First!</p></li></ol><div id="respond"><h3>Leave a reply</h3><form><label>Name</label><input name=n><textarea></textarea></form></div>'
COOKIES = '<div class="cookie-banner"><p>We use cookies to give you the best experience on our website.</p><button>OK</button></div>'
AD = '<div class="advertisement">Buy two bridges and get one for free, only today.</div>'
SHARE = '<div class="social-share"><a href="/f">Share on F</a><a href="/t">Share on T</a></div>'
LETTER = '<form class="newsletter"><label>Your email address</label><input name=e><button>Send</button></form>'
CRUMBS = '<div class="breadcrumbs"><a href="/">Home</a> &gt; <a href="/local">Local</a></div>'
RELATED = '<div class="related-posts"><h3>You may also like</h3><ul><li><a href="/r1">A tunnel for the hill</a></li><li><a href="/r2">The ferry is late</a></li></ul></div>'
DEEP = "<div>" * 60

PAGES = {
    "article": (f"{HEADER}{NAV}<main><article>{A}{B}</article></main>{SIDE}{FOOTER}", BOTH),
    "article, title": (f"{NAV}<article>{H1}{A}{B}</article>{FOOTER}", TITLED),
    "article, short": (f"{NAV}<article><p>{P3}</p></article>{FOOTER}", P3),
    "article, one paragraph, then comments": (f"{NAV}<article>{A}</article>{COMMENTS}{FOOTER}", P1),
    "article with comments inside": (f"{HEADER}<article>{A}{B}{COMMENTS}</article>{FOOTER}", BOTH),
    "article, marked": (f'{NAV}<article class="post hentry" id="post-17">{A}{B}{SHARE}</article>{SIDE}{FOOTER}', BOTH),
    "article with an unquoted slash": (f"{NAV}<article data-u=/x/>{A}{B}</article>{FOOTER}", BOTH),
    "div with a slash": (f'{NAV}<div class="content" />{A}{B}</div>{FOOTER}', BOTH),
    "main": (f"{HEADER}{NAV}<main>{H1}{A}{B}</main>{FOOTER}", TITLED),
    "main, one paragraph": (f"{HEADER}{NAV}<main>{A}</main>{FOOTER}", P1),
    "content by id": (f"{NAV}<div id=content>{A}{B}</div>{FOOTER}", BOTH),
    "content by id, three": (f"{HEADER}{MENU}<div id=content>{A}{B}{C}</div>{SIDEBAR}{FOOT}", ALL),
    "entry-content": (f"{HEADER}{NAV}<div class=entry-content>{A}{B}</div>{FOOTER}", BOTH),
    "blog": (f'<div id="page" class="site">{HEADER}<div id="primary" class="content-area"><div class="entry-content">{A}{B}{C}</div>{RESPOND}</div>{SIDEBAR}</div>{FOOT}', ALL),
    "post-body": (f'<div id="header"><div class="logo">My site</div></div>{MENU}<div id="content"><div class="post-body">{A}{B}</div></div>{SIDEBAR}{FOOT}', BOTH),
    "story": (f'{COOKIES}{HEADER}<div class="story-body">{H1}{A}{AD}{B}</div>{RELATED}{FOOTER}', TITLED),
    "unmarked div": (f"{NAV}<div>{A}{B}</div>{FOOTER}", BOTH),
    "unmarked section": (f"{HEADER}{NAV}<section>{H1}{A}{B}</section>{FOOTER}", TITLED),
    "unmarked divs within": (f"{HEADER}{NAV}<div><div><div>{A}{B}{C}</div></div></div>{FOOT}", ALL),
    "bare": (f"{A}{B}", BOTH),
    "bare, one": (A, P1),
    "bare between menu and footer": (f"{NAV}{A}{FOOTER}", P1),
    "bare, two, between menu and footer": (f"{NAV}{A}{B}{FOOTER}", BOTH),
    "bare with title": (f"{H1}{A}{B}<hr>{C}", f"{TITLED} {P3}"),
    "bare text": (f"{MENU}{P1}<br><br>{C}{FOOTER}", f"{P1} {P3}"),
    "table layout": (f'<table><tr><td class="nav"><a href="/">Home</a><br><a href="/x">Links</a></td><td>{A}{B}</td></tr></table>{FOOT}', BOTH),
    "notices": (f"{COOKIES}<article>{A}{AD}{B}</article>{LETTER}", BOTH),
    "crumbs and shares": (f"{NAV}{CRUMBS}<article>{H1}{SHARE}{A}{B}{SHARE}</article>{RELATED}{FOOTER}", TITLED),
    "list inside": (f"{NAV}<article>{A}<ul><li>One bridge</li><li>Two towers</li></ul>{C}</article>{FOOTER}", f"{P1} One bridge Two towers {P3}"),
    "quote and table inside": (f'{NAV}<div class="article-body">{A}<blockquote><p>We need it.</p></blockquote><table><tr><th>Year</th><th>Cost</th></tr><tr><td>2024</td><td>12</td></tr></table>{B}</div>{FOOTER}', f"{P1} We need it. Year Cost 2024 12 {P2}"),
    "headings inside": (f"{NAV}<article>{H1}{A}<h2>What it costs</h2>{B}<h2>When</h2>{C}</article>{SIDE}{FOOTER}", f"{TITLED.replace(P2, 'What it costs ' + P2)} When {P3}"),
    "figure inside": (f"{HEADER}<main><figure><img src=b.jpg><figcaption>The river in winter</figcaption></figure>{A}{B}</main>{FOOTER}", f"The river in winter {BOTH}"),
    "links inside": (f'{NAV}<article><p>{P1} See <a href="/b">the bridge</a> and <a href="/r">the river</a> there.</p>{C}</article>{FOOTER}', f"{P1} See the bridge and the river there. {P3}"),
    "deep article": (f"{DEEP}{NAV}<article>{A}{B}</article>{FOOTER}", BOTH),
    "deep divs": (f'{DEEP}{MENU}<div class="post-content">{A}{B}</div>{SIDEBAR}{FOOT}', BOTH),
    "open paragraphs": (f"{NAV}<div id=main><p>{P1}<p>{P2.replace('&', '&amp;')}<p>{P3}</div>{FOOTER}", ALL),
    "random class names": (f'<div class="a1x"><div class="b7y">{NAV}</div><div class="q9z"><div class="c-k3">{A}{B}</div></div></div>{FOOTER}', BOTH),
    "menu of divs": (f'<div><a href="/">Home</a><a href="/a">Archive</a><a href="/c">Contact</a></div><div>{A}{B}{C}</div>{FOOT}', ALL),
    "two asides": (f"{HEADER}{SIDE}<article>{A}{B}{C}</article>{SIDE}{FOOTER}", ALL),
    "comments after content": (f"{NAV}<div id=content>{A}{B}</div>{COMMENTS}{FOOTER}", BOTH),
}


def page(name: str) -> str:
    return f"<!DOCTYPE html><html><head><title>Title</title></head><body>{PAGES[name][0]}</body></html>"
