"""Pages written by hand after the shapes of well-known page templates, on which the labeller is never tuned: (body, main text)."""

A = "Heavy rain closed the mountain pass on Sunday, and dozens of drivers had to spend the night in their cars."
B = "The road was cleared by noon. Nobody was hurt, according to the regional traffic office."
C = "More snow is expected later this week."
D = "Der Stadtrat hat am Montag beschlossen, die alte Brücke über den Fluss zu erhalten und zu sanieren."
E = "Die Arbeiten beginnen im Frühjahr und dauern voraussichtlich zwei Jahre."
T = "Pass closed after heavy rain"
P = f"<p>{A}</p><p>{B}</p>"
AB, ABC, TAB = f"{A} {B}", f"{A} {B} {C}", f"{T} {A} {B}"
LINKS = '<a href="/">Start</a> | <a href="/archive">Archive</a> | <a href="/contact">Contact</a>'
LIST = '<ul><li><a href="/">Start</a></li><li><a href="/maps">Maps</a></li><li><a href="/weather">Weather</a></li></ul>'

PAGES = {
    "font tags": (f'<center>{LINKS}</center><hr><font size=2>{A}<br><br>{B}<br><br>{C}</font><hr><center>&copy; 1999 Mountain Gazette</center>', ABC),
    "wrap with a bold title": (f"<nav>{LIST}</nav><div id=outer><b>{T}</b><br><br>{A}<br><br>{B}</div>", TAB),
    "table of three columns": (f'<table width="100%"><tr><td width=120>{LIST}</td><td>{P}</td><td width=120><a href="/x">Webcams</a><br><a href="/y">Hotels</a></td></tr><tr><td colspan=3>Copyright 2001 Mountain Gazette</td></tr></table>', AB),
    "table with a banner row": (f'<table><tr><td colspan=2><a href="/"><img src=logo.gif>Mountain Gazette</a></td></tr><tr><td>{LIST}</td><td><h2>{T}</h2>{P}</td></tr></table>', TAB),
    "entry meta": (f'<div class="hfeed"><div class="entry"><h2 class="entry-title">{T}</h2><div class="entry-content">{P}</div><div class="entry-meta">Filed under <a href="/c/roads">Roads</a> by Tom</div></div></div>', TAB),
    "article footer": (f'<nav>{LIST}</nav><article>{P}<footer>Posted by Tom on 3 May at 9:15</footer></article>', AB),
    "post-meta below": (f'<div id="main"><div class="post">{P}<p class="post-meta">Posted at 12:40 by Eva in <a href="/r">Roads</a></p></div></div>', AB),
    "unmarked copyright": (f"<div>{LINKS}</div><div>{P}</div><div>Copyright 2019 Mountain Gazette. All rights reserved.</div>", AB),
    "copyright paragraph": (f"<header><a href=/>Mountain Gazette</a></header>{P}<p>© 2020 Mountain Gazette Ltd</p>", AB),
    "feedback": (f'<article>{P}</article><div id="feedback"><h3>What readers think</h3><p>I was stuck there for nine hours with two children and no food at all.</p></div>', AB),
    "disqus": (f'<main><article><h1>{T}</h1>{P}</article><div id="disqus_thread"><p>Please drive carefully, everybody, it is still icy up there.</p></div></main>', TAB),
    "user comments list": (f'<div class="story">{P}</div><ul class="user-comments"><li><b>joe</b>: this happens each year and nobody does anything about it</li><li><b>ann</b>: true</li></ul>', AB),
    "itemprop": (f'<div itemscope><div itemprop="articleBody">{P}<p>{C}</p></div></div><div role="navigation">{LIST}</div>', ABC),
    "role main": (f'<div role="banner">Mountain Gazette</div><div role="navigation">{LIST}</div><div role="main">{P}</div><div role="contentinfo">Imprint and terms</div>', AB),
    "header in the article": (f'<article><h1>{T}</h1>{P}<p>{C}</p></article><aside class="more-news"><h2>More news</h2><p><a href="/1">Ski race cancelled</a></p><p><a href="/2">Train line reopened after storm</a></p></aside>', f"{TAB} {C}"),
    "newsletter in the middle": (f'<div class="article__body"><p>{A}</p><div class="newsletter-signup"><p>Get our best stories each morning.</p><input type=email></div><p>{B}</p></div>', AB),
    "paywall notice": (f'<main><p>{A}</p><p>{B}</p></main><div class="modal-overlay"><p>You have two free articles left this month.</p></div>', AB),
    "German": (f'<nav><ul><li><a href="/">Startseite</a></li><li><a href="/p">Politik</a></li></ul></nav><div class="artikel"><p>{D}</p><p>{E}</p></div><footer>Impressum Datenschutz</footer>', f"{D} {E}"),
    "divs for paragraphs": (f'<div class="nav-bar">{LIST}</div><div class="post"><div>{A}</div><div>{B}</div><div>{C}</div></div><div class="site-footer">About this site</div>', ABC),
    "spans": (f'<section class="text"><span>{A}</span><br/><br/><span>{B}</span></section><section class="related-links">{LIST}</section>', AB),
    "definition list": (f"<nav>{LIST}</nav><main><h1>{T}</h1><dl><dt>Where</dt><dd>North ramp</dd><dt>When</dt><dd>Sunday</dd></dl><p>{B}</p></main>", f"{T} Where North ramp When Sunday {B}"),
    "code": (f"<header>Docs</header><nav>{LIST}</nav><article><p>{C}</p><pre>roads --closed --since sunday</pre><p>{B}</p></article>", f"{C} roads --closed --since sunday {B}"),
    "sponsor box first": (f'<div class="sponsor-box"><p>Winter tyres, four for three, only this week at Wheelers.</p></div><article>{P}</article>', AB),
    "skip link": (f'<a class="skip-link" href="#c">Skip to the content</a><div class="top-menu">{LIST}</div><div id="c" class="content">{P}</div>', AB),
    "author box": (f'<article>{P}</article><div class="author-box widget"><p>Tom writes about roads and weather. Follow Tom for more.</p></div>', AB),
    "pager": (f'<div class="content">{P}</div><div class="pagination"><a href="?p=1">1</a> <a href="?p=2">2</a> <a href="?p=3">Next page</a></div>', AB),
    "tags": (f'<article class="entry"><h2>{T}</h2>{P}<ul class="tags"><li><a href="/t/snow">snow</a></li><li><a href="/t/roads">roads</a></li></ul></article>', TAB),
    "nested quotes": (f'<nav>{LIST}</nav><div class="body"><p>{A}</p><blockquote>We saw nothing but snow.</blockquote><p>{B}</p></div>', f"{A} We saw nothing but snow. {B}"),
    "main with search": (f'<header><form role="search"><label>Search the site</label><input></form></header><main><h1>{T}</h1>{P}</main><footer>{LINKS}</footer>', TAB),
    "plain text": (f"{A}\n\n{B}", AB),
}


def page(name: str) -> str:
    return f"<!DOCTYPE html><html><head><title>Title</title></head><body>{PAGES[name][0]}</body></html>"
