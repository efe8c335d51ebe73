"""Pages written by hand, in layouts of common kinds of sites, with the text a reader would call the article."""

LONG = "The river had risen in the night, and by morning the lower meadow was a lake. Farmers moved their animals to the hill, where the old barn still stood."
MORE = "Nobody in the village remembered such a flood. The bridge held, though water reached its rail; the mill, which had no such luck, lost its wheel."
LAST = "Officials said on Tuesday that repairs would begin within weeks, once the ground had dried enough to carry machines."
MENU = '<ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li><li><a href="/about">About us</a></li></ul>'


def page(body: str, head: str = "<title>The Valley Post</title>") -> str:
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


PAGES = {
    "news with comments": (
        page(f'<header><nav>{MENU}</nav></header><article><h1>Flood in the valley</h1><p>{LONG}</p><p>{MORE}</p></article><section class="comments"><h2>Comments</h2><div class="comment"><b>anna</b><p>I saw it too, it was terrible to watch the mill go.</p></div><div class="comment"><b>tom</b><p>Stay safe, everyone.</p></div></section><footer>&copy; The Valley Post</footer>'),
        ["Flood in the valley", LONG, MORE],
    ),
    "blog with a sidebar": (
        page(f'<div id="wrapper"><div class="menu">{MENU}</div><div class="content"><h1>Notes from the hill</h1><p>{LONG}</p><h2>After the water</h2><p>{LAST}</p></div><div class="sidebar"><h3>Popular posts</h3><ul><li><a href="/1">Ten walks</a></li><li><a href="/2">Old mills</a></li></ul><p>Follow the blog by mail.</p></div></div><div class="footer"><p>All rights reserved.</p></div>'),
        ["Notes from the hill", LONG, "After the water", LAST],
    ),
    "cookie notice first": (
        page(f'<div class="cookie-consent" role="dialog"><p>We use cookies to give you the best experience. By going on you accept them.</p><button>Accept</button></div><nav>{MENU}</nav><main><h1>Repairs begin</h1><p>{LAST}</p><p>{MORE}</p></main><footer><p>Contact the editors</p></footer>'),
        ["Repairs begin", LAST, MORE],
    ),
    "newsletter form inside the article": (
        page(f'<article><h1>The mill</h1><p>{LONG}</p><form class="newsletter" action="/subscribe"><label>Your mail</label><input name="m"><button>Subscribe</button><p>Get our letter every Friday.</p></form><p>{MORE}</p></article>'),
        ["The mill", LONG, MORE],
    ),
    "advert between paragraphs": (
        page(f'<main><article><h1>Bridge holds</h1><p>{LONG}</p><div class="ad"><p>Buy boots that keep the water out. Only this week.</p></div><p>{MORE}</p><div class="advertisement">Cheap boats for sale!</div><p>{LAST}</p></article></main>'),
        ["Bridge holds", LONG, MORE, LAST],
    ),
    "recipe with lists": (
        page(f'<nav>{MENU}</nav><div class="post"><h1>Bread for a wet day</h1><p>{LONG}</p><ul><li>500 g of strong flour, sifted twice.</li><li>A spoon of salt and one of honey.</li></ul><p>{LAST}</p></div><aside><h3>Related</h3><p>Soup for a dry day</p></aside>'),
        ["Bread for a wet day", LONG, "500 g of strong flour, sifted twice.", "A spoon of salt and one of honey.", LAST],
    ),
    "references in the text": (
        page(f"<article><h1>Caf&eacute; &amp; mill</h1><p>He said: &#8220;never&nbsp;again&#8221; &lt;twice&gt;.\n   Then he left,\tslowly.</p><p>{MORE}</p></article>"),
        ["Café & mill", "He said: “never again” <twice>. Then he left, slowly.", MORE],
    ),
    "inline markup": (
        page(f'<article><h1>The <em>old</em> barn</h1><p>The <b>old</b> barn <a href="/x">still</a> stood, as <i>everyone</i> knew, on its <span>hill</span>.<br>It was red.</p><p>{LONG}</p></article>'),
        ["The old barn", "The old barn still stood, as everyone knew, on its hill. It was red.", LONG],
    ),
    "scripts and styles inside": (
        page(f'<style>p {{ color: red }}</style><article><h1>Water</h1><script>document.write("<p>not text</p>");</script><p>{LONG}</p><style>.x {{}}</style><p>{MORE}</p><noscript>Turn scripts on.</noscript></article><script>var late = 1;</script>'),
        ["Water", LONG, MORE],
    ),
    "unclosed paragraphs": (
        page(f"<article><h1>No end tags<p>{LONG}<p>{MORE}<p>{LAST}</article>"),
        None,
    ),
    "paragraphs without end tags": (
        page(f"<nav>{MENU}</nav><article><h1>No end tags</h1><p>{LONG}<p>{MORE}<p>{LAST}</article><footer><p>Imprint</footer>"),
        ["No end tags", LONG, MORE, LAST],
    ),
    "quote in the middle": (
        page(f"<article><h1>What the miller said</h1><p>{LONG}</p><blockquote>We will build it again, and higher this time, said the miller.</blockquote><p>{LAST}</p></article><aside class='widget'><p>Weather: rain</p></aside>"),
        ["What the miller said", LONG, "We will build it again, and higher this time, said the miller.", LAST],
    ),
    "sections with subtitles": (
        page(f"<header class='masthead'><div class='logo'>The Post</div></header><main><h1>A week of rain</h1><section><h2>Monday</h2><p>{LONG}</p></section><section><h2>Tuesday</h2><p>{MORE}</p></section></main>"),
        ["A week of rain", "Monday", LONG, "Tuesday", MORE],
    ),
    "share buttons": (
        page(f'<article><h1>High water</h1><div class="share"><a href="#">Tweet</a> <a href="#">Mail</a> <a href="#">Print</a></div><p>{LONG}</p><p>{LAST}</p></article><div class="related"><h3>Read on</h3><ul><li><a href="/a">Dams</a></li><li><a href="/b">Ducks</a></li></ul></div>'),
        ["High water", LONG, LAST],
    ),
    "comments as a list": (
        page(f'<div class="entry"><h1>My garden drowned</h1><p>{MORE}</p><p>{LONG}</p></div><div id="comments"><ul><li class="comment"><b>lea</b><p>So sorry to hear this, I lost my roses as well last year.</p></li><li class="comment"><b>kim</b><p>Plant willows.</p></li></ul><form class="respond"><label>Your reply</label><input></form></div>'),
        ["My garden drowned", MORE, LONG],
    ),
    "login form and search": (
        page(f'<form class="search" action="/q"><input name="q"><p>Search the archive</p></form><form id="login"><label>Name</label><input><label>Password</label><input><button>Enter</button></form><article><h1>Archive opened</h1><p>{LAST}</p><p>{LONG}</p></article>'),
        ["Archive opened", LAST, LONG],
    ),
    "breadcrumbs and pager": (
        page(f'<div class="breadcrumbs"><a href="/">Home</a> <a href="/valley">Valley</a></div><article><h1>Part two</h1><p>{MORE}</p><p>{LAST}</p></article><div class="pagination"><a href="/1">1</a> <a href="/2">2</a> <a href="/3">3</a></div>'),
        ["Part two", MORE, LAST],
    ),
    "short article": (
        page(f"<nav>{MENU}</nav><article><h1>Road closed</h1><p>The valley road is closed until Friday.</p></article><footer>&copy; 2024</footer>"),
        ["Road closed", "The valley road is closed until Friday."],
    ),
    "comment out of sight": (
        page(f"<article><h1>Hidden</h1><!-- <p>old text that nobody sees</p> --><p>{LONG}</p><p>{MORE}</p></article>"),
        ["Hidden", LONG, MORE],
    ),
    "other language": (
        page("<nav><ul><li><a href='/'>Start</a></li><li><a href='/k'>Kontakt</a></li></ul></nav><main><h1>Hochwasser im Tal</h1><p>Der Fluss stieg über Nacht, und am Morgen stand die Wiese unter Wasser. Die Bauern trieben ihr Vieh auf den Hügel.</p><p>Die Brücke hielt, obwohl das Wasser bis ans Geländer reichte; die Mühle verlor ihr Rad.</p></main><div class='cookie'><p>Diese Seite verwendet Cookies.</p></div>"),
        ["Hochwasser im Tal", "Der Fluss stieg über Nacht, und am Morgen stand die Wiese unter Wasser. Die Bauern trieben ihr Vieh auf den Hügel.", "Die Brücke hielt, obwohl das Wasser bis ans Geländer reichte; die Mühle verlor ihr Rad."],
    ),
    "cut off": (f"<html><body><nav>{MENU}</nav><article><h1>Cut</h1><p>{LONG}</p><p>{MORE} And th", ["Cut", LONG, f"{MORE} And th"]),
    "upper-case tags": (f'<HTML><BODY><DIV CLASS="nav">{MENU}</DIV><DIV ID="content"><H1>Loud</H1><P>{LONG}</P><P>{LAST}</P></DIV></BODY></HTML>', ["Loud", LONG, LAST]),
    "promotion and legal lines": (
        page(f'<div class="promo">Half price until Sunday, for members only.</div><article><h1>Prices</h1><p>{LONG}</p><p>{MORE}</p></article><div class="legal"><p>Terms of use apply. No part may be copied.</p></div>'),
        ["Prices", LONG, MORE],
    ),
    "deep wrappers": (
        page(f'<div class="container"><div><div><div class="story"><h1>Deep</h1><p>{LONG}</p><p>{LAST}</p></div></div></div><div class="sidebar"><div class="widget"><h3>Now</h3><p>It rains.</p></div></div></div>'),
        ["Deep", LONG, LAST],
    ),
}
PAGES = {k: v for k, v in PAGES.items() if v[1] is not None}
