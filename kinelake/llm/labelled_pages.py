"""Labelled pages from which the weights of the extraction are learned.

Written for this purpose. ``<main->`` and ``</main->`` enclose the main text;
they are labels, not part of the page.
"""

PAGES = [
    """<html><head><title>News of the day</title><style>p{margin:0}</style><script>var a=1;</script></head><body>
<nav><ul><li><a href="/">Home</a></li><li><a href="/world">World</a></li><li><a href="/sport">Sport</a></li></ul></nav>
<div class="ad">Buy two and get a third one free this week.</div>
<main-><article><h1>River bridge opens after long repairs</h1><p>The bridge over the river opened again on Monday, after repairs that took longer than anyone had planned for.</p>
<p>Drivers had used a detour <b>for two years</b>, and shops on both banks had lost many of their customers in that time.<br>The mayor thanked them for their patience.</p></article></main->
<footer>&copy; 2020 Example Press. All rights reserved.</footer></body></html>""",
    """<html><head><title>Soup</title></head><body><header><div class="logo"><a href="/">Kitchen notes</a></div><form action="/search"><input name="q"><button>Search</button></form></header>
<div class="cookie-notice">We use cookies. <a href="/privacy">Read more</a> <button>Accept</button></div>
<main-><div class="post"><h2>A soup for cold evenings</h2><p>Peel the carrots and cut them into thin slices, then fry them slowly in butter until they are soft.</p><ul><li>Four large carrots</li><li>One litre of stock</li></ul><p>Pour the stock over them and let it simmer for half an hour before you add salt and pepper.</p></div></main->
<aside class="sidebar"><h3>Popular posts</h3><ul><li><a href="/1">Bread</a></li><li><a href="/2">Cake</a></li><li><a href="/3">Pie</a></li></ul></aside>
<section id="comments"><h3>Comments</h3><div class="comment"><p>Lovely, thanks!</p></div><div class="comment"><p>Mine was too salty.</p></div></section>
<footer><a href="/about">About</a> | <a href="/contact">Contact</a></footer></body></html>""",
    """<html><body><div id="header"><a href="/">Start</a> <a href="/shop">Shop</a> <a href="/help">Help</a></div><div id="menu"><ul><li><a href="/a">First</a></li><li><a href="/b">Second</a></li></ul></div>
<main-><div id="content"><h1>How tides work</h1><p>The pull of the moon lifts the water on the near side of the earth, and a second bulge forms on the far side.</p><blockquote><p>Time and tide wait for no man, as sailors liked to say when they had to leave at night.</p></blockquote><p>As the earth turns, a coast passes both bulges in a day, which is why most places see two high tides.</p></div></main->
<div class="related"><h4>Related</h4><a href="/x">Moons</a> <a href="/y">Waves</a></div><div id="footer"><p>Imprint</p><p><a href="/terms">Terms</a></p></div></body></html>""",
    """<html><body><nav><a href="/en">English</a><a href="/de">Deutsch</a></nav><div class="banner">Sale ends soon</div><div class="ad">Sponsored: new shoes.</div>
<main-><article><h1>Minutes of the meeting</h1><p>The chair opened the meeting at nine and welcomed all members who had travelled to be there.</p><p>Accounts for the last year were read and approved without a vote against them.</p><h2>Next steps</h2><p>A group of three will look for a larger hall and report back in spring.</p><table><tr><td>Hall</td><td>Seats</td></tr><tr><td>Old town hall</td><td>two hundred</td></tr></table></article></main->
<div class="share"><a href="#">Share</a> <a href="#">Print</a></div><form><label>Your mail</label><input><button>Subscribe</button></form><footer>&copy; Club &middot; founded long ago.</footer></body></html>""",
    """<html><body><div class="topbar"><span>Welcome, guest</span><a href="/login">Log in</a></div><div class="menu"><a href="/a">Guides</a><a href="/b">Forum</a></div>
<main-><div class="entry"><h2>Sharpening a kitchen knife</h2><div>Soak the stone in water until no more bubbles rise from it, which takes about ten minutes.</div><h3>The angle</h3><div>Hold the blade at a low angle and draw it over the stone <span>with even pressure</span>, from the heel to the tip.</div><pre>coarse stone, then fine stone</pre><section><h4>Last touch</h4><div>A strip of leather takes off the burr that is left at the edge.</div></section><dl><dt>Burr</dt><dd>The thin rim of metal that sharpening leaves.</dd></dl></div></main->
<div class="comments"><div>First!</div><div>Use oil instead of water.</div></div><div class="bottom"><a href="/legal">Legal</a></div></body></html>""",
    """<html><body><table class="nav"><tr><td><a href="/">Top</a></td><td><a href="/all">All pages</a></td></tr></table><div class="path"><a href="/x">Animals</a> &gt; <a href="/y">Birds</a></div>
<main-><div class="text"><h1>The swift</h1><p>The <a href="/swift">swift</a> is a bird of the family of <a href="/apodidae">Apodidae</a> and spends most of its life in the <a href="/air">air</a>, where it eats, drinks and even <a href="/sleep">sleeps</a>.</p>
<h2>Nests</h2><p>It nests under <a href="/roof">roofs</a> and in <i>walls</i>, as <a href="/gilbert">Gilbert White</a> had noted<sup><a href="#1">1</a></sup>.</p><blockquote>They seem to skim along like meteors.</blockquote><ul><li>Length: about <a href="/cm">17 cm</a></li><li>Weight: <a href="/gram">forty grams</a> or so</li></ul><ol><li>It feeds on insects.</li><li>It winters in <a href="/africa">Africa</a>.</li></ol></div></main->
<div class="more"><a href="/1">Martin</a><a href="/2">Swallow</a><a href="/3">Nightjar</a><a href="/4">Random page</a></div></body></html>""",
    """<html><body><div><a href="/">Home</a> | <a href="/news">News</a> | <a href="/mail">Contact</a></div>
<main-><section><h1>Release notes</h1><p>This release mends three faults, of which <a href="/f1">the first</a> was reported by <a href="/u">a reader</a>; see <a href="/log">the log</a> for more.</p><dl><dt><a href="/f2">Second fault</a></dt><dd>Times were shown in the wrong zone.</dd></dl><p>Thanks to <a href="/a">Ann</a>, <a href="/b">Bo</a> and <a href="/c">Cy</a>, who tested it, and to all <a href="/d">who wrote in</a>.</p></section></main->
<div><a href="/old">Older</a> <a href="/new">Newer</a></div><div>Powered by a small engine</div></body></html>""",
    """<html><body><div class="login"><a href="/in">Log in</a></div><div class="promo">Two for the price of one until Friday.</div>
<div class="notice"><main-><h1>How the old clock was mended</h1><p>The clock in the tower had stood still for eleven years when the town found a maker who knew its works.</p><p>She cut two wheels anew and hung the weights on <a href="/rope">rope</a> instead of wire, and it has gone well since.</p></main-></div>
<div class="share"><a href="#">Send</a> <a href="#">Save</a></div><div class="notice">This site will be closed for repairs tonight.</div><footer>Town paper</footer></body></html>""",
    """<html><body><div>Harbour gazette</div><div><a href="/today">Today</a> <a href="/past">Past issues</a></div>
<main-><div class="story"><div>Ferry stops for the winter</div><div>The small ferry to the island will not run between the first of November and the end of March, the owner said.</div><div>Fewer than ten people a day had used it last winter, and the engine needs work that cannot be done afloat.</div><div>Mail and milk will be brought over by the pilot boat, weather allowing, on three mornings of each week.</div></div></main->
<div><a href="/up">To the top</a></div><div>Made by hand</div></body></html>""",
]
