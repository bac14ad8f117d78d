import random

from rankscreen.llm import main_text as m

PAGE = ("<html><head><title>T</title><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>Home</a></li><li>About us</li></ul></nav>"
        "<!-- <p>no</p> --><div class=\"ad\">Buy now</div>{open}<h1>A  title &amp; more</h1><p><b>First&nbsp;par.<br>line<p>Second <i>par</i>agraph.</p>"
        "<div class='cookie-notice'>We use cookies</div><p>Third\n\tone.</p>{close}<section class='comments'><p>Great post</p></section>"
        "<aside>See also</aside><form><p>Mail</p><button>Go</button></form><footer>&copy; site</footer></body></html>")
WANT = "A title & more First par. line Second paragraph. Third one."


def test_whole_table(spark):
    labelled = [(i, f"u{i}", PAGE.format(open="<article>", close="</article>"), 1) for i in range(5)]
    other = [(10, "u", PAGE.format(open="<div>", close="</div>"), 1), (11, None, None, 2), (12, "u", "", 3), (13, "u", "plain &lt;text&gt;", 4),
             (14, "u", "<p>kept<script>alert(1)<p>", 5), (None, "u", "<p>" + "long " * 100_000, 6)]
    pages = spark.createDataFrame(labelled + other + labelled[:1], "page_id long, url string, html string, text int")
    rows = m.main_text(pages).collect()
    assert len(rows) == 12 and all(r.n_chars == len(r.text) for r in rows)
    got = {r.page_id: r.text for r in rows}
    assert all(got[i] == WANT for i in (0, 1, 2, 3, 4, 10))
    assert (got[11], got[12], got[13], got[14], len(got[None])) == ("", "", "plain <text>", "kept", 499_999)
    assert m.main_text(pages.limit(0)).count() == 0


def test_scan_finds_the_best_region():
    rnd = random.Random(6)
    weight = m.weights({})
    for _ in range(200):
        page = "".join(rnd.choice(["<p>a b c</p>", "<li>x</li>", "<nav><li>m n</li></nav>", "<aside>q r s t</aside>", "<div></div>" * 3]) for _ in range(9))
        found = m.blocks(page)
        word = [m.word_score(a, weight) * (t.count(" ") + 1) for a, t, *_ in found]
        spans = [(sum(word[i:j]) - sum(-m.tag_score(t, weight) for f in found[i + 1:j] for t in f[2]), i, j) for i in range(len(found)) for j in range(i + 1, len(found) + 1)]
        top = max((s for s, *_ in spans), default=0)
        texts = {" ".join(found[k][1] for k in range(i, j) if word[k] > 0) for s, i, j in spans if abs(s - top) < 1e-9} or {""}
        assert m.extract(page, weight) in texts or top <= 0


def test_names_on_wrappers_do_not_lose_the_article(spark):
    want = PAGE.format(open="{open}", close="{close}").replace("<body>", "{body}")
    words = " ".join(f"word{i}" for i in range(40))
    want = want.replace("<p>Third", f"<p>{words}</p><p>Third")
    text = WANT.replace("Third one.", f"{words} Third one.")
    forms = [("<body class='has-sidebar'>", "<main class='with-footer'><article class='post tag-form comments-open'>", "</article></main>"),
             ("<body id=share>", "<div class='widget'><article>", "</article></div>"),
             ("<body>", "<article><div class='social tags'>", "</div></article>")]
    rows = [(10 * k + i, "u", want.format(body=b, open=o, close=c)) for k, (b, o, c) in enumerate(forms) for i in range(5)]
    bare = [(100, "u", want.format(body="<body class='has-sidebar'>", open="<div class='widget'>", close="</div>"))]
    pages = spark.createDataFrame(rows + bare, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in m.main_text(pages).collect()} == {r[0]: text for r in rows + bare}
    # Unseen names on the page itself, with no labelled page at all.
    assert m.extract(rows[0][2], m.weights({})) == text


def test_unread_elements_end_where_they_close():
    weight = m.weights({})
    for part in ("<svg viewBox='0 0 1 1'/>", "<math/>", "<video-player src=a></video-player>", "<svg-icon name=x></svg-icon>", "<math-field>", "<svg>", "<video src=a>",
                 "<svg><path/><text>no</text></svg>", "<SCRIPT>var t = '<p>';</SCRIPT >", "<iframe src=a>no</iframe>", "<scripted-part>"):
        assert m.extract(f"<article><p>one {part} two</p><p>three</p></article>", weight) == "one two three", part
    for name in ("math", "noscript", "object"):
        assert m.extract(f"<p>one <{name} id=a>two</{name}> three</p>", weight) == "one two three"
    for name in ("script", "style", "template"):
        assert m.extract(f"<p>one</p><{name}>two<p>three</p>", weight) == "one"
    assert m.extract("<p>one</p>" + "<svg>" * 50_000 + "<p>two</p>", weight) == "one two"
