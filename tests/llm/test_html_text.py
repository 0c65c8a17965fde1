import numpy as np

from jobloom.llm import html_text as h

COLUMNS = "page_id bigint, url string, html string, host string, gone string, k1 bigint"


def main(page):
    return [t for z, t in h.blocks(page) if z == h.ARTICLE]


def test_structure():
    page = """<!DOCTYPE html><html><head><title>No</title><script>var a="</p><article>";</script></head><body class="has-sidebar">
    <header><h1>Site name</h1></header><nav><ul><li>Menu</ul></nav><div class="cookie-notice">We use cookies</div>
    <div class="main-content sidebar-left"><article><header><h1>Title &amp; more</h1></header><p><b>First&nbsp;line<br>goes
    on<p>Second &lt;b&gt; &#8217;x&#8217; &mdash; 1 < 2</p><form><p>Your name</form><ul><li>one<li>two</ul><style>p{}</style>
    <section id="comments"><p>Nice!</p></section><!-- <p>hidden</p> --></article></div><aside>Side</aside>
    <footer>Foot</footer></body></html>"""
    assert main(page) == ["Title & more", "First line goes on", "Second <b> ’x’ — 1 < 2", "one", "two"]


def test_cut_off_and_crossed_markup():
    assert main("<article><p>a <b>b</p><p>c</b> d</article><p>later") == ["a b", "c d"]
    assert main("<article><p>kept<p>and <a href=\"x>lost") == ["kept", "and"]
    assert main("<article><p>text<script>never closed <p>x") == ["text"]
    assert main(None) == main("") == [] and h.blocks("plain words") == [(h.ELSEWHERE, "plain words")]
    assert main("<main><div>body text</div></main><p>other") == ["body text"]


def test_odd_quotes_and_heads_without_an_end():
    assert main("<article><p title=it's>one</p><img alt=\"5\"\"><p>two</p><p class='a' id=\"b>c\">it's three</article>") == ["one", "two", "it's three"]
    assert main("<article><p title=>x<p data-a=b=\"c>y</article>") == ["x", "y"]
    assert main("<html><head><title>No <p></title><script>'<p>'</script><meta name=a><article><p>kept</article>") == ["kept"]
    assert main("<head><title>No</title></head><article>a</article>") == main("<head><title>No</title><body><article>a</article>") == ["a"]


def test_teasers_beside_the_article_are_not_it():
    page = "<article><p>" + "long text " * 40 + "</p></article><article class='t'><p>teaser</p></article>"
    assert main(page) == [("long text " * 40).strip()]


def naive_covered(streams, sizes):
    out = []
    for p, (s, w) in enumerate(zip(streams, sizes)):
        cover = set()
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                run = s[i:j]
                if sum(w[i:j]) >= h.LONG_RUN_WORDS and any(
                        run == t[k:k + len(run)] for q, t in enumerate(streams) if q != p for k in range(len(t))):
                    cover |= set(range(i, j))
        out.append(cover)
    return out


def test_repeated_runs_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(40):
        streams = [rng.integers(0, 4, rng.integers(1, 14)).tolist() for _ in range(rng.integers(1, 6))]
        words = {v: int(rng.integers(1, 6)) for v in range(4)}
        sizes = [[words[v] for v in s] for s in streams]
        flat, page, size = [], [], []
        for k, (s, w) in enumerate(zip(streams, sizes)):
            flat += [*s, 100 + k]
            page += [k] * (len(s) + 1)
            size += [*w, 0]
        got = h.repeated_runs(np.array(flat), np.array(page), np.array(size))
        want = naive_covered(streams, sizes)
        at = 0
        for s, c in zip(streams, want):
            assert set(np.flatnonzero(got[at:at + len(s)])) == c
            at += len(s) + 1


def test_suffix_array_order():
    rng = np.random.default_rng(5)
    s = rng.integers(0, 3, 60)
    order, shared = h.suffix_array(s)
    suffixes = [tuple(s[i:]) for i in order]
    assert suffixes == sorted(suffixes)
    for a, b, n in zip(suffixes, suffixes[1:], shared[1:]):
        assert n == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_host_boilerplate_goes_and_unique_text_stays(spark):
    frame = ("<div><div>Welcome to our big example web site, the best place to read.</div><div><p>Story {0} tells of {0} cats and {0} dogs.</p>"
             "<p>Another unique line {0} is here.</p></div><div>All content is provided as is without any warranty of any kind.</div></div>")
    pages = [(i, f"http://a.example/{i}", frame.format(i), "x", "y", 1) for i in range(12)]
    pages += [(50, "http://b.example/", frame.format(1), "x", "y", 1), (51, None, None, None, None, None), (52, "http://b.example/x", "", "", "", 0),
              (0, "http://a.example/0", frame.format(0), "x", "y", 1)]
    out = {r.page_id: r for r in h.extract(spark.createDataFrame(pages, COLUMNS)).collect()}
    assert len(out) == 15
    for i in range(12):
        assert out[i].text == f"Story {i} tells of {i} cats and {i} dogs.\nAnother unique line {i} is here." and out[i].n_chars == len(out[i].text)
    assert "Welcome" in out[50].text and out[51].text == out[52].text == ""
    assert h.extract(spark.createDataFrame(pages, COLUMNS)).count() == len(pages)
    assert h.extract(spark.createDataFrame([], COLUMNS)).count() == 0


def test_copied_articles_stay_whole(spark):
    body = "<article><h1>Title of it</h1><p>A text that several pages of this host hold word for word, and rightly so.</p></article>"
    pages = [(i, f"http://a.example/{i}", f"<nav>menu {i}</nav>{body}<footer>same footer on each of the pages here, always</footer>", "", "", 0) for i in range(6)]
    for r in h.extract(spark.createDataFrame(pages, COLUMNS)).collect():
        assert r.text == "Title of it\nA text that several pages of this host hold word for word, and rightly so."


def test_shards_of_a_busy_host(spark, monkeypatch):
    monkeypatch.setattr(h, "PAGES_PER_SHARD", 10)
    frame = "<div>Welcome to our big example web site, the best place to read.</div><p>Number {0} is unique here, {0} times.</p>"
    pages = [(i, f"http://a.example/{i}", frame.format(i), "", "", 0) for i in range(60)]
    assert {r.text for r in h.extract(spark.createDataFrame(pages, COLUMNS)).collect()} == {f"Number {i} is unique here, {i} times." for i in range(60)}


def test_tags_that_are_none_and_elements_without_an_end():
    assert main("<article><p>I </3 you</p><p>more</ p> and on</article>") == ["I", "more and on"]
    assert main("<article><p>less </ than") == ["less </ than"]
    assert main("<article><p>a</p><datalist><option value=1>x<option>y</datalist><p>b</p><select><option>1</select><button>x<p>c</p></article>") == ["a", "b", "x", "c"]
    assert main("<article><p>a<svg><svg>in</svg>out</svg>b</p></article>") == ["a", "b"]
    assert main("<article><p>text<span class=share>Share <span>x</span> tail</span>go</p></article>") == ["textgo"]


def test_one_name_alone_drops_no_section_of_an_article():
    for name in ('id="discussion"', 'class="related-work"', 'class="search-results"', 'id="copyright-law"', 'class="alert-free"'):
        assert main(f"<article><p>text</p><section {name}><p>words</p></section></article>") == ["text", "words"]
        assert main(f"<article><p>text</p><section {name}><ul><li><a href=1>some link</a><li><a href=2>other link</a></ul></section></article>") == ["text"]
    for name in ('id="comments"', 'class="comment-list"', 'class="ad"', 'class="cookie-notice"', 'class="social-share"', 'role="navigation"'):
        assert main(f"<article><p>text</p><div {name}><p>words</p></div></article>") == ["text"]


def test_seeds_cover_what_the_suffix_array_covers():
    rng = np.random.default_rng(7)
    for _ in range(60):
        streams = [rng.integers(0, 4, rng.integers(1, 14)).tolist() for _ in range(rng.integers(2, 6))]
        words = {v: int(rng.integers(1, 10)) for v in range(4)}
        pages = [(np.array(s, np.uint64), np.array([words[v] for v in s], np.uint8)) for s in streams]
        keys, held = h._counts([h.keys_of(*p) for p in pages])
        for (s, w), want in zip(pages, naive_covered(streams, [[words[v] for v in s] for s in streams])):
            key, first, end = h.seeds(s, w)
            got = {t for k, a, b in zip(key, first, end) if k in keys for t in range(a, b)}
            assert got == want


def test_a_run_on_two_of_many_pages_goes_whatever_the_shards(spark, monkeypatch):
    frame = "<div>Welcome to our big example web site, the best place to read.</div><p>Number {0} is unique here, {0} times over and {0} again.</p><p>{1}</p>"
    twice = "This very sentence stands on only two pages of the whole large host."
    pages = [(i, f"http://a.example/{i}", frame.format(i, twice if i in (3, 1100) else f"Page {i} alone says this and {i} more words than that."), "", "", 0) for i in range(1200)]
    pages += [(5000 + i, f"http://a.example/c{i}", frame.format(7, "Page 7 alone says this and 7 more words than that."), "", "", 0) for i in range(50)]
    results = []
    for shard in (10, 500, 2000):
        monkeypatch.setattr(h, "PAGES_PER_SHARD", shard)
        results.append({r.page_id: r.text for r in h.extract(spark.createDataFrame(pages, COLUMNS).repartition(8)).collect()})
    assert results[0] == results[1] == results[2] and len(results[0]) == 1250
    assert results[0][3] == "Number 3 is unique here, 3 times over and 3 again." and "only two pages" not in results[0][1100]
    assert all(twice not in t and "Welcome" not in t for t in results[0].values()) and "Page 7 alone" in results[0][5001]
