"""Text operators on small literal documents, including the documented quirks."""

from pyspark.sql import functions as F

from jobloom.functions import catalog as cat
from jobloom.functions import text as tx
from jobloom.operators import documents as dc
from jobloom.sources import ingest as ig


def one(spark, col, text):
    return spark.createDataFrame([(text,)], "t string").select(col(F.col("t"))).first()[0]


def test_clean_text(spark):
    t = "Call (555) 123-4567 or  mail a.b@x.com\n\nSee https://x.io/a now"
    assert one(spark, tx.clean_text, t) == "call  or mail  see  now"


def test_dictionary_skill_boundaries(spark):
    assert one(spark, tx.dictionary_skills, "we use c++11 daily") == [r"c\+\+"]
    assert one(spark, tx.dictionary_skills, "we use c++ daily") == []
    assert one(spark, tx.dictionary_skills, "nodexjs") == ["node.js"]


def test_dictionary_order(spark):
    got = one(spark, tx.dictionary_skills, "sql server and python")
    assert got == ["python", "sql", "sql server"]


def test_top_keywords_bridge_stop_words(spark):
    df = spark.createDataFrame([(1, "the cat and the hat; cat hat")], "id long, text string")
    rows = {r.keyword: r["count"] for r in dc.keyword_counts(df, "id", "text").collect()}
    # 'and'/'the' are removed before n-grams, so 'cat hat' bridges them
    assert rows["cat hat"] == 2 and rows["cat"] == 2 and "the" not in rows


def test_sections_islands(spark):
    text = "Name\nWork Experience\nEngineer 01/2020 - 03/2021\n\nEducation\nBSc\nSkills\nSkills\npython"
    df = spark.createDataFrame([(1, text)], "id long, text string")
    secs = {r.section: (r.start_line, r.end_line, r.content) for r in dc.resume_sections(df, "id", "text").collect()}
    assert secs["Work Experience"] == (1, 4, "Engineer 01/2020 - 03/2021\n")
    assert secs["Education"] == (4, 6, "BSc")
    # the first 'Skills' has no content; the second one is kept
    assert secs["Skills"] == (7, 9, "python")


def test_positions_and_yoe(spark):
    text = "Work Experience\nData Engineer 02/2011 - 6/2015\nAnalyst 7/2017 to Present\nBad 13/2020 - 1/2021"
    df = spark.createDataFrame([(1, text)], "id long, text string")
    pos = sorted(dc.resume_positions(df, "id", "text", "2025-06-15").collect(), key=lambda r: r.line_no)
    assert [(p.title, p.period) for p in pos] == [("Data Engineer", 52), ("Analyst", 95)]
    assert dc.resume_yoe(df, "id", "text", "2025-06-15").first().yoe == round(147 / 12, 2)


def test_jd_years(spark):
    f = lambda t: one(spark, lambda c: tx.posting_years(tx.clean_text(c), 2025), t)
    assert f("5+ years of experience, or 3 years in the industry") == 5
    assert f("jan 2000 - mar 2012, feb 2020 to present") == 17
    assert f("no tenure") == 0


def test_titles_shortest_first(spark):
    df = spark.createDataFrame([(1, "Senior Data Engineer and data engineer; Lead Engineer")], "id long, text string")
    got = [r.title for r in sorted(dc.job_titles(df, "id", "text").collect(), key=lambda r: r.rank)]
    # equal lengths keep pattern order: no prefix before "lead", then text order
    assert got == ["Engineer", "engineer", "Data Engineer", "data engineer", "Lead Engineer"]


def article(spark, html, css=None):
    return one(spark, lambda c: tx.html_article_text(c, css), html)


def test_html_article_is_its_last_child(spark):
    assert article(spark, "<nav>x</nav><article><h1>T</h1><div><p>a &amp; b<br>c</p><ul><li>one</li><li>two</li></ul></div></article>") == "a & b\nc\n- one\n- two"
    assert article(spark, "<article><div>meta</div><div>desc</div></article>") == "desc"
    assert article(spark, "<ARTICLE class=x><Div>up</DIV></ARTICLE>tail") == "up"
    assert article(spark, "<article><div>never closed <b>here") == "never closed\nhere"
    assert article(spark, "<article><div><article><p>inner</p></article> outer</div></article>") == "inner\nouter"
    assert article(spark, "<article><div>a<script>var x=1;</script><style>p{}</style>b<!-- c --></div></article>") == "a\nb"
    assert article(spark, "<article>bare text</article>") == "" and article(spark, "<p>none</p>") == "" and article(spark, None) == ""
    assert article(spark, "<article><p>one</article><article><p>two</article>") == "one"
    assert article(spark, "<article class='a'><p>one</article><article id=q class='b jobDescription_x'><p>two</article>", "jobDescription") == "two"
    assert article(spark, "<div><article><p>in</div> out</article>") == "in"          # the end of the outer element ends the article
    assert article(spark, "<article><p>a<hr><p title=it's>b > c</article>") == "a\nb > c"


def test_html_article_lists(spark):
    assert article(spark, "<article><div>x<ul> <li> a <b>b</b></li><li>c<ul><li>d</li></ul></li></ul>y</div></article>") == "x\n- ab\n- cd\n- d\ny"
    assert article(spark, "<article><ul><li>a</li><li>b</li></ul></article>") == "a\nb"      # the child itself is no list inside it
    assert article(spark, "<article><div><ul>loose</ul>z<ul><li>last") == "z\n- last"


def test_character_references(spark):
    f = lambda t: one(spark, tx.decode_references, t)
    assert f("caf&eacute; &#233;&#xE9;&#XE9 &mdash;&amp;lt; &nope; & &; &#0; &#x1F600; &#150;&#x96; &apos;") == "café ééé —&lt; &nope; & &; � 😀 –– '"
    assert f("no reference") == "no reference" and f("") == "" and f("&#99999999999;") == "�"


def test_truncation(spark):
    df = spark.createDataFrame([("ab",), ("abcdef",)], "t string")
    assert [r[0] for r in df.select(ig.drop_last_third(F.col("t"))).collect()] == ["", "abcd"]


def test_fixed_boundary_mode(spark):
    f = lambda t: one(spark, lambda c: tx.dictionary_skills(c, boundary="fixed"), t)
    assert f("we use c++ daily") == [r"c\+\+"]
    assert f("we use c++11 daily") == []
    assert f("python3 and python") == ["python"]


def test_phrase_index_agrees_with_one_regex_an_entry(spark):
    import random
    rnd = random.Random(8)
    words = ["python", "Machine", "learning", "c++", "c#", "C++11", "node.js", "nodexjs", "ci/cd", "asp.net", "scikit-learn", "scikit", "learn", "sql", "server",
             "attention", "to", "detail", "self-motivation", "r", "r2r", "go", "big", "data", "mining", "_ai", "ai", "é", "x", "statistical", "process", "control"]
    texts = ["".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "-", "/", ", ", "  ", "", "\n", "."]) for _ in range(rnd.randint(0, 14))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,), ("",)], "t string")
    for boundary in ("strict", "fixed"):
        plain = F.array_compact(F.array(*[F.when(F.col("t").rlike(tx.skill_pattern(p, boundary)), F.lit(p)) for p in cat.SKILL_PATTERNS]))
        rows = df.select("t", tx.dictionary_skills("t", boundary=boundary).alias("got"), plain.alias("want")).collect()
        assert [r.got or [] for r in rows] == [r.want or [] for r in rows], boundary
        assert sum(len(r.want or []) for r in rows) > 500


def test_texts_are_dealt_before_they_are_cleaned(spark):
    from tests.conftest import SF_SMALL
    import __spark_entry__ as E
    assert E.queries()["jd_years"](spark, SF_SMALL).rdd.getNumPartitions() == 4      # one file was one task


def test_tokens_are_cut_once_a_text(spark):
    from jobloom.operators import documents as dc
    df = spark.createDataFrame([(1, "gear red")], "id long, clean string")
    plan = dc.candidate_phrases(df, "id", "clean")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan[:plan.rindex("Generate")]       # nothing of it is left for the exploded rows


def test_candidate_phrases_of_short_texts(spark):
    from jobloom.operators import documents as dc
    df = spark.createDataFrame([(1, "gear red gear red"), (2, ""), (3, None), (4, "blue")], "id long, clean string")
    got = {(r.id, r.phrase): r.first_pos for r in dc.candidate_phrases(df, "id", "clean").collect()}
    assert got == {(1, "gear"): 0, (1, "gear red"): 0, (1, "gear red gear"): 0, (1, "red"): 1, (1, "red gear"): 1,
                   (1, "red gear red"): 1, (4, "blue"): 0}


def test_top_keywords_count_all_rows_of_an_id_and_form_no_row_for_a_rare_ngram(spark):
    from collections import Counter
    rows = [(1, "river mill river mill stone"), (1, "mill stone é " + " ".join(f"w{i}" for i in range(300))), (2, None), (3, ""), (None, "river boat"), (None, "boat")]
    df = spark.createDataFrame(rows, "id bigint, text string").repartition(3)
    want = {}
    for i, text in rows:
        t = [w for w in (text or "").split() if len(w) > 1]
        want.setdefault(i, Counter()).update(" ".join(t[a:a + n]) for n in (1, 2, 3) for a in range(len(t) - n + 1))
    want = {(i, r, w, n) for i, c in want.items() for r, (w, n) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:20], 1)}
    out = dc.top_keywords(df, "id", "text")
    assert {(r.id, r["rank"], r.keyword, r["count"]) for r in out.collect()} == want
    # the explosion of every n-gram is what spilled on larger tables
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan.lower().replace("inline", "")


def test_collapsing_only_what_changes_is_the_same(spark):
    texts = [" a", "a  b", "a\t b", "a \n\u00a0 b ", "a b c", "\u3000x", "  ", "a \x85", "\x1c \x1d y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select(F.regexp_replace("t", tx.RE_SPACES, " ").alias("a"), F.regexp_replace("t", tx.RE_SPACES_CHANGED, " ").alias("b")).collect()
    assert all(r.a == r.b for r in out)
