"""Document-level extraction as DataFrame jobs: keywords, dictionary and fuzzy skills,
résumé sections, education entries, positions and years of experience, job titles.

Per-document work that needs several rows of one document (n-gram counts, line
islands) is done after ``repartition(id)``: the text is shuffled once (smaller than
exploded tokens) and every later aggregate and window on ``id`` reuses that
partitioning, so no further exchange is planned.
"""

from __future__ import annotations

from collections import Counter
from heapq import nlargest, nsmallest

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import catalog as cat
from ..functions import text as tx
from .partitioning import spread
from .topk import top_k_per


def by_doc(docs: DataFrame, id_col: str) -> DataFrame:
    return spread(docs, id_col)


# ------------------------------------------------------------------ keywords ---

def keyword_counts(docs: DataFrame, id_col: str, text_col: str, clean: bool = True) -> DataFrame:
    """(id, keyword, count) over 1-3-grams of tokens with stop words removed first."""
    t = tx.clean_text(F.col(text_col)) if clean else F.col(text_col)
    # tokens become a column before the n-gram lambdas read them: a lambda over an
    # expression would re-evaluate the whole regex pipeline for every n-gram
    toks = (by_doc(docs.select(id_col, text_col), id_col)
            .select(id_col, tx.drop_stop_words(tx.tokens(t)).alias("toks")))
    return (toks.select(id_col, F.explode(tx.ngrams(F.col("toks"))).alias("keyword"))
                .groupBy(id_col, "keyword").agg(F.count(F.lit(1)).alias("count")))


def top_keywords(docs: DataFrame, id_col: str, text_col: str, k: int = 20) -> DataFrame:
    """Top-k n-grams per document by count (ties by keyword).

    The texts of an id are one group, whose n-grams are counted there: no row is formed, sorted or spilled for
    an n-gram that is not among the first k."""
    # stop words drop out in the helper below: a text's tokens travel as one string
    toks = (by_doc(docs.select(id_col, text_col), id_col)
            .select(id_col, F.array_join(tx.tokens(tx.clean_text(F.col(text_col))), " ").alias("toks"))
            .groupBy(id_col).agg(_first_ngrams(k)(F.col("toks")).alias("first")))
    first = toks.select(id_col, F.inline("first"))
    return top_k_per(first, [id_col], [F.col("count").desc(), F.col("keyword")], k)


def _first_ngrams(k: int):
    """The first ``k`` 1-3-grams, by count and keyword, of the texts of a group (tokens joined by blanks)."""
    stop = frozenset(cat.KEYWORD_STOP_WORDS)

    def first(texts: pa.Array) -> list:
        parts = [[w for w in (text.as_py() or "").split(" ") if w and w not in stop] for text in texts]
        count = Counter()
        for toks in parts:
            count.update(toks)
        if not count:
            return []
        # an n-gram is at most as frequent as its words: with k words ahead, those of rarer words do not matter
        least = nlargest(k, count.values())[-1] if len(count) >= k else 1
        often = {w for w, n in count.items() if n >= least}
        for toks in parts:
            known = [w in often for w in toks]
            pairs = [(a, b) for a, b, x, y in zip(toks, toks[1:], known, known[1:]) if x and y]
            count.update(map(" ".join, pairs))
            count.update([f"{a} {b} {c}" for a, b, c, x, y, z in zip(toks, toks[1:], toks[2:], known, known[1:], known[2:]) if x and y and z])
        least = nlargest(k, count.values())[-1]
        sure = [(w, n) for w, n in count.items() if n > least]
        # code points sort as their UTF-8 bytes do
        ties = nsmallest(k - len(sure), (w for w, n in count.items() if n == least))
        return [{"keyword": w, "count": n} for w, n in [*sure, *((w, least) for w in ties)]]

    schema = "array<struct<keyword:string,count:bigint>>"
    return F.arrow_udf(first, schema)


# -------------------------------------------------------------------- skills ---

PUNCT = r"[!-/:-@\[-`{-~]"


def candidate_phrases(docs: DataFrame, id_col: str, clean_col: str) -> DataFrame:
    """(id, phrase, first_pos): distinct 1-3-word phrases of the cleaned text that are not a stop
    word and contain no ASCII punctuation (candidates for fuzzy skills)."""
    # tokens become a column before they are read by place: an expression beside posexplode would run again for every token
    toks = docs.select(id_col, tx.tokens(F.col(clean_col)).alias("toks")).where(F.size("toks") > 0)
    of = lambda i, n: F.when(i + n <= F.size("toks"), F.array_join(F.slice("toks", i + 1, n), " "))
    per_start = F.transform(F.sequence(F.lit(0), F.size("toks") - 1), lambda i: F.transform(
        F.array(*[of(i, n) for n in (1, 2, 3)]), lambda p: F.struct(i.alias("i"), p.alias("phrase"))))
    phrases = toks.select(id_col, F.explode(F.flatten(per_start)).alias("p")).select(id_col, "p.i", "p.phrase")
    ok = (F.col("phrase").isNotNull() & ~F.col("phrase").isin(*cat.ENGLISH_STOP_WORDS)
          & ~F.col("phrase").rlike(PUNCT))
    return (phrases.where(ok).groupBy(id_col, "phrase").agg(F.min("i").alias("first_pos")))


def fuzzy_phrases(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, phrase, first_pos): the candidate phrases of the texts that are near a dictionary entry."""
    # spread the texts first: an input of few files would be cleaned in as many tasks
    cleaned = by_doc(docs.select(id_col, text_col), id_col).select(id_col, tx.clean_text(F.col(text_col)).alias("clean"))
    cand = candidate_phrases(cleaned, id_col, "clean")
    hits = fuzzy_dictionary_hits(cand).checkpoint(eager=True)
    small = hits.limit(SMALL_HITS + 1).count() <= SMALL_HITS
    return cand.join(F.broadcast(hits) if small else hits, "phrase", "left_semi").select(id_col, "phrase", "first_pos")


def posting_years(docs: DataFrame, id_col: str, text_col: str, open_end_year: int) -> DataFrame:
    """(id, years): the years of experience each text asks for."""
    cleaned = by_doc(docs.select(id_col, text_col), id_col).select(id_col, tx.clean_text(F.col(text_col)).alias("clean"))
    return cleaned.select(id_col, tx.posting_years(F.col("clean"), open_end_year).cast("long").alias("years"))


SMALL_HITS = 200_000
REPEATS = 3          # occurrences of a character that the letter bound tells apart


def _letters(value: Column) -> list[Column]:
    """For i = 1 .. REPEATS, 64 bits that tell (by a hash) which characters occur at least i times."""
    chars = F.split(value, "")
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(x), F.lit(64)))
    def at_least(i: int) -> Column:
        often = chars if i == 1 else F.filter(chars, lambda x: F.size(F.filter(chars, lambda y: y == x)) >= i)
        return F.aggregate(often, F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(bit(x)))
    return [at_least(i).alias(f"_m{i}") for i in range(1, REPEATS + 1)]


def fuzzy_dictionary_hits(phrases: DataFrame, threshold: float = 0.6, strict: bool = True) -> DataFrame:
    """Distinct phrases whose Levenshtein ratio to some dictionary entry exceeds ``threshold``.

    The dictionary is a fixed 148-entry list, so broadcasting it is size-bounded.  Before a distance is
    computed, the lengths must allow it, and so must the letters: each character that one side has more
    often than the other takes an edit."""
    spark = phrases.sparkSession
    entries = spark.createDataFrame([(p,) for p in cat.SKILL_PATTERNS], "entry string")
    dic = F.broadcast(entries.select("entry", *[m.alias(f"_e{i}") for i, m in enumerate(_letters(F.col("entry")), 1)]))
    # dealt by phrase into all tasks: few bytes, but much to compute
    p = spread(phrases.select("phrase"), "phrase").distinct().select("phrase", *_letters(F.col("phrase")))
    la, lb = F.length("phrase"), F.length("entry")
    longest = F.greatest(la, lb)
    edits = (1 - threshold) * longest
    allows = lambda n: n < edits if strict else n <= edits
    more = lambda x, y: sum((F.bit_count(F.col(f"_{x}{i}").bitwiseAND(F.bitwise_not(F.col(f"_{y}{i}")))) for i in range(1, REPEATS + 1)), F.lit(0))
    ratio = F.lit(1.0) - F.levenshtein("phrase", "entry").cast("double") / longest.cast("double")
    keep = (ratio > threshold) if strict else (ratio >= threshold)
    # a hair of slack against rounding: what passes is computed exactly
    near = allows(F.abs(la - lb)) & (F.greatest(more("m", "e"), more("e", "m")) <= edits + 1e-9)
    return p.join(dic, near & keep, "left_semi").select("phrase")


def _phrases_in_order(toks: Column) -> Column:
    """Distinct 1-3-word phrases of a token array in (start, length) order, without stop-word
    phrases or phrases with ASCII punctuation.  ``toks`` must be a column reference."""
    n = F.size(toks)
    per_start = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array(
        *[F.when(i + (w - 1) <= n, F.array_join(F.slice(toks, i, w), " ")) for w in (1, 2, 3)]))
    flat = F.when(n > 0, F.flatten(per_start)).otherwise(F.array().cast("array<string>"))
    ok = F.filter(flat, lambda p: p.isNotNull() & ~p.isin(*cat.ENGLISH_STOP_WORDS) & ~p.rlike(PUNCT))
    return F.array_distinct(ok)


def skills_extract(docs: DataFrame, id_col: str, text_col: str, fuzzy: bool = True) -> DataFrame:
    """(id, skill, rank): dictionary skills in dictionary order, then fuzzy phrase skills in text
    order (shorter phrase first at the same position), first occurrence kept.

    One pass over the text: each row yields its dictionary hits and its candidate phrases
    (distinct, in order) as one array, exploded once into an explicitly partitioned exchange.
    The distinct phrases for the dictionary comparison and the per-document ranking both
    read that exchange (the shuffle is reused), so the text is cleaned only once."""
    # spread the texts first: the regex work below is per row, and an input of few files
    # would otherwise run it in as many tasks as there are files
    c1 = by_doc(docs.select(id_col, text_col), id_col).select(id_col, tx.clean_text(F.col(text_col)).alias("clean"))
    c2 = c1.select(id_col, tx.dictionary_items(F.col("clean")).alias("dict"), tx.tokens(F.col("clean")).alias("toks"))
    dict_items = F.transform("dict", lambda d: F.struct(F.lit(0).alias("src"), d["ord"].alias("ord"), d["skill"].alias("skill")))
    if fuzzy:
        c3 = c2.select(id_col, "dict", _phrases_in_order(F.col("toks")).alias("ph"))
        ph_items = F.transform("ph", lambda p, i: F.struct(F.lit(1).alias("src"), i.cast("long").alias("ord"),
                                                           p.alias("skill")))
        items = F.concat(dict_items, ph_items)
    else:
        c3 = c2
        items = dict_items
    rows = spread(c3.select(id_col, F.explode(items).alias("it")).select(id_col, "it.*"), id_col)
    if fuzzy:
        hits = fuzzy_dictionary_hits(rows.where(F.col("src") == 1).select(F.col("skill").alias("phrase"))).checkpoint(eager=True)
        # phrases near a 148-entry dictionary: few, so the rows need not be dealt by phrase; checked all the same
        small = hits.limit(SMALL_HITS + 1).count() <= SMALL_HITS
        ok = hits.select(F.col("phrase").alias("skill"), F.lit(True).alias("_ok"))
        rows = rows.join(F.broadcast(ok) if small else ok, "skill", "left").where((F.col("src") == 0) | F.col("_ok").isNotNull()).drop("_ok")
    w = Window.partitionBy(id_col, "skill").orderBy("src", "ord")
    first = rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    rank = Window.partitionBy(id_col).orderBy("src", "ord")
    return first.select(id_col, "skill", F.row_number().over(rank).cast("long").alias("rank"))


# ------------------------------------------------------------------ sections ---

def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, line, n_lines): lines of each text split on '\\n', 0-based positions."""
    parts = F.split(F.col(text_col), "\n", -1)
    return by_doc(docs.select(id_col, text_col), id_col).select(
        id_col, F.posexplode(parts).alias("pos", "line"), F.size(parts).alias("n_lines"))


def resume_sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Gaps-and-islands over lines: a header line opens a section that runs to the next header.
    (id, section, start_line, end_line, content, first_seen).  Sections without content are
    dropped; a header text seen again replaces the earlier section (last wins), keeping the
    position where the header was first stored."""
    ln = lines(docs, id_col, text_col).withColumn("is_header", tx.is_section_header(F.col("line")))
    w = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ln = ln.withColumn("sid", F.sum(F.col("is_header").cast("int")).over(w))
    headers = ln.where("is_header").select(id_col, "sid", tx.py_strip(F.col("line")).alias("section"),
                                          F.col("pos").alias("start_line"), "n_lines")
    nxt = Window.partitionBy(id_col).orderBy("sid")
    headers = headers.withColumn("end_line", F.coalesce(F.lead("start_line").over(nxt), F.col("n_lines")))
    content = (ln.where(~F.col("is_header") & (F.col("sid") > 0))
                 .groupBy(id_col, "sid")
                 .agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("_l")))
    sec = headers.join(content, [id_col, "sid"]).select(
        id_col, "sid", "section", "start_line", "end_line",
        F.array_join(F.transform("_l", lambda s: s["line"]), "\n").alias("content"))
    last = Window.partitionBy(id_col, "section").orderBy(F.col("sid").desc())
    first_seen = F.min("sid").over(Window.partitionBy(id_col, "section"))
    return (sec.withColumn("first_seen", first_seen).withColumn("_r", F.row_number().over(last))
               .where("_r = 1").drop("_r", "sid"))


def section_interval(sections: DataFrame, id_col: str, word: str) -> DataFrame:
    """(id, start_line, end_line) of the last stored section whose header contains ``word``."""
    s = sections.where(F.lower("section").contains(word))
    w = Window.partitionBy(id_col).orderBy(F.col("first_seen").desc())
    return (s.withColumn("_r", F.row_number().over(w)).where("_r = 1")
             .select(id_col, "start_line", "end_line"))


def education_entries(docs: DataFrame, id_col: str, text_col: str, sections: DataFrame | None = None) -> DataFrame:
    """(id, entry_no, entry): paragraphs of the education section (header line included),
    each run of non-blank stripped lines joined by a space."""
    sec = sections if sections is not None else resume_sections(docs, id_col, text_col)
    iv = section_interval(sec, id_col, "education")
    ln = lines(docs, id_col, text_col).join(iv, id_col).where(
        (F.col("pos") >= F.col("start_line")) & (F.col("pos") < F.col("end_line")))
    ln = ln.withColumn("s", tx.py_strip(F.col("line")))
    w = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ln = ln.withColumn("island", F.sum((F.col("s") == "").cast("int")).over(w))
    ent = (ln.where(F.col("s") != "").groupBy(id_col, "island")
             .agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("_l")))
    num = Window.partitionBy(id_col).orderBy("island")
    return ent.select(id_col, F.row_number().over(num).cast("long").alias("entry_no"),
                      F.array_join(F.transform("_l", lambda x: x["s"]), " ").alias("entry"))


def education_sentences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, sentence_no, sentence) for sentences containing an education keyword as a substring."""
    s = by_doc(docs.select(id_col, text_col), id_col).select(
        id_col, F.posexplode(tx.sentences(F.col(text_col))).alias("sentence_no", "sentence"))
    return s.where(tx.has_education_keyword(F.col("sentence"))).select(
        id_col, F.col("sentence_no").cast("long").alias("sentence_no"), "sentence")


# ----------------------------------------------------------------- positions ---

def _month_year(s: Column):
    return (F.split_part(s, F.lit("/"), F.lit(1)).try_cast("int"),
            F.split_part(s, F.lit("/"), F.lit(2)).try_cast("int"))


def resume_positions(docs: DataFrame, id_col: str, text_col: str, as_of: str,
                     sections: DataFrame | None = None) -> DataFrame:
    """(id, line_no, title, start, end, period) for lines of the experience section (all lines
    when there is none) holding a 'MM/YYYY - MM/YYYY|present|now' range.  Months are
    (Δyear·12 + Δmonth), negative periods kept; dates are month starts; open ends use ``as_of``.
    Lines whose month is not 1-12 are skipped as unparseable."""
    sec = sections if sections is not None else resume_sections(docs, id_col, text_col)
    iv = section_interval(sec, id_col, "experience")
    ln = lines(docs, id_col, text_col).join(iv, id_col, "left").where(
        F.col("start_line").isNull() | ((F.col("pos") >= F.col("start_line")) & (F.col("pos") < F.col("end_line"))))
    pat = "(?i)^(.*?)" + tx.RE_POSITION
    m = ln.where(F.col("line").rlike("(?i)" + tx.RE_POSITION)).select(
        id_col, "pos",
        F.regexp_extract("line", pat, 1).alias("prefix"),
        F.regexp_extract("line", pat, 2).alias("s"),
        F.regexp_extract("line", pat, 3).alias("e"))
    sm, sy = _month_year(F.col("s"))
    open_end = F.lower("e").isin("present", "now")
    asof = F.lit(as_of).cast("date")
    em = F.when(open_end, F.month(asof)).otherwise(_month_year(F.col("e"))[0])
    ey = F.when(open_end, F.year(asof)).otherwise(_month_year(F.col("e"))[1])
    valid = sm.between(1, 12) & em.between(1, 12) & sy.isNotNull() & ey.isNotNull()
    return (m.where(valid).select(
        id_col, F.col("pos").cast("long").alias("line_no"), tx.py_strip(F.col("prefix")).alias("title"),
        F.make_date(sy, sm, F.lit(1)).cast("string").alias("start"),
        F.when(open_end, asof).otherwise(F.make_date(ey, em, F.lit(1))).cast("string").alias("end"),
        ((ey - sy) * 12 + (em - sm)).cast("long").alias("period")))


def resume_yoe(docs: DataFrame, id_col: str, text_col: str, as_of: str,
               positions: DataFrame | None = None) -> DataFrame:
    """(id, yoe): Σ max(period, 0) / 12 rounded to 2; 0 without positions."""
    pos = positions if positions is not None else resume_positions(docs, id_col, text_col, as_of)
    tot = pos.groupBy(id_col).agg(F.sum(F.greatest(F.col("period"), F.lit(0))).alias("months"))
    return (docs.select(id_col).join(tot, id_col, "left")
                .select(id_col, F.round(F.coalesce(F.col("months"), F.lit(0)) / 12.0, 2).alias("yoe")))


# -------------------------------------------------------------------- titles ---

def _word_index(words: list[str], w: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in words]), w)


def job_titles(docs: DataFrame, id_col: str, text_col: str, k: int = 5) -> DataFrame:
    """(id, rank, title): up to k distinct title matches, shortest first; equally long titles
    keep the order of (prefix, domain, specialty) in the title vocabulary, then text order."""
    m = by_doc(docs.select(id_col, text_col), id_col).select(
        id_col, F.posexplode(tx.title_matches(F.col(text_col))).alias("at", "title"))
    norm = F.regexp_replace(F.lower("title"), r"\s+", " ")
    words = F.split(norm, " ")
    last = F.element_at(words, -1)
    first = F.element_at(words, 1)
    has_prefix = first.isin(*cat.JOB_PREFIXES) & (F.size(words) > 1)
    middle = F.array_join(F.slice(words, F.when(has_prefix, 2).otherwise(1),
                                  F.size(words) - F.when(has_prefix, 2).otherwise(1)), " ")
    prefix_rank = F.when(has_prefix, _word_index(cat.JOB_PREFIXES, first)).otherwise(0)
    spec_rank = F.when(middle == "", 0).otherwise(_word_index(cat.JOB_SPECIALTIES, middle))
    m = m.select(id_col, "title", "at", F.length("title").alias("len"), prefix_rank.alias("pr"),
                 _word_index(cat.JOB_DOMAINS, last).alias("dr"), spec_rank.alias("sr"))
    w1 = Window.partitionBy(id_col, "title").orderBy("len", "pr", "dr", "sr", "at")
    firsts = m.withColumn("_r", F.row_number().over(w1)).where("_r = 1")
    top = top_k_per(firsts, [id_col], ["len", "pr", "dr", "sr", "at"], k)
    return top.select(id_col, "rank", "title")
