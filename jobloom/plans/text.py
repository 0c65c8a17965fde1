"""Text queries: cleaning, keywords, skills, sections, education, years, titles, HTML."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import catalog as cat
from ..functions import text as tx
from ..operators import documents as dc
from ..sources.fixtures import Ats
from .registry import register

AS_OF = "2025-06-15"
OPEN_END_YEAR = 2025


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(_q(w) for w in words) + "]"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{tx.WS}+|{tx.WS}+$', '', 'g')"


def sql_clean(x: str) -> str:
    t = f"lower({x})"
    t = f"regexp_replace({t}, '{tx.RE_NEWLINES}', chr(10), 'g')"
    t = f"regexp_replace({t}, '{tx.RE_SPACES}', ' ', 'g')"
    t = f"regexp_replace({t}, '{tx.RE_URL}', '', 'g')"
    t = f"regexp_replace({t}, '{tx.RE_EMAIL}', '', 'g')"
    return f"regexp_replace({t}, '{tx.RE_PHONE}', '', 'g')"


STOP_SQL = _list(cat.KEYWORD_STOP_WORDS)


def sql_ngrams(toks: str) -> str:
    parts = []
    for n in (1, 2, 3):
        parts.append(f"case when len({toks}) >= {n} then list_transform(range(1, len({toks}) - {n - 2}), "
                     f"lambda i: array_to_string(list_slice({toks}, i, i + {n - 1}), ' ')) else [] end")
    return "list_concat(" + ", ".join(parts) + ")"


def sql_top_keywords(src: str, id_col: str, text_col: str, k: int = 20) -> str:
    return f"""
kw_t as (select {id_col}, list_filter(regexp_extract_all(lower({sql_clean(text_col)}), '{tx.RE_TOKEN}'),
                  lambda x: not list_contains({STOP_SQL}, x)) as toks from {src}),
kw_g as (select {id_col}, unnest({sql_ngrams('toks')}) as keyword from kw_t),
kw_c as (select {id_col}, keyword, count(*) as count from kw_g group by {id_col}, keyword),
kw_r as (select *, row_number() over (partition by {id_col} order by count desc, keyword) as rank from kw_c),
kw as (select {id_col}, keyword, count, cast(rank as bigint) as rank from kw_r where rank <= {k})"""


@register("clean_text", sql=f"""
select job_id, {sql_clean('text')} as clean from ats_postings""")
def q_clean_text(spark, sf_dir):
    """lower-case, collapse whitespace, drop URLs, e-mail addresses and phone numbers."""
    a = Ats(spark, sf_dir)
    return a.ats_postings.select("job_id", tx.clean_text(F.col("text")).alias("clean"))


@register("top_keywords", sql=f"""
with {sql_top_keywords('documents', 'doc_id', 'text')}
select * from kw""")
def q_top_keywords(spark, sf_dir, k: int = 20):
    """Top-20 1-3-grams per document (whole texts), stop words removed before n-grams."""
    a = Ats(spark, sf_dir)
    return dc.top_keywords(a.documents, "doc_id", "text", k)


ENTRIES_SQL = f"(select unnest({_list(cat.SKILL_PATTERNS)}) as entry, unnest(range(0, {len(cat.SKILL_PATTERNS)})) as idx)"
PUNCT = r"[!-/:-@\[-`{-~]"


def sql_skills(src: str, id_col: str, text_col: str) -> str:
    return f"""
sk_d as (select {id_col}, {sql_clean(text_col)} as clean from {src}),
sk_dict as (select d.{id_col}, e.entry as skill, 0 as src, cast(e.idx as bigint) as ord, 0 as n_words from sk_d d, {ENTRIES_SQL} e
            where regexp_matches(d.clean, '(?i)\\b' || e.entry || '\\b')),
sk_tok as (select {id_col}, regexp_extract_all(clean, '{tx.RE_TOKEN}') as toks from sk_d),
sk_pos as (select {id_col}, toks, unnest(range(0, len(toks))) as i from sk_tok),
sk_ph as (select {id_col}, i, unnest([array_to_string(list_slice(toks, i + 1, i + 1), ' '),
                                     case when i + 2 <= len(toks) then array_to_string(list_slice(toks, i + 1, i + 2), ' ') end,
                                     case when i + 3 <= len(toks) then array_to_string(list_slice(toks, i + 1, i + 3), ' ') end]) as phrase
          from sk_pos),
sk_cand as (select {id_col}, phrase, min(i) as first_pos from sk_ph
            where phrase is not null and not list_contains({_list(cat.ENGLISH_STOP_WORDS)}, phrase)
              and not regexp_matches(phrase, '{PUNCT}')
            group by {id_col}, phrase),
sk_fz as (select c.{id_col}, c.phrase as skill, 1 as src, cast(c.first_pos as bigint) as ord,
                 len(string_split(c.phrase, ' ')) as n_words from sk_cand c
          where exists (select 1 from {ENTRIES_SQL} e
                        where abs(length(c.phrase) - length(e.entry)) < 0.4 * greatest(length(c.phrase), length(e.entry))
                          and 1.0 - levenshtein(c.phrase, e.entry) / greatest(length(c.phrase), length(e.entry)) > 0.6)),
sk_all as (select * from sk_dict union all select * from sk_fz),
sk_first as (select *, row_number() over (partition by {id_col}, skill order by src, ord, n_words) as r from sk_all),
sk as (select {id_col}, skill, cast(row_number() over (partition by {id_col} order by src, ord, n_words) as bigint) as rank
       from sk_first where r = 1)"""


@register("skills_extract", sql=f"""
with {sql_skills('ats_postings', 'job_id', 'text')}
select * from sk""")
def q_skills_extract(spark, sf_dir):
    """Dictionary skills (whole-word regex per entry) then fuzzy phrase skills, deduplicated
    in order, per posting."""
    a = Ats(spark, sf_dir)
    return dc.skills_extract(a.ats_postings, "job_id", "text")


@register("fuzzy_phrase_skills", sql=f"""
with {sql_skills('ats_postings', 'job_id', 'text')}
select job_id, skill as phrase, ord as first_pos from sk_fz""")
def q_fuzzy_phrase_skills(spark, sf_dir):
    """Candidate phrases (1-3 words, not a stop word, no punctuation) whose Levenshtein ratio
    to some dictionary entry is above 0.6."""
    a = Ats(spark, sf_dir)
    return dc.fuzzy_phrases(a.ats_postings, "job_id", "text").withColumn("first_pos", F.col("first_pos").cast("long"))


def sql_lines(src: str, id_col: str, text_col: str) -> str:
    return f"""
ln as (select {id_col}, unnest(range(0, len(string_split({text_col}, chr(10))))) as pos,
              unnest(string_split({text_col}, chr(10))) as line,
              len(string_split({text_col}, chr(10))) as n_lines from {src})"""


def sql_sections(src: str, id_col: str, text_col: str) -> str:
    hdr = " or ".join(f"contains({sql_strip('lower(line)')}, {_q(s)})" for s in cat.RESUME_SECTIONS)
    return f"""{sql_lines(src, id_col, text_col)},
lh as (select *, ({hdr}) as is_header from ln),
ls as (select *, sum(case when is_header then 1 else 0 end) over (partition by {id_col} order by pos
                 rows between unbounded preceding and current row) as sid from lh),
hd as (select {id_col}, sid, {sql_strip('line')} as section, pos as start_line,
              coalesce(lead(pos) over (partition by {id_col} order by sid), n_lines) as end_line
       from ls where is_header),
ct as (select {id_col}, sid, string_agg(line, chr(10) order by pos) as content from ls
       where not is_header and sid > 0 group by {id_col}, sid),
sc as (select hd.*, ct.content from hd join ct using ({id_col}, sid)),
sc2 as (select *, min(sid) over (partition by {id_col}, section) as first_seen,
               row_number() over (partition by {id_col}, section order by sid desc) as r from sc),
sections as (select {id_col}, section, start_line, end_line, content, first_seen from sc2 where r = 1)"""


@register("resume_sections", sql=f"""
with {sql_sections('ats_resumes', 'applicant_id', 'text')}
select applicant_id, section, cast(start_line as bigint) as start_line, cast(end_line as bigint) as end_line,
       content, cast(first_seen as bigint) as first_seen from sections""")
def q_resume_sections(spark, sf_dir):
    """Résumé sections as line islands (header, line interval, content)."""
    a = Ats(spark, sf_dir)
    s = dc.resume_sections(a.ats_resumes, "applicant_id", "text")
    return s.select("applicant_id", "section", F.col("start_line").cast("long").alias("start_line"),
                    F.col("end_line").cast("long").alias("end_line"), "content",
                    F.col("first_seen").cast("long").alias("first_seen"))


def sql_interval(word: str, id_col: str) -> str:
    return f"""(select {id_col}, start_line, end_line from (select *, row_number() over
      (partition by {id_col} order by first_seen desc) as r from sections where contains(lower(section), '{word}')) x
      where r = 1)"""


@register("education_entries", sql=f"""
with {sql_sections('ats_resumes', 'applicant_id', 'text')},
iv as {sql_interval('education', 'applicant_id')},
el as (select ln.applicant_id, ln.pos, {sql_strip('ln.line')} as s from ln join iv using (applicant_id)
       where ln.pos >= iv.start_line and ln.pos < iv.end_line),
ei as (select *, sum(case when s = '' then 1 else 0 end) over (partition by applicant_id order by pos
               rows between unbounded preceding and current row) as island from el),
ent as (select applicant_id, island, string_agg(s, ' ' order by pos) as entry from ei where s <> '' group by applicant_id, island)
select applicant_id, cast(row_number() over (partition by applicant_id order by island) as bigint) as entry_no, entry from ent""")
def q_education_entries(spark, sf_dir):
    """Education paragraphs from the résumé's education section."""
    a = Ats(spark, sf_dir)
    return dc.education_entries(a.ats_resumes, "applicant_id", "text")


@register("education_sentences", sql=f"""
with s as (select doc_id, unnest(range(0, len(regexp_extract_all(text, '{tx.RE_SENTENCE}')))) as sentence_no,
                  unnest(regexp_extract_all(text, '{tx.RE_SENTENCE}')) as sentence from documents)
select doc_id, cast(sentence_no as bigint) as sentence_no, sentence from s
where {' or '.join(f"contains(lower(sentence), {_q(k)})" for k in cat.EDUCATION_KEYWORDS)}""")
def q_education_sentences(spark, sf_dir):
    """Sentences mentioning an education keyword (substring match), over whole documents."""
    a = Ats(spark, sf_dir)
    return dc.education_sentences(a.documents, "doc_id", "text")


_POS_PAT = "(?i)^(.*?)" + tx.RE_POSITION


def sql_positions(id_col: str) -> str:
    asof = f"date '{AS_OF}'"
    return f"""
ivx as {sql_interval('experience', id_col)},
pl as (select ln.{id_col}, ln.pos, regexp_extract(ln.line, '{_POS_PAT}', 1) as prefix,
              regexp_extract(ln.line, '{_POS_PAT}', 2) as s, regexp_extract(ln.line, '{_POS_PAT}', 3) as e
       from ln left join ivx using ({id_col})
       where (ivx.start_line is null or (ln.pos >= ivx.start_line and ln.pos < ivx.end_line))
         and regexp_matches(ln.line, '(?i){tx.RE_POSITION}')),
pm as (select *, lower(e) in ('present', 'now') as open_end,
              try_cast(split_part(s, '/', 1) as int) as sm, try_cast(split_part(s, '/', 2) as int) as sy,
              case when lower(e) in ('present', 'now') then month({asof}) else try_cast(split_part(e, '/', 1) as int) end as em,
              case when lower(e) in ('present', 'now') then year({asof}) else try_cast(split_part(e, '/', 2) as int) end as ey
       from pl),
positions as (select {id_col}, cast(pos as bigint) as line_no, {sql_strip('prefix')} as title,
              cast(make_date(sy, sm, 1) as varchar) as start,
              case when open_end then cast({asof} as varchar) else cast(make_date(ey, em, 1) as varchar) end as "end",
              cast((ey - sy) * 12 + (em - sm) as bigint) as period
       from pm where sm between 1 and 12 and em between 1 and 12 and sy is not null and ey is not null)"""


@register("resume_positions", sql=f"""
with {sql_sections('ats_resumes', 'applicant_id', 'text')}, {sql_positions('applicant_id')}
select * from positions""")
def q_resume_positions(spark, sf_dir, as_of: str = AS_OF):
    """Dated positions in the experience section: title, start, end, months."""
    a = Ats(spark, sf_dir)
    return dc.resume_positions(a.ats_resumes, "applicant_id", "text", as_of)


@register("resume_yoe", sql=f"""
with {sql_sections('ats_resumes', 'applicant_id', 'text')}, {sql_positions('applicant_id')},
tot as (select applicant_id, sum(greatest(period, 0)) as months from positions group by applicant_id)
select r.applicant_id, round(coalesce(tot.months, 0) / 12.0, 2) as yoe
from ats_resumes r left join tot using (applicant_id)""")
def q_resume_yoe(spark, sf_dir, as_of: str = AS_OF):
    """Years of experience per résumé: non-negative months summed, / 12, 2 decimals."""
    a = Ats(spark, sf_dir)
    return dc.resume_yoe(a.ats_resumes, "applicant_id", "text", as_of)


def sql_jd_years(clean: str) -> str:
    found = "list_concat(" + ", ".join(f"regexp_extract_all({clean}, '{p}', 1)" for p in tx.RE_YEARS) + ")"
    stated = f"coalesce(list_max(list_filter(list_transform({found}, lambda x: try_cast(x as int)), lambda x: x is not null)), 0)"
    starts = f"regexp_extract_all(lower({clean}), '{tx.RE_MONTH_RANGE}', 1)"
    ends = f"regexp_extract_all(lower({clean}), '{tx.RE_MONTH_RANGE}', 2)"
    ranges = (f"coalesce(list_sum(list_transform(range(1, len({starts}) + 1), lambda i: "
              f"case when coalesce({ends}[i], '') = '' then {OPEN_END_YEAR} else cast({ends}[i] as int) end - cast({starts}[i] as int))), 0)")
    return f"case when {stated} > 0 then {stated} else {ranges} end"


@register("jd_years", sql=f"""
with c as (select job_id, {sql_clean('text')} as clean from ats_postings)
select job_id, cast({sql_jd_years('clean')} as bigint) as years from c""")
def q_jd_years(spark, sf_dir, open_end_year: int = OPEN_END_YEAR):
    """Years a posting asks for: max stated 'N years ... experience', else summed month ranges."""
    a = Ats(spark, sf_dir)
    return dc.posting_years(a.ats_postings, "job_id", "text", open_end_year)


def sql_titles(src: str, id_col: str, text_col: str, k: int = 5) -> str:
    shapes = "list_concat(" + ", ".join(f"regexp_extract_all({text_col}, '{p}')" for p in tx.TITLE_SHAPES) + ")"
    return f"""
tm as (select {id_col}, unnest({shapes}) as title, unnest(range(0, len({shapes}))) as at_pos from {src}),
tw as (select *, string_split(regexp_replace(lower(title), '\\s+', ' ', 'g'), ' ') as words from tm),
tr as (select {id_col}, title, at_pos, length(title) as len,
              case when len(words) > 1 and list_contains({_list(cat.JOB_PREFIXES)}, words[1])
                   then list_position({_list(cat.JOB_PREFIXES)}, words[1]) else 0 end as pr,
              list_position({_list(cat.JOB_DOMAINS)}, words[len(words)]) as dr,
              case when len(words) > 1 and list_contains({_list(cat.JOB_PREFIXES)}, words[1])
                   then array_to_string(list_slice(words, 2, len(words) - 1), ' ')
                   else array_to_string(list_slice(words, 1, len(words) - 1), ' ') end as middle from tw),
tr2 as (select *, case when middle = '' then 0 else list_position({_list(cat.JOB_SPECIALTIES)}, middle) end as sr from tr),
tf as (select *, row_number() over (partition by {id_col}, title order by len, pr, dr, sr, at_pos) as r1 from tr2),
tk as (select {id_col}, title, row_number() over (partition by {id_col} order by len, pr, dr, sr, at_pos) as rank from tf where r1 = 1),
titles as (select {id_col}, cast(rank as bigint) as rank, title from tk where rank <= {k})"""


@register("job_titles", sql=f"""
with {sql_titles('ats_postings', 'job_id', 'text')}
select * from titles""")
def q_job_titles(spark, sf_dir):
    """Up to five distinct job titles per text, shortest first."""
    a = Ats(spark, sf_dir)
    return dc.job_titles(a.ats_postings, "job_id", "text")


def _sql_references(x: str) -> str:
    """Character references of ``x`` decoded, in DuckDB SQL."""
    known = "map {" + ", ".join(f"{_q(k)}: {_q(v)}" for k, v in tx.references().items()) + "}"
    name, rest = f"regexp_extract(p, '{tx.RE_REFERENCE}', 1)", f"regexp_replace(p, '{tx.RE_REFERENCE}', '')"
    code = f"case when {name}[2] in ('x', 'X') then try_cast('0x' || {name}[3:] as integer) else try_cast({name}[2:] as integer) end"
    numeric = f"case when {code} between 1 and 1114111 and {code} not between 55296 and 57343 then chr({code}) else chr(65533) end"
    char = f"case when {name}[1] = '#' then coalesce(k['#' || cast({code} as varchar)], {numeric}) else k[{name}] end"
    return f"""(select string_split({x}, '&')[1] || coalesce(array_to_string(list_transform(string_split({x}, '&')[2:],
        lambda p: case when {char} is null then '&' || p else {char} || {rest} end), ''), '') from (select {known} as k))"""


# the walk of html_article_text, one step a token: rows of events instead of a growing text
_SQL_ARTICLE = rf"""
with recursive raw as (select page_id, unnest(toks) as t, generate_subscripts(toks, 1) as pos from (select page_id, regexp_extract_all(html,
    '(?is)<!--.*?-->|<[!?][^>]*>|<(?:script|style|template)\b[^>]*>.*?</(?:script|style|template)\s*>|</?[a-z](?:[^>"''=]|=\s*"[^"]*"|=\s*''[^'']*''|=|["''])*>|[^<]+|<') as toks
    from pages)),
kinds as (select page_id, pos, t, lower(regexp_extract(t, '(?is)^</?([a-z][^\s/>]*)', 1)) as name,
    case when regexp_matches(t, '(?is)^(<[!?]|<(script|style|template)\b)') then 'none' when not (regexp_matches(t, '(?i)^</?[a-z]') and t like '%>') then 'text'
         when t like '</%' then 'close' when t like '%/>' then 'void' else 'open' end as kind from raw),
decoded as (select page_id, pos, name, case when kind = 'open' and name in ({", ".join(_q(v) for v in tx.VOID_ELEMENTS)}) then 'void' else kind end as kind,
    case when kind = 'text' then {sql_strip(f"case when contains(t, '&') then {_sql_references('t')} else t end")} else '' end as text from kinds where kind <> 'none'),
typed as (select *, row_number() over (partition by page_id order by pos) as i from decoded where kind <> 'text' or text <> ''),
walk(page_id, i, stack, article, list_i, list_depth, items, event) as (
    select page_id, 0::bigint, []::varchar[], 0, 0::bigint, 0, []::struct(d bigint, i bigint)[], '' from pages
    union all
    select page_id, i, stack,
        case when article > 0 and len(stack) < article then -1 when kind = 'open' and article = 0 and name = 'article' then len(stack) else article end,
        case when kind = 'open' and name = 'ul' and list_i = 0 and article > 0 and len(old) > article then i when len(stack) < list_depth then 0 else list_i end,
        case when kind = 'open' and name = 'ul' and list_i = 0 and article > 0 and len(old) > article then len(stack) when len(stack) < list_depth then 0 else list_depth end,
        case when kind = 'open' and name = 'li' and list_i > 0 then list_append(items, {{'d': len(stack), 'i': i}})
             else list_filter(items, lambda x: x.d <= len(stack)) end,
        case when article > 0 and len(old) = article and kind in ('open', 'void') then 'child'
             when article > 0 and len(old) > article and kind = 'text' then 'text' when kind = 'open' and name = 'li' and list_i > 0 then 'item' else '' end
    from (select w.page_id, t.i, t.kind, t.name, w.stack as old, w.article, w.list_i, w.list_depth, w.items,
              case when t.kind = 'open' then list_append(w.stack, t.name) when t.kind = 'close' and list_position(list_reverse(w.stack), t.name) > 0
                   then w.stack[:len(w.stack) - list_position(list_reverse(w.stack), t.name)] else w.stack end as stack
          from walk w join typed t on t.page_id = w.page_id and t.i = w.i + 1 where w.article >= 0)),
last as (select page_id, max(i) as child from walk where event = 'child' group by page_id),
said as (select w.page_id, w.i, w.list_i, w.items, t.text from walk w join last l on l.page_id = w.page_id and w.i > l.child
         join typed t on t.page_id = w.page_id and t.i = w.i where w.event = 'text'),
item as (select w.page_id, w.list_i, w.i, coalesce((select string_agg(s.text, '' order by s.i) from said s
             where s.page_id = w.page_id and list_contains(list_transform(s.items, lambda x: x.i), w.i)), '') as text
         from walk w join last l on l.page_id = w.page_id and w.i > l.child where w.event = 'item'),
piece as (select page_id, i, text from said where list_i = 0
          union all select page_id, list_i, string_agg('- ' || text, chr(10) order by i) from item group by page_id, list_i)
select p.page_id, coalesce((select string_agg(text, chr(10) order by i) from piece where piece.page_id = p.page_id), '') as description from pages p"""


@register("html_description", sql=_SQL_ARTICLE)
def q_html_description(spark, sf_dir):
    """Text of the last child element of the first article of each web page."""
    a = Ats(spark, sf_dir)
    return a.pages.select("page_id", tx.html_article_text(F.col("html")).alias("description"))
