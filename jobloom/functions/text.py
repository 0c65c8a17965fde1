"""Text expressions (Column -> Column).  Everything is a native regex / higher-order
function, so a whole document is processed inside one codegen'd projection.

Regex notes: Java's ``\\s`` and ``\\d`` are ASCII-only, so the whitespace and digit
classes below are spelled out to mean what Python's Unicode ``\\s`` / ``\\d`` mean.
The same spellings are valid RE2, so the DuckDB oracle uses them unchanged.
"""

from __future__ import annotations

import html.entities
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import catalog as cat

# Python's str.isspace() set.
WS = r"[\t\n\x0B\f\r \x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NWS = "[^" + WS[1:]
DIGIT = r"\p{Nd}"

# Cleaning patterns, applied in this order after lower-casing.
RE_NEWLINES = r"\n+"
RE_SPACES = WS + "+"
RE_URL = r"http" + NWS + "+|www" + NWS + "+|https" + NWS + "+"
RE_EMAIL = NWS + "+@" + NWS + "+"
RE_PHONE = r"\(?" + DIGIT + r"{3}\)?[-." + WS[1:-1] + "]?" + DIGIT + "{3}[-." + WS[1:-1] + "]?" + DIGIT + "{4}"

# A token: two or more Unicode letters, digits or underscores.
RE_TOKEN = r"[\p{L}\p{N}_]{2,}"

# Years of experience stated in a posting (group 1 = number).
RE_YEARS = [
    r"(?i)(\d+)\+?\s+years?\s+(?:of\s+)?experience",
    r"(?i)experience\s+(?:of\s+)?(\d+)\+?\s+years?",
    r"(?i)(\d+)\+?\s+years?\s+(?:in\s+)(?:the\s+)?(?:field|industry)",
]
_MON = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
RE_MONTH_RANGE = (_MON + r"[a-z]*[\s,.-]+(\d{4})[\s,.-]+(?:to|-)[\s,.-]+(?:" + _MON
                  + r"[a-z]*[\s,.-]+(\d{4})|present|current)")
# Résumé line: MM/YYYY <dash, 'to', ...> MM/YYYY | present | now.
RE_POSITION = (r"(\d{1,2}/\d{4})" + WS + r"*[–\-to]+" + WS + r"*(\d{1,2}/\d{4}|present|now)")
RE_SENTENCE = r"[^.!?\n]+[.!?]*"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# After whitespace runs are collapsed to one space, a space is the only whitespace left, so
# the later steps can use '[^ ]' for a non-space character.  The e-mail pattern is also
# anchored at the start of a non-space run (where its leftmost match always begins) and a
# look-ahead skips runs without '@' in one pass, instead of backtracking from every
# position.  Same matches as RE_URL / RE_EMAIL / RE_PHONE on collapsed text.
# A blank that stands alone is already what a run collapses to, so most matches of RE_SPACES change nothing:
# only runs that begin with another white space, or go on after a blank, are replaced.
RE_SPACES_CHANGED = "[" + WS[1:-1].replace(" ", "", 1) + "]" + WS + "*| " + WS + "+"
RE_URL_COLLAPSED = r"http[^ ]+|www[^ ]+|https[^ ]+"
RE_EMAIL_COLLAPSED = r"(?<![^ ])(?=[^ @]*@)[^ ]+@[^ ]+"
RE_PHONE_COLLAPSED = r"\(?" + DIGIT + r"{3}\)?[-. ]?" + DIGIT + "{3}[-. ]?" + DIGIT + "{4}"


def clean_text(text) -> Column:
    """lower -> collapse newlines -> collapse whitespace -> drop URLs, e-mails, phone numbers."""
    t = F.lower(_c(text))
    t = F.regexp_replace(t, RE_NEWLINES, "\n")
    t = F.regexp_replace(t, RE_SPACES_CHANGED, " ")
    t = F.regexp_replace(t, RE_URL_COLLAPSED, "")
    t = F.regexp_replace(t, RE_EMAIL_COLLAPSED, "")
    return F.regexp_replace(t, RE_PHONE_COLLAPSED, "")


def py_strip(c: Column) -> Column:
    """Python's str.strip(): Unicode whitespace at both ends."""
    return F.regexp_replace(c, "^" + WS + "+|" + WS + "+$", "")


def tokens(text) -> Column:
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(RE_TOKEN), 0)


def drop_stop_words(toks: Column, stop: list[str] = cat.KEYWORD_STOP_WORDS) -> Column:
    # isin over many literals is planned as a hash-set lookup (InSet)
    return F.filter(toks, lambda x: ~x.isin(*stop))


def ngrams(toks: Column, n_min: int = 1, n_max: int = 3) -> Column:
    """All n-grams (space-joined) for n in [n_min, n_max], in order of n then position.
    ``toks`` should be a column reference: the lambdas read it once per n-gram."""
    def of_n(n: int) -> Column:
        # one-argument lambda: transform() passes (element, index) to two-argument ones
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(toks) - (n - 1), F.lit(1))),
                            lambda i: F.array_join(F.slice(toks, i, n), " "))
        return F.when(F.size(toks) >= n, grams).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of_n(n) for n in range(n_min, n_max + 1)])


def skill_pattern(entry: str, boundary: str = "strict") -> str:
    r"""``strict``: ``\b`` on both sides, as matched by the original behaviour (so ``c\+\+``
    needs a word character after the '+': 'c++11' matches, 'c++ daily' does not).
    ``fixed``: the entry may not touch a word character on either side ('c++ daily' matches)."""
    if boundary == "strict":
        return r"(?i)\b" + entry + r"\b"
    if boundary == "fixed":
        return r"(?i)(?<!\w)" + entry + r"(?!\w)"
    raise ValueError(boundary)


def is_plain(entry: str) -> bool:
    """Whether the entry's regular expression means its own text: letters, digits, blanks, hyphens and slashes
    only, with a word character at both ends."""
    return re.fullmatch(r"\w([\w \-/]*\w)?", entry, re.A) is not None


def _runs(entry: str) -> list[str]:
    return re.findall(r"\w+|\W+", entry, re.A)


# where a text falls into word and non-word runs, in the two senses of a word's edge
_EDGES = {"strict": r"\b", "fixed": r"(?<=\w)(?!\w)|(?<!\w)(?=\w)"}


def dictionary_items(text, patterns: list[str] = cat.SKILL_PATTERNS, boundary: str = "strict") -> Column:
    """(ord, skill) of the dictionary entries found in the text as whole words, in dictionary order.

    An entry that means its own text starts and ends where a word run does, so it is a sequence of whole
    runs of the text.  The text is cut into runs once; runs that begin no entry are left out by a hash set,
    and at the others the sequences as long as an entry with that first run are looked up.  The other entries
    (``c\\+\\+``, ``c#``, a dot for any character) are regular expressions of their own."""
    if boundary not in _EDGES:
        raise ValueError(boundary)
    t = _c(text)
    low = F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    plain = {p: _runs(p) for p in patterns if is_plain(p)}
    found = F.array().cast("array<string>")
    if plain:
        runs = F.split(low, _EDGES[boundary])
        spans: dict[int, list[str]] = {}
        for p, r in plain.items():
            spans.setdefault(len(r), []).append(p)

        def at(runs: Column) -> Column:
            starts = F.filter(F.transform(runs, lambda x, i: F.when(x.isin(*{r[0] for r in plain.values()}), i + 1)), lambda i: i.isNotNull())
            sequences = F.transform(starts, lambda i: F.array(*[F.array_join(F.slice(runs, i, n), "") for n in sorted(spans)]))
            return F.filter(F.flatten(sequences), lambda x: x.isin(*plain))

        # a one-element array, so that the runs are computed once and read by their name
        found = F.flatten(F.transform(F.array(runs), at))
    others = [F.when(t.rlike(skill_pattern(p, boundary)), F.lit(p)) for p in patterns if p not in plain]
    found = F.concat(found, F.array_compact(F.array(*others))) if others else found
    entries = F.array(*[F.struct(F.lit(i).cast("long").alias("ord"), F.lit(p).alias("skill")) for i, p in enumerate(patterns)])
    return F.flatten(F.transform(F.array(found), lambda f: F.when(F.size(f) > 0, F.filter(entries, lambda e: F.array_contains(f, e["skill"])))
                                 .otherwise(F.slice(entries, 1, 0))))


def dictionary_skills(text, patterns: list[str] = cat.SKILL_PATTERNS, boundary: str = "strict") -> Column:
    """Dictionary entries found in the text as whole words, in dictionary order."""
    return F.transform(dictionary_items(text, patterns, boundary), lambda e: e["skill"])


def jd_years(clean) -> Column:
    """Max of the stated-years patterns; if none (or all 0), the sum of month-year ranges
    with an open end counted up to ``open_end_year``.  Returns an int column."""
    t = _c(clean)
    found = F.concat(*[F.regexp_extract_all(t, F.lit(p), 1) for p in RE_YEARS])
    nums = F.transform(found, lambda x: x.try_cast("int"))
    return F.coalesce(F.array_max(F.filter(nums, lambda x: x.isNotNull())), F.lit(0))


def month_range_years(clean, open_end_year: int) -> Column:
    t = F.lower(_c(clean))
    starts = F.regexp_extract_all(t, F.lit(RE_MONTH_RANGE), 1)
    ends = F.regexp_extract_all(t, F.lit(RE_MONTH_RANGE), 2)
    spans = F.zip_with(starts, ends, lambda s, e: F.when(e == "", F.lit(open_end_year)).otherwise(e.cast("int"))
                       - s.cast("int"))
    return F.aggregate(spans, F.lit(0), lambda acc, x: acc + x)


def posting_years(clean, open_end_year: int = 2025) -> Column:
    y = jd_years(clean)
    return F.when(y > 0, y).otherwise(month_range_years(clean, open_end_year))


def sentences(text) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(RE_SENTENCE), 0)


def has_education_keyword(s: Column) -> Column:
    low = F.lower(s)
    cond = F.lit(False)
    for k in cat.EDUCATION_KEYWORDS:
        cond = cond | F.contains(low, F.lit(k))
    return cond


def is_section_header(line: Column) -> Column:
    low = py_strip(F.lower(line))
    cond = F.lit(False)
    for s in cat.RESUME_SECTIONS:
        cond = cond | F.contains(low, F.lit(s))
    return cond


def _alt(words: list[str]) -> str:
    return "(?:" + "|".join(w.replace(" ", r"\s+") for w in words) + ")"


# Four title shapes instead of one regex per (prefix, specialty, domain) combination.
# Prefix, specialty and domain words are disjoint, so same-shape matches cannot overlap
# and the set of matches equals that of the per-combination patterns.
TITLE_SHAPES = [
    r"(?i)\b" + _alt(cat.JOB_DOMAINS) + r"\b",
    r"(?i)\b" + _alt(cat.JOB_SPECIALTIES) + r"\s+" + _alt(cat.JOB_DOMAINS) + r"\b",
    r"(?i)\b" + _alt(cat.JOB_PREFIXES) + r"\s+" + _alt(cat.JOB_DOMAINS) + r"\b",
    r"(?i)\b" + _alt(cat.JOB_PREFIXES) + r"\s+" + _alt(cat.JOB_SPECIALTIES) + r"\s+" + _alt(cat.JOB_DOMAINS) + r"\b",
]


def title_matches(text) -> Column:
    """All title matches of the four shapes (array of strings, shape order)."""
    t = _c(text)
    return F.concat(*[F.regexp_extract_all(t, F.lit(p), 0) for p in TITLE_SHAPES])


# One token of a page: a comment or declaration, a raw element as a whole, a tag, or text up to the next '<'.
# A quote delimits a value only after '='; the possessive repeats never step back.
RE_TOKEN_HTML = (r"(?is)<!--.*?-->|<[!?][^>]*>|<(?:script|style|template)\b[^>]*>.*?</(?:script|style|template)\s*>"
                 r"|</?[a-z](?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+>|[^<]+|<")
# Elements without an end tag.
VOID_ELEMENTS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
RE_REFERENCE = r"^(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);?"


def references() -> dict[str, str]:
    """Named character references, and the numbers 128 to 159 as browsers read them."""
    out = {name: chr(code) for name, code in html.entities.name2codepoint.items()} | {"apos": "'"}
    return out | {f"#{i}": bytes([i]).decode("cp1252") for i in range(128, 160) if i not in (129, 141, 143, 144, 157)}


def decode_references(text: Column) -> Column:
    """Numeric and named character references as characters; what is no reference stays as it is."""
    known = F.create_map(*[F.lit(x) for kv in references().items() for x in kv])

    def part(p: Column) -> Column:
        name = F.regexp_extract(p, RE_REFERENCE, 1)
        digits = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 8), 16, 10)).otherwise(F.substring(name, 2, 8))
        code = digits.try_cast("int")
        known_code = F.try_element_at(known, F.concat(F.lit("#"), code.cast("string")))
        sound = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        numeric = F.when(sound, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit("�"))
        char = F.when(F.startswith(name, F.lit("#")), F.coalesce(known_code, numeric)).otherwise(F.try_element_at(known, name))
        return F.when(char.isNull(), F.concat(F.lit("&"), p)).otherwise(F.concat(char, F.regexp_replace(p, RE_REFERENCE, "")))

    parts = F.split(text, "&", -1)
    decoded = F.array_join(F.concat(F.slice(parts, 1, 1), F.transform(F.slice(parts, 2, 1 << 30), part)), "")
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def html_article_text(html_text, article_class: str | None = None) -> Column:
    """Text of the last direct child element of the first article (of a class that ``article_class``, a
    regular expression, is found in).

    The page's tokens are walked once with a stack of open elements: an end tag closes the last element of
    its name and all that were opened since, one without such an element is ignored.  A start tag right under
    the article begins its next child and drops what was read of the one before.  Texts are decoded, stripped
    and joined by newlines; a list becomes the lines ``- item``, its items' texts joined without a gap (an item
    inside an item counts in both).  Comments, scripts and styles are no text and no child.  A page without
    such an article or child, or a null one, gives an empty text."""
    void = lambda name: name.isin(*VOID_ELEMENTS)
    tag = r"(?is)^</?([a-z][^\s/>]*)"

    def read(t: Column) -> Column:
        is_tag = t.rlike(r"(?i)^</?[a-z]") & t.endswith(">")
        raw = t.rlike(r"(?is)^(<[!?]|<(script|style|template)\b)")
        name = F.lower(F.regexp_extract(t, tag, 1))
        kind = (F.when(raw, "none").when(~is_tag, "text").when(t.startswith("</"), "close")
                .when(void(name) | t.endswith("/>"), "void").otherwise("open"))
        chosen = name == "article"
        if article_class is not None:
            chosen = chosen & F.regexp_extract(t, r"(?is)\sclass\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", 1).rlike(article_class)
        return F.struct(kind.alias("kind"), F.when(is_tag, name).otherwise("").alias("name"),
                        F.when(kind == "text", py_strip(decode_references(t))).otherwise("").alias("text"), (chosen & is_tag).alias("chosen"))

    tokens_ = F.filter(F.transform(F.regexp_extract_all(_c(html_text), F.lit(RE_TOKEN_HTML), 0), read),
                       lambda t: (t["kind"] != "none") & ((t["kind"] != "text") | (t["text"] != "")))
    no_items = F.array().cast("array<struct<depth:int,text:string>>")
    no_text = F.array().cast("array<string>")

    def state(stack, article, pieces, lists, items) -> Column:
        return F.struct(stack.alias("stack"), article.cast("int").alias("article"), pieces.alias("pieces"),
                        lists.cast("int").alias("lists"), items.alias("items"))

    def lines(items: Column) -> Column:
        return F.array(F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x["text"])), "\n"))

    def step(s: Column, t: Column) -> Column:
        depth, kind, name = F.size(s["stack"]), t["kind"], t["name"]
        inside, child = (s["article"] > 0) & (depth > s["article"]), (s["article"] > 0) & (depth == s["article"])
        begins = (s["article"] == 0) & t["chosen"] & (kind == "open")
        pushed = F.when(kind == "open", F.concat(s["stack"], F.array(name))).otherwise(s["stack"])
        begins_list = inside & (kind == "open") & (name == "ul") & (s["lists"] == 0)
        begins_item = inside & (kind == "open") & (name == "li") & (s["lists"] > 0)
        opened = state(pushed, F.when(begins, depth + 1).otherwise(s["article"]), F.when(child, no_text).otherwise(s["pieces"]),
                       F.when(begins_list, depth + 1).otherwise(s["lists"]),
                       F.when(begins_item, F.concat(s["items"], F.array(F.struct((depth + 1).cast("int").alias("depth"), F.lit("").alias("text")))))
                       .otherwise(s["items"]))
        back = F.array_position(F.reverse(s["stack"]), name).cast("int")
        left = F.when(back == 0, depth).otherwise(depth - back)
        ends_list = (s["lists"] > 0) & (left < s["lists"])
        closed = state(F.slice(s["stack"], F.lit(1), left), F.when((s["article"] > 0) & (left < s["article"]), -1).otherwise(s["article"]),
                       F.when(ends_list, F.concat(s["pieces"], lines(s["items"]))).otherwise(s["pieces"]),
                       F.when(ends_list, 0).otherwise(s["lists"]),
                       F.when(ends_list, no_items).otherwise(F.transform(s["items"], lambda x: F.struct(
                           F.when(x["depth"] > left, 0).otherwise(x["depth"]).cast("int").alias("depth"), x["text"].alias("text")))))
        in_list = s["lists"] > 0
        spoken = state(s["stack"], s["article"], F.when(inside & ~in_list, F.concat(s["pieces"], F.array(t["text"]))).otherwise(s["pieces"]), s["lists"],
                       F.when(in_list, F.transform(s["items"], lambda x: F.struct(x["depth"].alias("depth"),
                              F.when(x["depth"] > 0, F.concat(x["text"], t["text"])).otherwise(x["text"]).alias("text")))).otherwise(s["items"]))
        return F.when(s["article"] < 0, s).when(kind == "text", spoken).when(kind == "close", closed).otherwise(opened)

    start = state(no_text, F.lit(0), no_text, F.lit(0), no_items)
    end = lambda s: F.array_join(F.filter(F.when(s["lists"] > 0, F.concat(s["pieces"], lines(s["items"]))).otherwise(s["pieces"]),
                                          lambda x: x != ""), "\n")
    return F.coalesce(F.aggregate(tokens_, start, step, end), F.lit(""))
