"""Main text of web pages: page structure and a suffix array for each host.

A page is read into blocks, each in one of three zones: dropped by its place in the structure
(menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments),
in the article (``article``, else ``main``), or elsewhere.  The blocks' sentences are the page's
token stream.  The streams of a host's pages are concatenated and a suffix array over them finds
the long token runs that repeat on distinct pages.  A large host has several shards, each with
its own suffix array; the shortest runs and the tokens of all its distinct pages are counted once over
the whole host, and a run that another shard's page holds is found by these counts, so the shards
do not show in the result.  Repeated runs are boilerplate and go: elsewhere on the page, unless
hardly anything else is left there (the page is then a copy, and only what most pages of the host
hold goes); inside an article only what nearly every page of the host holds, and only if it leaves
most of an article, since articles quote and copy each other.  Pages with the same tokens count as one.

Rows are not shuffled with their html: the streams are, as 64-bit token hashes, and the pages
meet the few decisions again by a join.

Defined cases: a null or empty html gives an empty text; a null url counts as one host; repeated
rows count as one page and get the same text; unclosed, crossed or cut off markup is read to its
end; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .collocations import Bloom
from .common import checked_broadcast, map_rows, saved

PAGES_PER_SHARD = 500
LONG_RUN_WORDS = 8           # words that a repeated run has at least
LEAST_UNIQUE_SHARE = 0.2     # of a page's words outside runs; with less it is a copy
MOST, NEARLY_ALL = 0.5, 0.8  # shares of a host's pages
CHANCE = 2                   # pages whose agreement counts for nothing in a share
TOKEN_WORDS = 16             # words of one token at most

# fixed values: element names of HTML and the words that class, id and role use for page furniture
RAW = {"script", "style", "noscript", "template", "textarea", "select", "option", "button", "iframe", "object", "svg",
       "math", "canvas", "audio", "video", "title", "head"}
IN_HEAD = {"meta", "link", "base", "title", "script", "style", "noscript", "template"}
FURNITURE = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "source", "area", "base", "col", "embed", "track", "param"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q",
          "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "label",
          "data", "picture", "source", "ruby", "rt", "rp", "acronym", "nobr"}
NAMES = {"ad", "ads", "adv", "advert", "advertisement", "advertising", "adsense", "adbox", "sponsor", "sponsored", "promo",
         "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notification", "alert", "popup", "modal",
         "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "paywall", "sidebar", "sidenav", "rail",
         "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topbar", "toolbar", "masthead", "footer",
         "header", "comment", "comments", "commentlist", "reply", "replies", "respond", "discussion", "disqus", "related",
         "recommended", "recommendations", "share", "sharing", "social", "widget", "widgets", "pagination", "pager",
         "search", "skip", "tags", "copyright"}
# inside an article: names that say little alone, and words that add nothing to a name
WEAK = {"alert", "banner", "copyright", "discussion", "header", "notice", "recommended", "related", "reply", "respond", "search", "tags"}
NEUTRAL = {"area", "articles", "bar", "block", "box", "button", "buttons", "container", "content", "icons", "inner", "links", "list", "posts", "section",
           "text", "top", "bottom", "left", "right", "unit", "wrap", "wrapper"}
LINKED = 0.5                 # of a doubtful block's characters in links, from which on it is furniture
KEPT, FURNISHED, DOUBTFUL = 0, 1, 2
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?([A-Za-z][A-Za-z0-9:-]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*'|(?=>)|[^\s\"'>][^\s>]*))*+)>", re.S)     # a quote delimits only after "="
ATTRIBUTE = re.compile(r"([A-Za-z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SENTENCE = re.compile(r"(?<=[.!?;:|·]) ")
DROPPED, ARTICLE, ELSEWHERE = 0, 1, 2


def _is_furniture(tag: str, attributes: str, in_article: bool) -> int:
    """Whether an element is page furniture.  Inside an article a class or id decides alone only if it says
    nothing but furniture; otherwise it makes the element doubtful, and its links decide."""
    if tag in FURNITURE or tag == "header" and not in_article:
        return FURNISHED
    if not attributes or tag in ("html", "body", "main"):
        return KEPT
    found = KEPT
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id"):
            parts = set(re.split(r"[\s_-]+", value)) - {""}
            hit = parts & NAMES
            if hit and not (in_article and hit <= {"header", "tags"}) and not parts & {"no", "has", "with", "without"}:
                if not in_article or hit - WEAK and not parts - NAMES - NEUTRAL:
                    return FURNISHED
                found = DOUBTFUL
        elif name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return FURNISHED
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return FURNISHED
    return found


WHOLE = {"script", "style", "textarea", "title"}       # read to their end tag, or to the end of the page
OPTION_END = re.compile(r"<(/?)(?:option|optgroup|select|datalist)\b[^>]*>", re.I)


def _raw_end(page: str, tag: str, at: int) -> int:
    """Where a raw element whose content begins at ``at`` ends.  Inner elements of its name are closed first; an
    option ends before the next one or where its list does; another element without an end tag holds nothing."""
    if tag in WHOLE:
        shut = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
        return shut.end() if shut else len(page)
    if tag == "option":
        m = OPTION_END.search(page, at)
        return at if not m else m.end() if m[0].lower().startswith("</option") else m.start()
    depth = 1
    for m in re.compile(rf"<(/?){tag}\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>", re.I).finditer(page, at):
        if m[0].endswith("/>"):
            continue
        depth += -1 if m[1] else 1
        if depth == 0:
            return m.end()
    return at


def _head_end(page: str, at: int) -> int:
    """Where the head whose content begins at ``at`` ends: after its end tag, which may be left out, or
    before the first start tag that cannot stand in a head."""
    while (lt := page.find("<", at)) >= 0:
        m = MARKUP.match(page, lt)
        if not m:
            at = lt + 1
            continue
        at, tag = m.end(), (m[1] or "").lower()
        if tag and page[lt + 1] == "/":
            if tag == "head":
                return at
        elif tag and tag not in IN_HEAD:
            return lt
        elif tag in RAW:
            at = _raw_end(page, tag, at)
    return len(page)


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(zone, text) of every block with text, in page order; white space is one blank."""
    page = page or ""
    out: list[list] = []
    piece: list[str] = []
    stack: list[tuple[str, int]] = []       # open elements; the number of the one that drops what is in it, or -1
    voided: set[int] = set()
    drops: tuple[int, ...] = ()
    article = depth_main = serial = 0
    articles: dict[int, int] = {}           # which article, by block
    current_article = 0
    doubtful: dict[int, list[int]] = {}     # characters in all and in links, by element
    linked, in_link = 0, False

    def end_block():
        nonlocal linked
        if piece:
            text = " ".join(entities.unescape("".join(piece)).split())
            piece.clear()
            if text:
                out.append([drops, article > 0, depth_main > 0, text, current_article])
                for d in drops:
                    if d in doubtful:
                        doubtful[d][0] += len(text)
                        doubtful[d][1] += min(linked, len(text))
        linked = 0

    def open_(tag: str, furniture: int):
        nonlocal drops, article, depth_main, serial, current_article
        if tag in ("article", "main") and not furniture:
            if not any(n >= 0 and t in FURNITURE | {"header"} for t, n in stack):
                voided.update(drops)        # furniture by name only does not hold the article
            if tag == "article":
                article += 1
                if article == 1:
                    current_article += 1
            else:
                depth_main += 1
        serial += 1
        stack.append((tag, serial if furniture else -1))
        if furniture:
            drops = (*drops, serial)
            if furniture == DOUBTFUL:
                doubtful[serial] = [0, 0]

    def close(k: int):
        nonlocal drops, article, depth_main
        while len(stack) > k:
            tag, n = stack.pop()
            if n >= 0:
                drops = drops[:-1]
            elif tag == "article":
                article -= 1
            elif tag == "main":
                depth_main -= 1

    def nearest(tags: tuple[str, ...], stop: tuple[str, ...] = ()) -> int:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                return k
            if stack[k][0] in stop:
                return -1
        return -1

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            piece.append(page[at:])
            linked += in_link * (n - at)
            break
        if lt > at:
            piece.append(page[at:lt])
            linked += in_link * (lt - at)
        m = MARKUP.match(page, lt)
        if not m:
            nxt = page[lt + 1:lt + 2]
            if nxt == "/" and not page[lt + 2:lt + 3].isalpha() and (gt := page.find(">", lt)) >= 0:
                at = gt + 1                          # no tag, but read like a comment
                continue
            if nxt.isalpha() or nxt == "/" and page[lt + 2:lt + 3].isalpha():          # a tag that is cut off
                break
            piece.append("<")
            at = lt + 1
            continue
        at = m.end()
        tag = (m[1] or "").lower()
        if not tag:
            continue
        if tag == "a":
            in_link = page[lt + 1] != "/"
        if page[lt + 1] == "/":
            if tag in INLINE:
                continue
            end_block()
            k = nearest((tag,))
            if k >= 0:
                close(k)
            continue
        if tag in RAW:
            if tag not in INLINE:
                end_block()
            if tag == "head":
                at = _head_end(page, at)
            elif not m[2].rstrip().endswith("/"):
                at = _raw_end(page, tag, at)
            continue
        if tag == "br":
            piece.append(" ")
            continue
        if tag in INLINE:
            if tag not in VOID and _is_furniture(tag, m[2], article > 0 or depth_main > 0) == FURNISHED and not m[2].rstrip().endswith("/"):
                at = _raw_end(page, tag, at)
                in_link = in_link and tag != "a"
            continue
        end_block()
        if tag in VOID:
            continue
        if (k := nearest(("p",), ("div", "section", "td", "li", "article", "main", "body"))) >= 0:
            close(k)                                 # a block ends an open paragraph
        if tag in ("li", "tr", "td", "th", "dt", "dd"):
            alike, stop = (("li",), ("ul", "ol", "menu")) if tag == "li" else (("dt", "dd"), ("dl",)) if tag in ("dt", "dd") else (
                (("td", "th"), ("tr", "table")) if tag != "tr" else (("tr",), ("table",)))
            if (k := nearest(alike, stop)) >= 0:
                close(k)
        open_(tag, _is_furniture(tag, m[2], article > 0 or depth_main > 0))
    end_block()
    voided.update(d for d, (chars, links) in doubtful.items() if links < LINKED * chars)
    live = [[all(d in voided for d in b[0]), *b[1:]] for b in out]
    sizes: dict[int, int] = {}
    for keep, in_article, _, text, number in live:
        if keep and in_article:
            sizes[number] = sizes.get(number, 0) + len(text)
    large = {a for a, s in sizes.items() if s >= 0.3 * max(sizes.values())}      # teasers beside the article are not it
    has_main = any(keep and in_main for keep, _, in_main, _, _ in live)
    result = []
    for keep, in_article, in_main, text, number in live:
        inside = in_article and number in large if large else in_main
        result.append((DROPPED if not keep or (large or has_main) and not inside else ARTICLE if inside else ELSEWHERE, text))
    return result


def tokens(text: str) -> list[str]:
    """Sentences of a block, long ones cut; joined by blanks they give the block again."""
    out = []
    for s in SENTENCE.split(text):
        if len(s) > 2 * TOKEN_WORDS and s.count(" ") >= TOKEN_WORDS:
            w = s.split(" ")
            out += [" ".join(w[i:i + TOKEN_WORDS]) for i in range(0, len(w), TOKEN_WORDS)]
        else:
            out.append(s)
    return out


def suffix_array(stream: np.ndarray, depth: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of an integer stream in order of their first ``depth`` tokens, by prefix doubling, and
    the tokens that each shares with the one before it (at most ``depth``)."""
    n = len(stream)
    rank = np.unique(stream, return_inverse=True)[1].astype(np.int64)
    ranks, width = [rank], 1
    while width < depth and rank.max(initial=0) < n - 1:
        after = np.full(n, -1, np.int64)
        after[:n - width] = rank[width:]
        rank = np.unique(rank * (n + 2) + after + 1, return_inverse=True)[1].astype(np.int64)
        ranks.append(rank)
        width *= 2
    order = np.argsort(rank, kind="stable")
    a, b, shared = order[:-1].copy(), order[1:].copy(), np.zeros(max(0, n - 1), np.int64)
    for j in range(len(ranks) - 1, -1, -1):
        ok = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[ok] = ranks[j][a[ok]] == ranks[j][b[ok]]
        step = (1 << j) * same
        shared += step
        a, b = a + step, b + step
    return order, np.concatenate([[0], shared]).astype(np.int64)[:n]


def repeated_runs(stream: np.ndarray, page: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which tokens lie in a run of at least LONG_RUN_WORDS words that another page holds too.
    Every page ends with a token of its own, so no run crosses pages; size is 0 there."""
    n = len(stream)
    order, shared = suffix_array(stream)
    best = np.zeros(n, np.int64)
    for step in (1, -1):                 # the nearest suffix of another page, on either side
        seq = order if step == 1 else order[::-1]
        lcp = shared if step == 1 else np.concatenate([[0], shared[:0:-1]])
        cur, before = 0, -1
        p = page[seq].tolist()
        reach = []
        for own, common in zip(p, lcp.tolist()):
            cur = common if own != before else min(cur, common)
            before = own
            reach.append(cur)
        best[seq] = np.maximum(best[seq], reach)
    total = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(n)
    long_ = total[np.minimum(at + best, n)] - total[at] >= LONG_RUN_WORDS
    cover = np.zeros(n + 1, np.int64)
    cover[at[long_]] += 1
    np.subtract.at(cover, np.minimum(at[long_] + best[long_], n), 1)
    return np.cumsum(cover)[:n] > 0


def _key(h: np.ndarray) -> np.ndarray:
    h = h + np.uint64(0xBF58476D1CE4E5B9)
    z = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(29))


def seeds(hashes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first, end) of the shortest runs of LONG_RUN_WORDS words that begin at each token or end at each.
    A run that two pages hold is covered, token by token, by the shortest runs in it."""
    total = np.concatenate([[0], np.cumsum(words.astype(np.int64))])
    n = len(hashes)
    first, end = np.arange(n), np.searchsorted(total, total[:-1] + LONG_RUN_WORDS)
    last = np.arange(1, n + 1)
    back = np.searchsorted(total, total[1:] - LONG_RUN_WORDS, "right") - 1
    runs = np.unique(np.concatenate([(first * (n + 1) + end)[end <= n], (back * (n + 1) + last)[back >= 0]]))
    first, end = np.divmod(runs, n + 1)
    key = (end - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for step in range(LONG_RUN_WORDS):          # a token has one word at least
        open_ = np.flatnonzero(first + step < end)
        if not len(open_):
            break
        key[open_] = _key(key[open_] * np.uint64(5) + hashes[first[open_] + step])
    return key, first, end


def token_keys(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """What tokens are counted under; one that is a long run by itself under its seed's key."""
    return np.where(words >= LONG_RUN_WORDS, _key(np.uint64(0x9E3779B97F4A7C15 * 5 % (1 << 64)) + hashes), _key(hashes))


def keys_of(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """What a page is counted under: its seeds and its tokens."""
    return np.unique(np.concatenate([seeds(hashes, words)[0], token_keys(hashes, words)]))


def _counts(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of two pages or more, and of how many."""
    found, n = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.uint64), return_counts=True)
    return found[n > 1], n[n > 1]


def furniture_of(pages: list[tuple[np.ndarray, np.ndarray, np.ndarray]], host: tuple[np.ndarray, np.ndarray, int] | None = None) -> list[np.ndarray]:
    """For each page (token hashes, words, zones): the numbers of the tokens to remove.  ``host``: sorted keys
    that two or more pages of the whole host hold, how many hold them, and the host's pages; if not given,
    ``pages`` are all of the host.  Pages with the same tokens count as one."""
    distinct: dict[bytes, int] = {}
    which = [distinct.setdefault(h.tobytes() + z.tobytes(), len(distinct)) for h, _, z in pages]
    own = [pages[i] for i in np.unique(np.array(which, np.int64), return_index=True)[1].tolist()]
    if not own:
        return []
    keys, held, n_pages = host or (*_counts([keys_of(h, w) for h, w, _ in own]), len(own))

    def holders(key: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(key), np.int64)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, held[at], 0)

    lengths = [len(h) for h, _, _ in own]
    number = np.repeat(np.arange(len(own)), [n + 1 for n in lengths])
    hashes = np.unique(np.concatenate([h for h, _, _ in own]), return_inverse=True)[1]
    stream, size, at, used = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64), 0, 0
    top = hashes.max(initial=0) + 1
    for k, (_, w, _) in enumerate(own):
        n = lengths[k]
        stream[at:at + n], size[at:at + n] = hashes[used:used + n], w
        stream[at + n] = top + k
        at, used = at + n + 1, used + n
    covered = repeated_runs(stream, number, size)        # on these pages; the seeds tell of the host's others
    out, at = [], 0
    for (h, w, z), n in zip(own, lengths):
        c = covered[at:at + n].copy()
        at += n + 1
        key, first, end = seeds(h, w)
        again = holders(key) > 1
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, first[again], 1)
        np.subtract.at(cover, end[again], 1)
        c |= np.cumsum(cover)[:n] > 0
        share = np.maximum(holders(token_keys(h, w)) - CHANCE, 0) / n_pages
        inside, other = z == ARTICLE, z == ELSEWHERE
        gone = c & inside & (share >= NEARLY_ALL)
        if w[inside & ~gone].sum() < LEAST_UNIQUE_SHARE * w[inside].sum():
            gone[:] = False                              # a copy of an article, not the frame around one
        if w[other & ~c].sum() >= LEAST_UNIQUE_SHARE * w[other].sum():
            gone |= other & c
        else:
            gone |= other & c & (share >= MOST)
        out.append(np.flatnonzero(gone).astype("<i4"))
    return [out[k] for k in which]


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    rows = pages.select("page_id", "url", "html",
                        F.xxhash64("page_id", "url", "html").alias("k1"),
                        F.xxhash64(F.lit(1), "html", "url", "page_id").alias("k2"))
    host = F.coalesce(F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))

    def read():
        def run(rows):
            for site, k1, k2, html in rows:
                h, w, z = [], [], []
                for zone, text in blocks(html):
                    if zone != DROPPED:
                        for t in tokens(text):
                            h.append(xxhash.xxh64_intdigest(t))
                            w.append(min(255, t.count(" ") + 1))
                            z.append(zone)
                if h:
                    yield (site, k1, k2, np.array(h, "<u8").tobytes(), bytes(w), bytes(z))
        return run

    streams = saved(map_rows(rows.select(host.alias("host"), "k1", "k2", "html"),
                             "host string, k1 bigint, k2 bigint, hashes binary, words binary, zones binary", read), "html-streams")
    pages_of = streams.select("host", F.xxhash64("hashes", "zones").alias("content")).groupBy("host", "content").agg(F.count("*").alias("n"))
    hosts = saved(pages_of.groupBy("host").agg(F.count("*").alias("n_pages"), F.ceil(F.sum("n") / PAGES_PER_SHARD).alias("shards")), "html-hosts")

    # what a host's distinct pages hold, counted over all of them
    def keyed(pages: DataFrame, among: Bloom | None = None) -> DataFrame:
        """(k1, k2, key): what each page is counted under, made one with its host; ``among`` leaves out most of the
        keys that no other page holds."""
        def make():
            def run(rows):
                for site, k1, k2, h, w in rows:
                    keys = keys_of(np.frombuffer(h, "<u8"), np.frombuffer(w, np.uint8)) ^ np.uint64(xxhash.xxh64_intdigest(site))
                    yield (k1, k2, (keys if among is None else keys[among.holds(keys)]).view(np.int64))
            return run
        found = map_rows(pages.select("host", "k1", "k2", "hashes", "words"), "k1 bigint, k2 bigint, keys array<bigint>", make)
        return found.select("k1", "k2", F.explode("keys").alias("key"))

    once = streams.withColumn("content", F.xxhash64("hashes", "zones")).dropDuplicates(["host", "content"])   # map-side first: copies are few rows
    shared = saved(keyed(once).groupBy("key").agg(F.count("*").alias("held")).where("held > 1"), "html-shared")
    known = (keyed(streams, Bloom(shared.select(F.col("key").alias("h")))).join(checked_broadcast(shared), "key")
             .groupBy("k1", "k2").agg(F.collect_list("key").alias("keys"), F.collect_list("held").alias("held")))

    dealt = (streams.join(checked_broadcast(hosts), "host").join(known, ["k1", "k2"], "left").withColumn("shard", F.pmod("k1", "shards")))

    def judge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["k1", "k2"]).sort_values(["k1", "k2"])
        lists, site = group[group["keys"].notna()], np.uint64(xxhash.xxh64_intdigest(group.host.iloc[0]))
        flat = lambda c, t: np.concatenate([np.zeros(0, t), *lists[c]]).astype(t)
        keys, at = np.unique(flat("keys", np.int64).view(np.uint64) ^ site, return_index=True)
        host = (keys, flat("held", np.int64)[at], int(group.n_pages.iloc[0]))
        gone = furniture_of([(np.frombuffer(h, "<u8"), np.frombuffer(w, np.uint8), np.frombuffer(z, np.uint8))
                             for h, w, z in zip(group.hashes, group.words, group.zones)], host)
        out = [(a, b, g.tobytes()) for a, b, g in zip(group.k1, group.k2, gone) if len(g)]
        return pd.DataFrame(out, columns=["k1", "k2", "gone"])

    decisions = saved(dealt.groupBy("host", "shard").applyInPandas(judge, "k1 bigint, k2 bigint, gone binary"), "html-gone")

    def write():
        def run(rows):
            for page_id, url, html, gone in rows:
                drop = set(np.frombuffer(gone, "<i4").tolist()) if gone else ()
                lines, k = [], 0
                for zone, text in blocks(html):
                    if zone == DROPPED:
                        continue
                    if drop:
                        parts = tokens(text)
                        text = " ".join(t for i, t in enumerate(parts, k) if i not in drop)
                        k += len(parts)
                    if text:
                        lines.append(text)
                main = "\n".join(lines)
                yield (page_id, url, main, len(main))
        return run

    return map_rows(rows.join(checked_broadcast(decisions), ["k1", "k2"], "left").select("page_id", "url", "html", "gone"),
                    "page_id bigint, url string, text string, n_chars bigint", write)
