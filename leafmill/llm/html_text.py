"""Main text of web pages by equivalence-class template deduction (operator 1).

Pages of one host are compared in groups.  A token (a tag with its class, id
and role, or a run of text) has an occurrence vector: how often it occurs on
each page of the group.  Tokens with equal vectors form an equivalence class.
The root class holds the tokens that occur once on most pages of one layout;
pages that lack some of them keep the others.  A class is valid if its tokens
come in the same order (the root's on most pages) and, for classes other than
the root's, if they nest in one slot of the root.  The root's tokens are the
template, the gaps between them its slots.  Template text is not content; a
slot whose nested class is made of links is a menu.  What remains of a page is
the text of its slots outside elements whose template tokens say menu, header,
footer, sidebar, notice, advert, form or comments.  Slots also tell whether an
article or main element is the page's own text: it is where its slots hold at
least as much text that changes from page to page as all others; else, as with
teasers, it counts like any element.

Groups hold about GROUP pages: a larger host is split by a hash of the page,
each part with a template of its own, so that no task holds a host.  A group
of fewer than MIN_PAGES pages has no template and is read by element roles
alone.  Pages are parted by layout, each with a template; layouts of fewer
pages than that use the template of all pages.  Copies of a page count once
and pages without tokens not at all.  Text inside an article is never taken
for template, so that copies of one article on a host keep their text.

Blocks are split at block-level tags; a line break is white space.  Character
references are decoded, white space becomes one space, blocks are joined by an
empty line.

Cases: null and empty html give an empty text; unclosed, crossed and unknown
tags are tolerated; html without any tag is one block; a null or host-less url
belongs to the host ''; repeated pages are each extracted; page_id may be null; an
empty table gives an empty one; columns other than page_id, url and html are
ignored; very long pages are read whole.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.scratch import Scratch, only

GROUP, MIN_PAGES = 200, 3
HOT_SHARE = 1000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title|xmp|iframe|noembed|noframes|noscript|svg|math)\b(?P<rattr>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>(?P<rbody>.*?)(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attr>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-zA-Z][^>]*+>|<[!?][^>]*+>",
    re.S | re.I,
)
_ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_NEVER = frozenset("head nav footer aside form menu dialog button select template object applet canvas audio video map datalist".split())
_ENDS_P = _BLOCK - {"html", "body", "head"}
_REOPEN = {"li": ("li", {"ul", "ol", "menu"}), "dd": ("dd", {"dl"}), "dt": ("dt", {"dl"}), "tr": ("tr", {"table"}), "td": ("td", {"tr", "table"}), "th": ("th", {"tr", "table"}), "option": ("option", {"select"})}
_ROLE = re.compile(
    r"^(?:ads?|advert\w*|adsense|banners?|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alerts?|popups?|modal|overlay|newsletter|subscri\w+|sign-?up|login|search|"
    r"side-?bars?|widgets?|menus?|nav\w*|breadcrumbs?|footers?|masthead|topbar|toolbar|comments?|comment-?list|discussion|replies|reply|respond|disqus|"
    r"share|sharing|social\w*|related|recommend\w*|pagination|pager|tags|contentinfo|complementary|navigation|form|skip-?link|copyright)$",
    re.I,
)
#: Headers are menus' and logos' place on a page, but in an article they hold its own title.
_HEADER = re.compile(r"^(?:headers?|banner)$", re.I)
#: Tags that, without class, id and role, belong to what a page says and not to its layout.
_CONTENT = frozenset("a abbr b blockquote br cite code dd dl dt em figcaption figure h1 h2 h3 h4 h5 h6 hr i img li ol p pre q s small span strong sub sup table tbody td th thead tr u ul".split())
_PLAIN = frozenset("html body article main p h1 h2 h3 h4 h5 h6".split())


@dataclass
class Token:
    key: str | None
    name: str = ""
    end: bool = False
    text: str = ""
    role: bool = False
    header: bool = False


def tokenize(html: str) -> list[Token]:
    """Tags and runs of text; comments, declarations and raw elements leave no text."""
    out: list[Token] = []
    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            _add_text(out, html[at : m.start()])
        at = m.end()
        if m["raw"]:
            out.append(Token(f"<{m['raw'].lower()}>", name="#raw"))
        elif m["name"]:
            name = m["name"].lower()
            if m["end"]:
                out.append(Token(f"</{name}>", name, True))
                continue
            named = [] if not m["attr"] else [(a.lower(), (x or y or z).split()) for a, x, y, z in _ATTR.findall(m["attr"])]
            words = [w for _, ws in named for w in ws]
            marks = [] if name in _PLAIN else [p for w in words for p in (w, *re.split(r"[-_]+", w))]
            role = name in _NEVER or any(map(_ROLE.match, marks))
            out.append(Token(f"<{name} {' '.join(words)}>", name, False, "", role, name == "header" or any(map(_HEADER.match, marks))))
    if at < len(html):
        _add_text(out, html[at:])
    return out


def _add_text(out: list[Token], raw: str) -> None:
    text = unescape(raw) if "&" in raw else raw
    if text.strip():
        out.append(Token(text.strip(), "#text", False, text))
    elif text:
        out.append(Token(None, "#text", False, text))


@dataclass
class Template:
    """Of each page its template text and where its slots begin (places and slots, in order); which slots are menus; whether articles bound the text."""

    fixed: list[set[int]]
    begins: list[tuple[list[int], list[int]]]
    menus: set[int] = field(default_factory=set)
    bounded: bool = True


def _within(tokens: list[Token], *names: str) -> list[bool]:
    depth, out = 0, []
    for t in tokens:
        if t.name in names:
            depth = max(0, depth + (-1 if t.end else 1))
        out.append(depth > 0)
    return out


def occurrences(pages: list[list[Token]]) -> dict[str, dict[int, list[int]]]:
    """For each token the pages where it occurs and its places there; text inside articles doesn't count."""
    found: dict[str, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
    for p, tokens in enumerate(pages):
        inside = _within(tokens, "article", "main")
        for i, t in enumerate(tokens):
            if t.key is not None and not (t.name == "#text" and inside[i]):
                found[t.key][p].append(i)
    return found


def layouts(pages: list[list[Token]], min_pages: int = MIN_PAGES) -> list[list[int]]:
    """Pages parted by layout: those that share at least half of the tags that make it up."""
    tags = [{t.key for t in tokens if t.key and t.name[0] != "#" and not t.end and (t.name not in _CONTENT or not t.key.endswith(" >"))} for tokens in pages]
    count = Counter(key for keys in tags for key in keys)
    tags = [{key for key in keys if count[key] >= min_pages} for keys in tags]
    found: list[tuple[set[str], list[int]]] = []
    for p in sorted(range(len(pages)), key=lambda p: -len(tags[p])):
        shared = [len(tags[p] & first) / (len(tags[p] | first) or 1) if tags[p] or first else 1.0 for first, _ in found]
        if shared and max(shared) >= 0.5:
            found[shared.index(max(shared))][1].append(p)
        else:
            found.append((tags[p], [p]))
    return [sorted(members) for _, members in found]


def _merged(sequences: list[list[str]]) -> list[str]:
    """All keys in an order that follows the longest sequence, then what others have between its keys."""
    out: list[str] = []
    known: set[str] = set()
    for keys in sorted(sequences, key=len, reverse=True):
        before = None
        for key in keys:
            if key not in known:
                out.insert(0 if before is None else out.index(before) + 1, key)
                known.add(key)
            before = key
    return out


def deduce(pages: list[list[Token]], min_pages: int = MIN_PAGES) -> Template:
    n = len(pages)
    template = Template([set() for _ in pages], [([], []) for _ in pages])
    if n < min_pages:
        return template
    found = occurrences(pages)
    links = [_within(tokens, "a") for tokens in pages]
    need = max(min_pages, n // 2 + 1)
    root: dict[str, dict[int, int]] = {}
    classes: dict[tuple, list[str]] = defaultdict(list)
    for key, places in found.items():
        once = {p: at[0] for p, at in places.items() if len(at) == 1}
        if len(once) >= need:
            # Links that only most pages have are template text, but their slot stays whole: it may be a menu.
            if len(once) == n or not (key.startswith("<a ") or any(links[p][i] for p, i in once.items())):
                root[key] = once
                continue
            for p, i in once.items():
                if pages[p][i].name == "#text":
                    template.fixed[p].add(i)
        classes[tuple((p, len(at)) for p, at in sorted(places.items()))].append(key)
    # Ordered: keep tokens that come in one order on most pages, there where they do.
    placed: list[list[tuple[int, str]]] = [[] for _ in pages]
    for key, once in root.items():
        for p, i in once.items():
            placed[p].append((i, key))
    last, slot = [-1] * n, 0
    for key in _merged([[k for _, k in sorted(page)] for page in placed]):
        at = {p: i for p, i in root[key].items() if i > last[p]}
        if len(at) < need:
            continue
        slot += 1
        for p, i in at.items():
            last[p] = i
            template.begins[p][0].append(i)
            template.begins[p][1].append(slot)
            if pages[p][i].name == "#text":
                template.fixed[p].add(i)
    menus: dict[int, list[bool]] = defaultdict(list)
    for vector, members in classes.items():
        if len(vector) * 2 < n:
            continue  # too few pages support it
        slots = {_slot(template.begins[p], i) for key in members for p, at in found[key].items() for i in at}
        if len(slots) == 1:  # nested: all of the class lies in one slot of the root
            menus[slots.pop()] += [k.startswith("<a ") for k in members if k[0] == "<" and k[1] != "/"]
    linked = {s for s, kinds in menus.items() if any(kinds)}
    texts: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    for p, tokens in enumerate(pages):
        for i, t in enumerate(tokens):
            if t.name == "#text" and t.key and (s := _slot(template.begins[p], i)) in linked:
                texts[s][links[p][i]] += len(t.key)
    template.menus = {s for s, (plain, link) in texts.items() if link > 4 * plain}
    # What changes, within articles and outside: each text counts once, whatever number of pages has it.
    changing: dict[bool, set[str]] = {True: set(), False: set()}
    for p, tokens in enumerate(pages):
        shown = [(i, inside) for i, inside in readable(tokens) if tokens[i].key and i not in template.fixed[p] and _slot(template.begins[p], i) not in template.menus]
        for i, inside in shown:
            if not links[p][i]:
                changing[inside].add(tokens[i].key)
    template.bounded = sum(map(len, changing[True])) >= sum(map(len, changing[False]))
    return template


def _slot(begins: tuple[list[int], list[int]], place: int) -> int:
    k = bisect.bisect_right(begins[0], place)
    return begins[1][k - 1] if k else 0


def walk(tokens: list[Token]) -> Iterator[tuple[int, bool, bool]]:
    """(place, inside, ends) of the texts, line breaks and block bounds of a page outside elements that aren't its text.

    inside: within an article or main element; ends: a block ends here.
    """
    stack: list[tuple[str, bool]] = []
    dropped = article = 0

    def pop_to(depth: int) -> None:
        nonlocal dropped, article
        while len(stack) > depth:
            name, role = stack.pop()
            dropped -= role
            article -= name in ("article", "main")

    for place, t in enumerate(tokens):
        if t.name == "#raw":
            continue
        if t.name == "#text" or t.name == "br":
            if not dropped:
                yield place, article > 0, False
            if t.name == "#text":
                continue
        elif t.name in _BLOCK:
            yield place, article > 0, True
        if t.end:
            for d in range(len(stack) - 1, -1, -1):
                if stack[d][0] == t.name:
                    pop_to(d)
                    break
                if stack[d][0] in ("article", "main", "nav", "aside", "footer") and t.name not in _BLOCK:
                    break  # a stray inline end tag doesn't close sections
            continue
        if t.name in _VOID:
            continue
        if t.name in _ENDS_P and stack and any(name == "p" for name, _ in stack[-8:]):
            for d in range(len(stack) - 1, -1, -1):
                if stack[d][0] == "p":
                    pop_to(d)
                    break
                if stack[d][0] in _BLOCK:
                    break
        if t.name in _REOPEN:
            own, until = _REOPEN[t.name]
            for d in range(len(stack) - 1, -1, -1):
                if stack[d][0] in until:
                    break
                if stack[d][0] == own:
                    pop_to(d)
                    break
        role = t.role or (t.header and not article)
        stack.append((t.name, role))
        dropped += role
        article += t.name in ("article", "main")


def readable(tokens: list[Token]) -> list[tuple[int, bool]]:
    """(place, inside) of the texts that ``walk`` gives."""
    return [(place, inside) for place, inside, ends in walk(tokens) if not ends and tokens[place].name == "#text"]


def blocks(tokens: list[Token], template: Template | None = None, page: int = 0) -> list[str]:
    """The blocks of the main text of one page, which is that page of the template's."""
    bounded = (template is None or template.bounded) and any(t.name in ("article", "main") and not t.end for t in tokens)
    fixed, menus = (template.fixed[page], template.menus) if template else (set(), set())
    begins = template.begins[page] if template else ([], [])
    out: list[str] = []
    held: list[str] = []
    for place, inside, ends in walk(tokens):
        if ends:
            if text := " ".join("".join(held).split()):
                out.append(text)
            held.clear()
        elif tokens[place].name == "br":
            held.append(" ")
        elif place not in fixed and (inside or not bounded) and (bounded or _slot(begins, place) not in menus):
            held.append(tokens[place].text)
    if text := " ".join("".join(held).split()):
        out.append(text)
    return out


def extract(htmls: list[str | None]) -> list[str]:
    """The main texts of pages of one host."""
    tokens = {h: tokenize(h) for h in sorted({h for h in htmls if h})}
    # Copies of a page count once and pages without tokens not at all.
    used = [h for h, page in tokens.items() if any(t.key is not None for t in page)]
    pages = [tokens[h] for h in used]
    parts = layouts(pages)
    # What has too few pages of its layout is held against all pages.
    whole = deduce(pages) if any(len(part) < MIN_PAGES for part in parts) else None
    texts = dict.fromkeys(tokens, "")
    for part in parts:
        own = deduce([pages[p] for p in part]) if len(part) >= MIN_PAGES else None
        for k, p in enumerate(part):
            texts[used[p]] = "\n\n".join(blocks(pages[p], own, k) if own else blocks(pages[p], whole, p))
    return [texts[h] if h else "" for h in htmls]


def host_of(url):
    rest = F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit(""))
    return F.lower(rest)


def main_text(pages: DataFrame, scratch: Scratch | None = None, group: int = GROUP) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    scratch = scratch or Scratch(pages.sparkSession, "html")
    rows = only(pages, "page_id", "url", "html").withColumn("host", host_of(F.col("url")))
    hosts = scratch.save(rows.groupBy("host").agg(F.count("*").alias("n")), "hosts")
    total = hosts.agg(F.sum("n")).first()[0] or 0
    limit = max(10 * group, total // HOT_SHARE)
    large = hosts.where(F.col("n") > limit)  # fewer than HOT_SHARE, or than total / (10 * group) of a small table
    part = F.pmod(F.xxhash64("page_id", "url"), F.greatest(F.lit(1), F.ceil(F.col("n") / group)))

    def work(table: pa.Table) -> pa.Table:
        texts = extract(table["html"].to_pylist())
        return pa.table({"page_id": table["page_id"], "url": table["url"], "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    schema = "page_id bigint, url string, text string, n_chars bigint"
    hot = rows.join(F.broadcast(large), "host").withColumn("part", part).groupBy("host", "part").applyInArrow(work, schema)
    # The other hosts are shuffled once: the join's partitions by host serve the groups too.
    small = rows.join(F.broadcast(large.select("host")), "host", "left_anti").join(hosts.where(F.col("n") <= limit).hint("shuffle_hash"), "host")
    return hot.unionByName(small.withColumn("part", part).groupBy("host", "part").applyInArrow(work, schema))


def op1_html_extraction(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op1_html_extraction": op1_html_extraction}
