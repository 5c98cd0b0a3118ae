"""HTML extraction by wrappers: union-free regular expressions inferred from the pages of a host.

A page is a stream of tags and texts, nested in groups. Streams of one host are aligned group by
group: groups that match stay, texts that differ become slots, a mismatch is resolved by searching
ahead in either stream and makes what was skipped optional, groups of one tag whose attributes
differ become one with any attributes, and neighbouring groups of one shape become one repeated
group. The result is the host's wrapper. It carries for each group how much text and link text it
holds and whether its text ever varied.

The article is read off the wrapper. What doesn't vary from page to page, and what is link text, is
the template's; the rest is the host's own text. From the root, the wrapper is descended as long as
one container (no repeated one) holds at least ``SHARE`` of the host's own text; where that ends is
the article. Headings h1 that vary outside of it are its titles. If pages of another layout remain, the
next article is found in what is left, up to ``LAYOUTS``. <article> and <main> end the descent, and
decide where a host's pages give no evidence, being one page or copies of one. In the article,
what is furniture by tag or by name, and links that never vary, are left out; nothing else is.

Wrappers merge: each batch of pages first makes one wrapper a host, then those are merged in salted
groups, then by host, so a host with a third of all pages is never in one task. Only hosts' rules,
counted first, are broadcast; beyond ``max_rules`` they are joined by a shuffle, hot hosts apart.

Cases: a null html is the empty page, with empty text; pages without a host, or of a null url, share
one wrapper; a page that its host's wrapper gives no article is read without one; a page of any size
is read whole; rows that repeat give equal rows; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import lookup_join
from tessera.llm.tables import stored

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select|math|object|canvas|title)\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr img br input nobr".split())
#: Tags that an open tag of these ends: tag -> tags, up to an element of the third set.
_ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "table tr"), "th": ("td th", "table tr"), "option": ("option", "select")}
_ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _ENDS.items()}
_FURNITURE = frozenset("nav header footer aside form button head dialog menu fieldset".split())
_NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|banner|sidebar|side|menu|nav|navbar|navigation|footer|header|masthead|comments?|replies|disqus|cookies?|consent|notice|notification|alert|promo\w*|sponsor\w*|related|recommend\w*|share|sharing|social|breadcrumbs?|popup|modal|overlay|subscribe|newsletter|widget|login|signup|toolbar|pagination|pager|skip)(?:$|[\s_-])", re.I)
_CONTAINERS = frozenset("html body div section article main center table tbody tr td".split())
SHARE = 0.6
LAYOUTS = 4
_DIGITS = re.compile(r"\d+")


class Group:
    """An element: its tag, its shape (tag and class), whether its name is that of furniture, and its blocks of text and groups in page order."""

    __slots__ = ("bad", "kids", "shape", "tag")

    def __init__(self, tag: str, attributes: str = "") -> None:
        classes, names = _attributes(attributes)
        self.tag, self.kids = tag, []
        self.bad = bool(names and _NAMES.search(names))
        self.shape = tag + (f".{classes}" if classes else "") + ("!" if self.bad else "")


def _attributes(attributes: str) -> tuple[str, str]:
    """The class with its digits folded, long ones as a checksum; and class, id and role as they are."""
    if "=" not in attributes:
        return "", ""
    found = [(k.lower(), (a or b or c).strip()) for k, a, b, c in _ATTRIBUTE.findall(attributes)]
    classes = _DIGITS.sub("0", " ".join(v.lower() for k, v in found if k == "class")).replace("!", "")
    return classes if len(classes) <= 40 else f"{zlib.crc32(classes.encode()):x}", " ".join(v for _, v in found)


def furniture(tag: str, bad: bool, in_article: bool) -> bool:
    return bad or (tag in _FURNITURE and not (tag == "header" and in_article))


def parse(page: str) -> Group:
    """The groups of a page. A text is (characters, link characters, raw pieces); inline tags leave no trace."""
    root = Group("")
    stack = [root]
    block: list[str] = []
    links = link = 0
    at = 0

    def flush() -> None:
        nonlocal links
        if block:
            text = " ".join(html.unescape("".join(block)).split())
            if text:
                stack[-1].kids.append((text, links))
            block.clear()
        links = 0

    def add(raw: str) -> None:
        nonlocal links
        if raw:
            block.append(raw)
            if link:
                links += len(raw)

    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        close, tag = m[2], m[3]
        if tag is None:
            if m[1] and m[1].lower() != "title":
                block.append(" ")
            continue
        tag = tag.lower()
        if tag in _INLINE:
            if tag == "a":
                link = 0 if close else 1
            elif tag == "br":
                block.append(" ")
            elif not close and (g := Group(tag, m[4])).bad:
                # an inline advert or notice is a group of its own
                flush()
                stack[-1].kids.append(g)
                stack.append(g)
                continue
            if close and any(g.tag == tag for g in stack[1:]) and stack[-1].tag == tag:
                flush()
                stack.pop()
            continue
        flush()
        link = 0
        if close:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in _VOID:
            continue
        ends = _ENDS.get(tag)
        for k in range(len(stack) - 1, 0, -1):
            t = stack[k].tag
            if ends and t in ends[0]:
                del stack[k:]
            elif ends and t in ends[1]:
                break
            elif t == "p":
                del stack[k:]
        g = Group(tag, m[4])
        stack[-1].kids.append(g)
        stack.append(g)
    add(page[at:])
    flush()
    return root


# -- wrappers: [shape, pages, characters, link characters, text, optional, repeated, groups] --
SHAPE, PAGES, CHARS, LINKS, TEXT, OPT, REP, KIDS = range(8)
SLOT = 1  # TEXT: None for no text of its own, the checksum of one that never varied, or SLOT


def _digest(text: str) -> str:
    return f"{zlib.crc32(text.encode('utf-8', 'surrogatepass')):08x}{len(text)}"


def wrapper(g: Group) -> list:
    """The wrapper of one page."""
    own = [k for k in g.kids if isinstance(k, tuple)]
    text = _digest("\n".join(t for t, _ in own)) if own else None
    kids = fold([wrapper(k) for k in g.kids if not isinstance(k, tuple)], True)
    return [g.shape, 1, sum(len(t) for t, _ in own), sum(n for _, n in own), text, False, False, kids]


def fits(a: str, b: str) -> bool:
    """Whether two shapes are of one group: equal, or of one tag, one of them with any attributes."""
    if a == b:
        return True
    return (a.endswith(".*") or b.endswith(".*")) and a.partition(".")[0] == b.partition(".")[0] and not a.endswith("!") and not b.endswith("!")


def fold(kids: list[list], one_page: bool = False) -> list[list]:
    """Neighbouring runs of 1, 2 or 3 groups of equal shapes become one repeated run."""
    for period in (1, 2, 3):
        out: list[list] = []
        for k in kids:
            out.append(k)
            while len(out) >= 2 * period and all(out[-i][SHAPE] == out[-i - period][SHAPE] for i in range(1, period + 1)):
                again = out[-period:]
                del out[-period:]
                for i, x in enumerate(again):
                    y = join(out[i - period], x, one_page)
                    y[PAGES] = max(out[i - period][PAGES], x[PAGES])
                    y[REP] = True
                    out[i - period] = y
        kids = out
    return kids


def join(a: list, b: list, one_page: bool = False) -> list:
    """The wrapper of the pages of both; of two groups of one page, the texts together are what may vary."""
    if a[TEXT] is None or b[TEXT] is None:
        text = a[TEXT] if b[TEXT] is None else b[TEXT]
    elif a[TEXT] == SLOT or b[TEXT] == SLOT:
        text = SLOT
    elif one_page:
        text = _digest(a[TEXT] + b[TEXT])
    else:
        text = a[TEXT] if a[TEXT] == b[TEXT] else SLOT
    shape = a[SHAPE] if a[SHAPE] == b[SHAPE] else a[SHAPE].partition(".")[0] + ".*"
    return [shape, a[PAGES] + b[PAGES], a[CHARS] + b[CHARS], a[LINKS] + b[LINKS], text, a[OPT] or b[OPT], a[REP] or b[REP], align(a[KIDS], b[KIDS], one_page)]


def align(a: list[list], b: list[list], one_page: bool = False) -> list[list]:
    out: list[list] = []
    i = j = 0

    def skip(x: list) -> None:
        out.append([*x[:OPT], True, *x[REP:]])

    while i < len(a) and j < len(b):
        if fits(a[i][SHAPE], b[j][SHAPE]):
            out.append(join(a[i], b[j], one_page))
            i, j = i + 1, j + 1
            continue
        ahead_a = next((k for k in range(i, len(a)) if fits(a[k][SHAPE], b[j][SHAPE])), None)
        ahead_b = next((k for k in range(j, len(b)) if fits(b[k][SHAPE], a[i][SHAPE])), None)
        if ahead_a is not None and (ahead_b is None or ahead_a - i <= ahead_b - j):
            while i < ahead_a:
                skip(a[i])
                i += 1
        elif ahead_b is not None:
            while j < ahead_b:
                skip(b[j])
                j += 1
        elif a[i][SHAPE].partition(".")[0] == b[j][SHAPE].partition(".")[0] and not (a[i][SHAPE] + b[j][SHAPE]).count("!"):
            out.append(join(a[i], b[j], one_page))
            i, j = i + 1, j + 1
        else:
            skip(a[i])
            skip(b[j])
            i, j = i + 1, j + 1
    for x in (*a[i:], *b[j:]):
        skip(x)
    return fold(out, one_page)


def _tag(shape: str) -> str:
    return shape.partition(".")[0].rstrip("!")


def rules(w: list) -> dict:
    """From a host's wrapper: the paths of its articles, one a layout, of their titles, and of links that never vary."""

    def any_slot(x: list) -> bool:
        return x[TEXT] == SLOT or any(map(any_slot, x[KIDS]))

    varies = any_slot(w)
    mass: dict[int, float] = {}

    def weigh(x: list, in_article: bool) -> float:
        tag = _tag(x[SHAPE])
        own = max(0, x[CHARS] - x[LINKS]) if x[TEXT] == SLOT or not varies else 0
        inside = in_article or tag in ("article", "main")
        mass[id(x)] = own + sum(weigh(k, inside) for k in x[KIDS] if not furniture(_tag(k[SHAPE]), k[SHAPE].endswith("!"), inside))
        return mass[id(x)]

    def inner(x: list) -> list[list]:
        return [k for k in x[KIDS] if mass.get(id(k))]

    def semantic(x: list, path: list[str]) -> list[list]:
        if _tag(x[SHAPE]) in ("article", "main"):
            return [path]
        return [p for k in inner(x) for p in semantic(k, [*path, k[SHAPE]])]

    def article() -> list[str] | None:
        """The path of the group with most of what ``mass`` still has."""
        x, path = w, []
        total = mass[id(w)]
        if not total:
            return None
        while _tag(x[SHAPE]) not in ("article", "main"):
            best = max(inner(x), key=lambda k: mass[id(k)], default=None)
            if best is None or best[REP] or _tag(best[SHAPE]) not in _CONTAINERS or mass[id(best)] < SHARE * total:
                break
            x = best
            path.append(x[SHAPE])
        taken[tuple(path)] = x
        return path

    weigh(w, False)
    found: list[list[str]] = []
    taken: dict[tuple, list] = {}
    titles: list[list[str]] = []
    if varies:
        while len(found) < LAYOUTS and (path := article()) is not None and path not in found:
            found.append(path)
            x = taken[tuple(path)]
            if not path or x[PAGES] >= w[PAGES]:
                break
            gone, y = mass[id(x)], w
            for shape in path:
                mass[id(y)] -= gone
                y = next(k for k in y[KIDS] if k[SHAPE] == shape and id(k) in mass)
            mass[id(y)] = 0

        def headings(x: list, path: list[str]) -> None:
            for k in x[KIDS]:
                p = [*path, k[SHAPE]]
                if any(p == f[: len(p)] and len(p) == len(f) for f in found) or furniture(_tag(k[SHAPE]), k[SHAPE].endswith("!"), False):
                    continue
                if _tag(k[SHAPE]) == "h1" and k[TEXT] == SLOT:
                    titles.append(p)
                headings(k, p)

        if found and [] not in found:
            headings(w, [])
    else:
        found = semantic(w, [])
    links: list[list[str]] = []

    def linked(x: list, path: list[str]) -> None:
        for k in x[KIDS]:
            p = [*path, k[SHAPE]]
            if not k[KIDS] and k[TEXT] not in (None, SLOT) and k[PAGES] > 1 and k[LINKS] >= 0.9 * k[CHARS] > 0:
                links.append(p)
            linked(k, p)

    if varies:
        linked(w, [])
    return {"article": found, "titles": titles, "links": links}


def extract(root: Group, rule: dict) -> str:
    """The main text of a page by its host's rules."""
    out: list[str] = []
    match = lambda path, want: len(path) == len(want) and all(map(fits, path, want))

    def take(g: Group, path: list[str]) -> None:
        for k in g.kids:
            if isinstance(k, tuple):
                out.append(k[0])
            elif not furniture(k.tag, k.bad, True):
                p = [*path, k.shape]
                if not any(match(p, x) for x in rule["links"]):
                    take(k, p)

    def find(g: Group, path: list[str], wanted: list[list[str]], named: bool) -> int:
        if any(match(path, x) for x in wanted):
            before = len(out)
            take(g, path)
            return len(out) - before
        return sum(find(k, [*path, k.shape], wanted, named or k.tag in ("article", "main")) for k in g.kids if not isinstance(k, tuple) and not furniture(k.tag, k.bad, named))

    for path in rule["article"]:
        if find(root, [], [path], False):
            if rule["titles"]:
                out.clear()
                find(root, [], [path, *rule["titles"]], False)
            return "\n".join(out)

    def own(g: Group) -> Group | None:
        """The first group that is an article by its tag."""
        for k in g.kids:
            if not isinstance(k, tuple) and not furniture(k.tag, k.bad, False):
                if k.tag in ("article", "main"):
                    return k
                if (x := own(k)) is not None:
                    return x
        return None

    take(own(root) or root, [])
    return "\n".join(out)


def read_alone(page: str) -> str:
    """The main text of a page without a wrapper: what is left of its article, or of the page, without furniture."""
    return extract(parse(page), {"article": [], "titles": [], "links": []})


def _combine(rows: Iterator[tuple[str, str]]) -> dict[str, list]:
    made: dict[str, list] = {}
    for host, text in sorted(rows, key=lambda x: (str(x[0]), x[1])):
        w = json.loads(text)
        made[host] = join(made[host], w) if host in made else w
    return made


def host_rules(pages: DataFrame, html_col: str = "__html", salts: int = 16) -> DataFrame:
    """(host, rule) of the pages with their column ``__host``."""

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for k, batch in enumerate(batches):
            made: dict[str, list] = {}
            for host, page in zip(batch["__host"], batch[html_col], strict=True):
                w = wrapper(parse(page))
                made[host] = join(made[host], w) if host in made else w
            yield pd.DataFrame({"__host": list(made), "salt": [k % salts] * len(made), "w": [json.dumps(w) for w in made.values()]})

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        made = _combine(zip(group["__host"], group["w"], strict=True))
        return pd.DataFrame({"__host": list(made), "w": [json.dumps(w) for w in made.values()]})

    def last(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        made = _combine(zip(group["__host"], group["w"], strict=True))
        return pd.DataFrame({"__host": list(made), "rule": [json.dumps(rules(w)) for w in made.values()]})

    each = pages.select("__host", html_col).mapInPandas(first, "__host string, salt int, w string")
    some = each.groupBy("__host", "salt").applyInPandas(merge, "__host string, w string")
    return some.groupBy("__host").applyInPandas(last, "__host string, rule string")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", max_rules: int = 20_000) -> DataFrame:
    """One row per page: id, url, text and n_chars."""
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))
    rows = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), F.coalesce(F.col(html_col), F.lit("")).alias("__html"), host.alias("__host"))
    found = stored(host_rules(rows))
    joined = lookup_join(rows, found, ["__host"], max_rows=max_rules)
    schema = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType), T.StructField(url_col, T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, dict] = {}
        for batch in batches:
            texts = []
            for page, rule in zip(batch["__html"], batch["rule"], strict=True):
                if rule not in known:
                    if len(known) > 5000:
                        known.clear()
                    known[rule] = json.loads(rule)
                texts.append(extract(parse(page), known[rule]))
            yield pd.DataFrame({id_col: batch["__id"], url_col: batch["__url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return joined.select("__id", "__url", "__html", "rule").mapInPandas(run, schema)
