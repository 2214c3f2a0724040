"""Main text of web pages by two-pass block rules.

Pass one labels each text block by itself: blocks inside page furniture (menus, headers,
footers, sidebars, notices, adverts, forms, comments) are bad; else link density, length
and stop-word density decide between good, bad and, for short blocks, undecided. Pass two
gives each undecided block the label of its nearest decided neighbours. An article mark is
a prior for undecided blocks alone, and only where the marked part holds most of the good
text. Where the stop-word lists say nothing (a page with few of any listed language, a block
in another script) length and link density decide.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm import text as tx
from wattloom.llm.quality import COMMON_WORDS
from wattloom.session import ship

#: Characters under which a block alone decides nothing, and above which few stop words do.
SHORT, LONG = 70, 200
MAX_LINKS, STOP_LOW, STOP_HIGH = 0.4, 0.1, 0.2
#: Link density above which a block with few stop words is bad anywhere.
FEW_LINKS = 0.2

# Element names and name parts of page furniture.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
CODE = frozenset("script style".split())  # unclosed, they run to the page's end as in a browser
VERBATIM = "xmp"  # raw text that is shown
HIDDEN = frozenset("select svg object template noscript option optgroup datalist".split())  # elements whose children are no text
FURNITURE = frozenset("nav footer aside form menu dialog fieldset".split())
BLOCKS = frozenset("address article aside blockquote body caption center col colgroup dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NAMES = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar comment comments disqus reply replies respond share sharing social related recommended trending widget skip search copyright".split())
#: Words that beside a name part leave a class or id furniture (comment-list, but not code-comment).
GLUE = frozenset("a an all and area article bar block body bottom box button buttons col column container content count feed footer foot form global group head header icon icons inner item items left link links list main message mobile nav outer page panel post primary right row secondary section site slot story text the title to top user view web website wrap wrapper".split())
#: Beginnings of name parts that tell what an element is beside any other words, and words that take that back.
REMARKS = ("comment", "disqus", "respond", "replies")
TELLING = ("advert", "adsby", "adslot", "adunit", "sponsor", "sidebar", "breadcrumb", "newsletter", "cookie", "navbar", "pagination", "promo", "popup", "widget", "sharing", "recommend", "trending")
UNSAID = frozenset("code no not has with without enabled disabled open closed closing inline layout is".split())
DATA = frozenset("pre td th li dd".split())  # code, tables and lists have few stop words by nature
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
#: Elements that a block ends, as none can be in them.
CLOSED = ("p", "select", "svg", "option", "optgroup")
#: Elements inside each other that are told apart, as in browsers; deeper ones belong to the last of them.
DEPTH = 512

_NAME = re.compile(r"[^\s/>]+")
_GAP = re.compile(r"[\s/]*")
_KEY = re.compile(r"=?[^\s/>=]*")
_WHOLE = re.compile(r'([a-zA-Z-]+)="([^"<>]*)"')  # the usual form, at once
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_ENDS = re.compile(rf"</({'|'.join(sorted(RAW | HIDDEN))})(?=[\s/>])", re.I)
_END_OF = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_WORD = re.compile(r"[^\W\d_]+")
_STOP_OF = {k: frozenset(ws) for k, ws in COMMON_WORDS.items()}
_STOP = frozenset(w for ws in COMMON_WORDS.values() for w in ws)
_IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "a": {"a"}}


class Tokens:
    """Text, start tags, end tags and raw text of a page, in one pass that is linear in its
    size: no character is looked at again after a search that failed."""

    def __init__(self, page: str):
        self.page = page
        self.unpaired = {'"': False, "'": False}  # no such quote is left
        self.last_end = {m[1].lower(): m.start() for m in _ENDS.finditer(page)}

    def __iter__(self) -> Iterator[tuple[str, str, dict[str, str], bool]]:
        """(kind, name or text, attributes, closed by itself); kinds: text, raw, start, end."""
        page, pos, size = self.page, 0, len(self.page)
        while pos < size:
            at = page.find("<", pos)
            if at < 0:
                yield "text", page[pos:], {}, False
                return
            if at > pos:
                yield "text", page[pos:at], {}, False
            mark = page[at + 1 : at + 2]
            slash = mark == "/"
            letter = page[at + 2 : at + 3] if slash else mark
            if letter.isascii() and letter.isalpha():
                name = _NAME.match(page, at + 1 + slash)
                attributes, itself, pos = self._attributes(name.end())
                if pos < 0:  # the page ends inside the tag
                    return
                tag = name[0].lower()
                yield "end" if slash else "start", tag, attributes, itself
                if not slash and tag in RAW:
                    if self.last_end.get(tag, -1) >= pos:
                        end = _END_OF[tag].search(page, pos).start()
                        yield "raw", page[pos:end], {"of": tag}, False
                        pos = end
                    elif tag in CODE:
                        return
            elif mark in ("!", "?") and mark or slash and letter:
                if page.startswith("<!--", at):
                    begin = at + 4
                    if page.startswith((">", "->"), begin):
                        end = page.find(">", begin)
                    else:
                        ends = [x for x in (page.find("-->", begin), page.find("--!>", begin, self._bound(begin))) if x >= 0]
                        end = page.find(">", min(ends)) if ends else -1
                else:
                    end = page.find(">", at)
                if end < 0:
                    return
                pos = end + 1
            else:
                yield "text", "<", {}, False
                pos = at + 1

    def _bound(self, begin: int) -> int:
        end = self.page.find("-->", begin)
        return end if end >= 0 else len(self.page)

    def _attributes(self, pos: int) -> tuple[dict[str, str], bool, int]:
        """Attributes of a tag from pos, whether it ends in a slash of its own, and where it
        ends (-1: nowhere). A quote that nothing closes ends with its tag."""
        page, found = self.page, {}
        while True:
            gap = _GAP.match(page, pos)
            pos = gap.end()
            if pos >= len(page):
                return found, False, -1
            if page[pos] == ">":
                return found, gap[0].endswith("/"), pos + 1
            whole = _WHOLE.match(page, pos)
            if whole:
                found.setdefault(whole[1].lower(), whole[2])
                pos = whole.end()
                continue
            key = _KEY.match(page, pos)
            pos = key.end()
            value = ""
            if equals := _EQUALS.match(page, pos):
                pos = equals.end()
                quote = page[pos : pos + 1]
                if quote in self.unpaired:
                    end = -1 if self.unpaired[quote] else page.find(quote, pos + 1)
                    if end < 0:
                        self.unpaired[quote] = True
                        end = page.find(">", pos)
                        if end < 0:
                            return found, False, -1
                        value, pos = page[pos + 1 : end], end
                    else:
                        value, pos = page[pos + 1 : end], end + 1
                else:
                    bare = _BARE.match(page, pos)
                    value, pos = bare[0], bare.end()
            found.setdefault(key[0].lower(), value)


def _named(value: str) -> str:
    """What class or id names say: "" nothing, sure (made of name parts and words that say
    nothing else), remark (a part that begins as reader comments do) or suspect (one that
    begins as other furniture does)."""
    said = ""
    for name in value.split():
        parts = [x.lower() for x in _PART.findall(name)]
        if any(x in NAMES for x in parts) and all(x in NAMES or x in GLUE for x in parts):
            return "sure"
        if UNSAID.isdisjoint(parts):
            if any(x.startswith(REMARKS) for x in parts):
                said = "remark"
            elif not said and any(x.startswith(TELLING) for x in parts):
                said = "suspect"
    return said


def _kind(tag: str, attributes: dict[str, str], in_article: bool) -> str:
    """What an element is: as _named, sure by its own name or role, or hidden."""
    if tag in HIDDEN:
        return "hidden"
    if tag in FURNITURE or (tag == "header" and not in_article):
        return "sure"
    if not attributes:
        return ""
    get = lambda k: entities.unescape(attributes[k]).lower() if k in attributes else ""
    if "hidden" in attributes or get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", get("style")):
        return "hidden"
    if get("role") in ROLES:
        return "sure"
    if tag in ("html", "body", "main"):
        return ""
    said = _named(entities.unescape(attributes.get("class", "") + " " + attributes.get("id", "")))
    if tag == "article":
        return "remark" if said and any(x.lower().startswith(REMARKS) for x in _PART.findall(attributes.get("class", "") + " " + attributes.get("id", ""))) else ""
    return said


def blocks(page: str) -> list[dict]:
    """Text blocks in page order: text, links (characters in links), bad (in furniture),
    article (in a marked article), data (in code, a table or a list).

    An element that only a part of its name makes furniture (post-comments-v2, but also
    layout-sidebar-left) is not, where it holds the article mark or most of the text."""
    out: list[dict] = []
    parts: list[str] = []
    links = 0
    open_tags: list[tuple[str, str, bool, int]] = []  # name, what it is, article, suspect (0: none)
    depth: dict[str, int] = defaultdict(int)  # open tags by name, and of each kind
    deeper: dict[str, int] = defaultdict(int)  # open tags beyond DEPTH
    suspects: list[str] = [""]  # kind of each
    around: list[set[int]] = [set()]  # suspects that hold each article mark
    inside: list[int] = []  # suspects that are open

    def push(tag: str, said: str, article: bool, suspect: int) -> None:
        open_tags.append((tag, said, article, suspect))
        depth[tag] += 1
        depth["*bad"] += said == "sure"
        depth["*hidden"] += said == "hidden"
        depth["*article"] += article
        depth["*data"] += tag in DATA
        depth["*closed"] += tag in CLOSED
        if article:
            around[0] |= set(inside)
        if suspect:
            inside.append(suspect)

    def drop(k: int) -> None:
        tag, said, article, suspect = open_tags.pop(k)
        depth[tag] -= 1
        depth["*bad"] -= said == "sure"
        depth["*hidden"] -= said == "hidden"
        depth["*article"] -= article
        depth["*data"] -= tag in DATA
        depth["*closed"] -= tag in CLOSED
        if suspect:
            inside.remove(suspect)

    def flush() -> None:
        nonlocal links
        text = " ".join("".join(parts).split())
        if text:
            out.append({"text": text, "links": links, "bad": depth["*bad"] > 0, "article": depth["*article"] > 0, "data": depth["*data"] > 0, "suspects": tuple(inside)})
        parts.clear()
        links = 0

    def add(text: str) -> None:
        nonlocal links
        if depth["*hidden"]:
            return
        parts.append(text)
        if depth["a"] > 0:
            links += len(" ".join(text.split()))

    tokens = Tokens(page)
    for kind, name, attributes, itself in tokens:
        if kind == "text":
            add(entities.unescape(name))
            continue
        if kind == "raw":
            if attributes["of"] == VERBATIM:
                add(name)
                flush()
            continue
        if name == "br":
            parts.append(" ")
        elif name in BLOCKS and not depth["*hidden"]:
            flush()
        if kind == "end":
            if deeper[name]:
                deeper[name] -= 1
            elif depth[name] > 0 and name not in RAW:
                k = len(open_tags) - 1
                while open_tags[k][0] != name:
                    k -= 1
                if name in BLOCKS or name in HIDDEN or not any(t[0] in BLOCKS for t in open_tags[k:]):
                    while len(open_tags) > k:
                        drop(len(open_tags) - 1)
                else:  # an inline element that blocks outlive
                    drop(k)
            continue
        if name in VOID or name in RAW or itself:
            continue
        if name in HIDDEN and name not in ("option", "optgroup") and tokens.last_end.get(name, -1) < 0:
            continue  # nothing on the page ends it
        while depth["*closed"] and name in BLOCKS and name not in HIDDEN:
            k = len(open_tags) - 1
            while k >= 0 and open_tags[k][0] not in BLOCKS and open_tags[k][0] not in CLOSED:
                k -= 1
            if k < 0 or open_tags[k][0] not in CLOSED:
                break
            while len(open_tags) > k:
                drop(len(open_tags) - 1)
        if name in _IMPLIED and open_tags and open_tags[-1][0] in _IMPLIED[name]:
            drop(len(open_tags) - 1)
            if name == "tr" and open_tags and open_tags[-1][0] == "tr":
                drop(len(open_tags) - 1)
        if len(open_tags) >= DEPTH:
            deeper[name] += 1
            continue
        said = _kind(name, attributes, depth["*article"] > 0)
        suspect = 0
        if said in ("remark", "suspect"):
            suspects.append(said)
            suspect = len(suspects) - 1
        push(name, said, name in ("article", "main") and not said, suspect)
    flush()
    if len(suspects) > 1:
        total, held = 0, [0] * len(suspects)
        for b in out:
            if not b["bad"]:
                total += len(b["text"])
                for k in b["suspects"]:
                    held[k] += len(b["text"])
        innocent = {k for k in range(1, len(suspects)) if k in around[0] or held[k] > (0.9 if suspects[k] == "remark" else 0.5) * total}
        for b in out:
            b["bad"] = b["bad"] or not innocent.issuperset(b["suspects"])
    return out


def _size(text: str) -> int:
    """Characters; one of a wide script (from U+2E80 on) says as much as three."""
    return len(text) if text.isascii() else len(text) + 2 * sum(c >= "\u2e80" for c in text)


def _foreign(text: str) -> bool:
    """Whether most letters are not Latin: no listed language can match."""
    if text.isascii():
        return False
    letters = [c for c in text if c.isalpha()]
    return 2 * sum(c >= "\u0250" and not "\u1e00" <= c <= "\u1eff" for c in letters) > len(letters)


def label(found: list[dict]) -> list[bool]:
    """Whether each block belongs to the main text."""
    words = [_WORD.findall(b["text"].lower()) for b in found]
    open_blocks = [i for i, b in enumerate(found) if not b["bad"] and b["links"] <= MAX_LINKS * len(b["text"])]
    total = sum(len(words[i]) for i in open_blocks)
    counts = [sum(w in _STOP_OF[k] for i in open_blocks for w in words[i]) for k in _STOP_OF]
    unlisted = max(counts) < STOP_LOW * total
    first: list[bool | None] = [False] * len(found)
    few: list[int] = []  # long enough, few links, no stop word
    for i in open_blocks:
        b, size = found[i], _size(found[i]["text"])
        stop = sum(w in _STOP for w in words[i]) / len(words[i]) if words[i] else 0.0
        density = b["links"] / len(b["text"])
        if size < SHORT:
            first[i] = None if density == 0 or b["article"] else False
        elif stop >= STOP_HIGH or size > LONG and stop >= STOP_LOW:
            first[i] = True
        elif stop >= STOP_LOW:
            first[i] = None
        elif density <= FEW_LINKS:
            if unlisted or _foreign(b["text"]):
                first[i] = True
            else:
                first[i] = None
                if not stop:
                    few.append(i)
    good = [i for i in open_blocks if first[i]] or open_blocks
    inside = sum(_size(found[i]["text"]) for i in good if found[i]["article"])
    marked = 2 * inside >= sum(_size(found[i]["text"]) for i in good) > 0
    for i in few:
        if not (found[i]["data"] or marked and found[i]["article"]):
            first[i] = False
    if not marked:
        for i in open_blocks:
            if first[i] is None and found[i]["links"] and _size(found[i]["text"]) < SHORT:
                first[i] = False
    return _inherit(found, first, marked)


def _nearest(use: list[bool | None]) -> list[tuple[int | None, int | None]]:
    """The nearest decided places on both sides of each place."""
    out: list[list[int | None]] = [[None, None] for _ in use]
    for side, order in ((0, range(len(use))), (1, range(len(use) - 1, -1, -1))):
        last = None
        for i in order:
            if use[i] is not None:
                last = i
            out[i][side] = last
    return [tuple(x) for x in out]


def _inherit(found: list[dict], first: list[bool | None], marked: bool) -> list[bool]:
    """Labels of undecided blocks from the nearest decided neighbour on each side; when
    they differ, the nearer one, but furniture does not outvote text. Without any sure text on
    an unmarked page undecided blocks are good. In a marked article only its own blocks are neighbours, and
    ties and blocks without neighbours are good; on a marked page outside of it they are
    bad, on other pages ties are good."""
    inner = [marked and b["article"] and not b["bad"] for b in found]
    everywhere = _nearest(first)
    within = _nearest([x if y else None for x, y in zip(first, inner)]) if marked else everywhere
    sure = any(first)
    out = []
    for i, x in enumerate(first):
        if x is not None:
            out.append(x)
            continue
        a, b = within[i] if inner[i] else everywhere[i]
        if not (sure or marked):  # no sure text on the page: what may be text is
            out.append(True)
        elif a is None and b is None:
            out.append(inner[i])
        elif a is None or b is None:
            out.append(bool(first[b if a is None else a]))
        elif first[a] == first[b]:
            out.append(bool(first[a]))
        elif found[b if first[a] else a]["bad"]:  # between text and furniture: an end of the text
            out.append(inner[i] or not marked)
        elif i - a == b - i:
            out.append(inner[i] or not marked)
        else:
            out.append(bool(first[a if i - a < b - i else b]))
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n".join(b["text"] for b, good in zip(found, label(found)) if good)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages.

    A null or empty page, and one without main text, has an empty text. Broken markup is
    read as far as it can be; a page is never cut. Repeated rows give repeated results,
    extra columns are ignored, an empty table gives no rows."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.slices(batches, 2):
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
