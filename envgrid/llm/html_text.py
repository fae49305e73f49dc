"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags (and at two line breaks in a row). Markup decides first where it speaks: blocks in
parts that it names as no part of the article (menus, headers, footers, side bars, notices, adverts, forms, comments, hidden
parts) are bad, and where a page has an article, so is what lies outside of it, but for a lead before it that pass one would
call good. All other blocks are labelled by the passes. Pass one takes link density, length and stop-word density: good, bad, or
undecided (short, some links in a sentence, or too few stop words for its length). Where no list of stop words fits (no longer block of the
page has a share of them, or most of a block's letters are of another script), length and sentence marks stand for them. Where no
block is good, the page is measured by itself: undecided blocks of at least half the longest one's length are good. In pass
two undecided blocks take the label of the nearest decided block of the same section; of two equally near ones the good one
counts. A heading takes the label of the next decided block. Inside an article a link-filled block is bad only next to another
one, bad labels pass on to headings only, and where no block is decided all are good; so no page with unlinked text outside of
named parts is emptied. Outside of articles a block that begins with a copyright sign is a notice and counts as links.

Null, empty and text-free pages give the empty text. Repeated rows give repeated results, extra columns are ignored
(those to keep are named), ties are as said above, long pages, tags and attributes are read in whole in one linear scan,
and an empty table gives an empty result. Rows are independent, so nothing shuffles.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from envgrid.llm.common import map_texts, read

SHORT, LONG = 70, 140
LINKS, LINKS_IN_ARTICLE = 0.2, 0.5
STOP_LOW, STOP_HIGH = 0.10, 0.15

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other
    der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis
    le la les et des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son aux ou elle été ses mais comme nous sa fait être ont cette leur
    el los del las por con para una su al lo más sus le ya este porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo y que de se no como pero""".split()
)

# Elements, and words of class, id and role, that stand for parts outside the main text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEAVES = frozenset("p li td th tr dt dd option h1 h2 h3 h4 h5 h6 a b i em strong u s small sub sup code font q cite abbr time mark".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas select".split())
ZONES = frozenset("nav footer aside form button dialog menu head fieldset".split())
WORDS = frozenset(
    """ad ads advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter
    subscribe subscription signup login menu nav navbar navigation breadcrumb breadcrumbs sidebar sidebars widget widgets footer masthead comment comments disqus respond reply replies share sharing social related
    recommended pagination pager toolbar search copyright complementary contentinfo navigation dialog""".split()
)

#: Words that may stand beside one of WORDS in a class, id or role of several words.
BESIDE = frozenset(
    """area article bar block blocks body bottom box btn button buttons center column container content desktop fixed float frame global group header icon icons inner item items left
    link links list local main mobile module outer page panel post posts primary right row secondary section site slot small sticky tab tag text title top unit user view wide wrap wrapper""".split()
)

# quotes count only behind an equals sign; nothing backs up, so a tag of any length is one linear scan
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?…。！？؟।]")
NOTICE = re.compile(r"\s*(?:©|\(c\)\s)", re.I)


def _marks(value: str) -> bool:
    """A name marks a part outside the text: a word of WORDS, alone or beside words that say nothing of the content."""
    parts = [p for p in re.split(r"[_-]+", value) if p and not p.isdigit()]
    return any(p in WORDS for p in parts) and all(p in WORDS or p in BESIDE for p in parts)


def _named(name: str, attrs: str) -> tuple[bool, bool]:
    """(the element's attributes name a zone outside the text, they name a header)."""
    if "=" not in attrs and "hidden" not in attrs:
        return False, False
    names: set[str] = set()
    for key, a, b, c in ATTRIBUTE.findall(attrs):
        key, value = key.lower(), (a or b or c).lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            return name not in ("html", "body"), False
        if key in ("class", "id", "role"):
            names.update(value.split())
    if name in ("html", "body", "main") or (name == "article" and not names & {"comment", "comments", "reply"}):
        return False, False
    return any(map(_marks, names)), any("header" in re.split(r"[_-]+", x) for x in names)


class Block:
    """A block's text, the length of its links, its section (0 outside articles), and whether it is a heading or in a part that markup names as no text."""

    __slots__ = ("heading", "links", "section", "text", "zone")

    def __init__(self, text: str, links: int, section: int, heading: bool = False, zone: bool = False):
        self.text, self.links, self.section, self.heading, self.zone = text, links, section, heading, zone


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order."""
    out: list[Block] = []
    parts: list[str] = []
    stack: list[tuple[str, int, int]] = []  # name; 1: zone, 2: header; section
    zones = headers = section = sections = links = in_link = breaks = 0
    heading = False

    def close() -> None:
        nonlocal links, breaks
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, links, section, heading, zones > 0 or (headers > 0 and not heading)))
            parts.clear()
        links = breaks = 0

    def add(raw: str) -> None:
        nonlocal links, breaks
        parts.append(raw)
        if raw.strip():
            breaks = 0
            if in_link:
                links += len(" ".join(html.unescape(raw).split()))

    at, n = 0, len(page)
    last = n if page.rfind("<!--") > page.rfind("-->") else page.rfind(">") + 1  # no tag ends behind it
    while at < n:
        m = TOKEN.search(page, at, last) if at < last else None
        if not m:
            add(page[at:] if page.rfind("<!", at) < 0 and not re.search(r"<[a-zA-Z/][^<>]*\Z", page[at:]) else re.sub(r"<[a-zA-Z/!][^<>]*\Z", "", page[at:]))
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name, closing = name.lower(), bool(m[1])
        if name == "br":
            parts.append(" ")
            breaks += 1
            if breaks > 1:
                close()
            continue
        if name in BLOCKS:
            close()
            heading = not closing and name in ("h1", "h2", "h3", "h4", "h5", "h6") or (heading and name not in ("h1", "h2", "h3", "h4", "h5", "h6"))
        if name in VOID or (m[3].endswith("/") and name in RAW):
            continue
        if not closing and name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name == "a":
            in_link = 0 if closing else 1
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    for _, kind, before in reversed(stack[i:]):
                        zones -= kind == 1
                        headers -= kind == 2
                        section = before
                    del stack[i:]
                    break
            continue
        zone, header = _named(name, m[3])
        if name in ZONES or zone:
            kind = 1
        elif name == "header" or header:
            kind = 2 if section else 1
        else:
            kind = 0
        if name in LEAVES and not kind:
            continue
        if name in LEAVES and name in BLOCKS:
            # such elements end without an end tag; only what lies in a named one is left out
            end = re.compile(rf"</?{name}\b[^>]*>|</(?:ul|ol|table|div|section|article)>", re.I).search(page, at)
            at = end.start() if end else n
            continue
        stack.append((name, kind, section))
        zones += kind == 1
        headers += kind == 2
        if name in ("article", "main") and not zones and not section:
            sections += 1
            section = sections
    close()
    return out


def stop_share(text: str) -> float:
    words = WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def other_script(text: str) -> bool:
    """Most letters are of a script that none of the lists of stop words is written in."""
    letters = [c for c in text if c.isalpha()]
    return 2 * sum(c > "\u024f" for c in letters) > len(letters)


def by_words(text: str, listed: bool) -> tuple[bool | None, str]:
    """The label of a block of at least SHORT characters with few links."""
    wide = other_script(text)
    if wide or not listed:
        return (True, "words") if len(text) > (LONG // 2 if wide else LONG) and SENTENCE.search(text) else (None, "")
    stops = stop_share(text)
    if stops >= STOP_HIGH and len(text) > LONG:
        return True, "words"
    return (None, "") if stops >= STOP_LOW else (False, "words")


def first_pass(blocks: list[Block]) -> list[tuple[bool | None, str]]:
    """(label, what decided it) of each block: good (True), bad (False) or undecided (None)."""
    within = any(b.section and not b.zone for b in blocks)
    lead = next((i for i, b in enumerate(blocks) if b.section and not b.zone), 0)
    filled = [b.links > LINKS_IN_ARTICLE * len(b.text) for b in blocks]
    listed = any(stop_share(b.text) >= STOP_LOW for b in blocks if not b.zone and len(b.text) >= SHORT)
    out: list[tuple[bool | None, str]] = []
    for i, b in enumerate(blocks):
        n = len(b.text)
        if b.zone:
            out.append((False, "markup"))
        elif within and not b.section:
            out.append((True, "words") if i < lead and not b.links and n >= SHORT and by_words(b.text, listed)[0] else (False, "markup"))
        elif filled[i]:
            beside = any(0 <= j < len(blocks) and filled[j] and blocks[j].section == b.section and not blocks[j].zone for j in (i - 1, i + 1))
            out.append((None, "") if b.section and not beside else (False, "links"))
        elif not b.section and NOTICE.match(b.text):
            out.append((False, "links"))
        elif n < SHORT:
            linked = b.links > LINKS * n and not SENTENCE.search(b.text[-2:])
            out.append((False, "links") if not b.section and linked else (None, ""))
        elif b.links > LINKS * n and not b.section:
            out.append((None, ""))
        else:
            label = by_words(b.text, listed)
            out.append((None, "") if b.section and not label[0] else label)
    if not within and not any(label for label, _ in out):
        free = [i for i, (label, _) in enumerate(out) if label is None and blocks[i].links <= LINKS * len(blocks[i].text)]
        longest = max((len(blocks[i].text) for i in free), default=0)
        for i in free:
            if 2 * len(blocks[i].text) >= longest:
                out[i] = (True, "words")
    return out


def second_pass(blocks: list[Block], labels: list[tuple[bool | None, str]]) -> list[tuple[bool, str]]:
    """The labels, undecided blocks having taken that of a decided one of their section (what markup alone decided doesn't count)."""
    n = len(blocks)
    near: list[list[int]] = [[], []]  # the decided block before and behind each, or -1
    for side, places in enumerate((range(n), range(n - 1, -1, -1))):
        seen: dict[int, int] = {}
        near[side] = [-1] * n
        for i in places:
            section, (label, why) = blocks[i].section, labels[i]
            near[side][i] = seen.get(section, -1)
            if label is not None and why != "markup" and (label or not section or why != "links"):
                seen[section] = i
    menu = {i for i in range(n) if labels[i] == (False, "links")}
    out: list[tuple[bool, str]] = []
    for i, b in enumerate(blocks):
        if labels[i][0] is not None:
            out.append(labels[i])
            continue
        before, after = near[0][i], near[1][i]
        if b.heading and i + 1 in menu and blocks[i + 1].section == b.section:
            out.append((False, "neighbour"))
        elif b.heading and after >= 0:
            out.append((labels[after][0], "neighbour"))
        elif found := [(abs(j - i), not labels[j][0]) for j in (before, after) if j >= 0]:
            out.append((not min(found)[1], "neighbour"))
        else:
            out.append((b.section > 0, "default"))
    return out


def labelled_blocks(page: str) -> list[tuple[str, bool, str]]:
    """(text, kept, what decided it: markup, links, words, neighbour or default) of each block in order."""
    blocks = blocks_of(page)
    return [(b.text, good, why) for b, (good, why) in zip(blocks, second_pass(blocks, first_pass(blocks)), strict=True)]


def main_blocks(page: str) -> list[str]:
    """The texts of the page's good blocks, in order."""
    return [t for t, good, _ in labelled_blocks(page) if good]


def extract_text(df: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """Keeps the columns in keep and adds text and n_chars (code points)."""
    types = {f.name: f.dataType.simpleString() for f in df.schema}

    def make():
        def run(pages: list) -> dict:
            texts = ["\n".join(main_blocks(p)) if p else "" for p in pages]
            return {"text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())}

        return run

    return map_texts(df, make, ", ".join(f"{k} {types[k]}" for k in keep) + ", text string, n_chars long", html_col, keep)


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages"))


QUERIES = {"op7_html": op7_html}
