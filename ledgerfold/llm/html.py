"""Main text of web pages by union-free wrappers: the token streams of one host's pages of
one template are aligned into a regular expression of fixed texts and, between them, groups
of optional and repeated text slots. A page is matched against its expression, and what its
slots hold, as far as it belongs to the article, is extracted.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ledgerfold.llm.common import ship
from ledgerfold.llm.urls import host_of
from ledgerfold.session import stored

#: Wrappers of one template are merged in so many parts first.
PARTS = 64
#: Elements of a path, outermost first, that tell the templates of a host apart.
DEPTH = 3
#: Different slots of a group; one with more is a group of any blocks.
GROUP = 64
#: Different pages that must have given a wrapper before its fixed texts count as such: two
#: pages with one story in common would have it as a fixed text.
LEAST_PAGES = 3
#: Bytes of wrappers that are sent to every executor; beyond, pages join by template.
BROADCAST_BYTES = 64 << 20
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
RAW = {n: re.compile(rf"</{n}\s*>|\Z", re.I) for n in ("script", "style", "textarea", "noscript", "template", "iframe", "svg", "title")}
DIGITS = re.compile(r"\d+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Fixed: elements that run in a line of text and do not end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
#: Fixed: elements and names of parts of a page that are not its article.
OUTSIDE = frozenset("nav header footer aside form script style noscript template iframe svg button select textarea dialog menu head title object canvas".split())
OUTSIDE_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|header|masthead|footer|sidebar|side|widget\w*|related|share|social"
    r"|comments?|replies|disqus|cookies?|consent|notice\w*|alert|popup|modal|newsletter|subscribe|login|search|skip)(?:$|[\s_-])", re.I,
)
OUTSIDE_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
ARTICLE = frozenset("article main".split())
ARTICLE_NAME = re.compile(r"(?:^|[\s_-])(?:article|main|content|post|entry|story)(?:$|[\s_-])|articleBody", re.I)
#: Elements that an end of their parent closes, and that a sister closes.
SELF_CLOSED = frozenset("p li dt dd tr td th option thead tbody tfoot".split())
BLOCK_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())


def blocks(page: str | None) -> list[tuple[str, str]]:
    """(path, text) of a page's blocks in page order. A path names the elements around the
    block that matter, outermost first. Malformed markup is read as browsers do for the
    common cases: open paragraphs and items end with the next, stray ends are ignored."""
    page = page or ""
    found: list[tuple[str, str]] = []
    path: list[str] = []
    words: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(words)).split())
        if text:
            found.append(("/".join(path), text))
        words.clear()

    def close(upto: int) -> None:
        flush()
        del path[upto:]

    at = 0
    while True:
        token = TOKEN.search(page, at)
        words.append(page[at:token.start()] if token else page[at:])
        if not token:
            break
        at = token.end()
        name = (token["name"] or "").lower()
        if token["data"] is not None:
            words.append(html.escape(token["data"]))
        if not name:
            continue
        if token["end"]:
            if name in INLINE:
                continue
            depth = next((i for i in range(len(path) - 1, -1, -1) if path[i].split(".", 1)[0] == name), None)
            if depth is not None:
                close(depth)
            else:
                flush()
            continue
        if name == "br":
            words.append(" ")
        if name in INLINE:
            continue
        flush()
        if name in VOID:
            continue
        if name in RAW and not token["attributes"].endswith("/"):
            end = RAW[name].search(page, at)
            at = end.end()
            continue
        if name in BLOCK_CLOSES_P and path and path[-1] == "p":
            path.pop()
        if name in SELF_CLOSED and path and path[-1].split(".", 1)[0] == name:
            path.pop()
        names = ".".join(sorted({(b or c or d).strip().lower() for _, b, c, d in ATTRIBUTE.findall(token["attributes"])} - {""})) if token["attributes"] else ""
        # Numbers in names tell pages apart, not their parts.
        path.append(f"{name}.{DIGITS.sub('0', names).replace('/', ' ')}" if names else name)
    flush()
    return found


def outside(path: str) -> bool:
    for step in path.split("/"):
        name, _, names = step.partition(".")
        if name in OUTSIDE or (names and name not in ("html", "body") and (OUTSIDE_NAME.search(names.replace(".", " ")) or not OUTSIDE_ROLE.isdisjoint(names.split(".")))):
            return True
    return False


class Slot(NamedTuple):
    """A text slot of a group: blocks of one path, which may repeat or be absent."""

    path: str
    repeats: bool = False
    optional: bool = False


class Wrapper(NamedTuple):
    """``groups[0] fixed[0] groups[1] fixed[1] ... groups[-1]``: a fixed text is on every page
    in this place, a group is a repeated run of its slots, and None a run of any blocks.
    ``pages`` counts the different pages that gave it."""

    fixed: list[str]
    groups: list[list[Slot] | None]
    pages: int


def tokens(found: list[tuple[str, str]]) -> list[str]:
    """One token per block: path, digest of the text, and which one of its kind it is on the
    page, so that a text that stands twice has two tokens."""
    seen: Counter[tuple[str, str]] = Counter()
    out = []
    for block in found:
        digest = hashlib.blake2b(block[1].encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()
        out.append(f"{block[0]}\t{digest}.{seen[block]}")
        seen[block] += 1
    return out


def path_of(token: str) -> str:
    return token.rpartition("\t")[0]


def page_wrapper(found: list[tuple[str, str]]) -> Wrapper:
    """The wrapper of a single page, of which all is fixed."""
    fixed = tokens(found)
    return Wrapper(fixed, [[] for _ in range(len(fixed) + 1)], 1)


def common(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    """Places of a longest sequence that both sides hold in the same order. No token stands
    twice on a side, so this is a longest rising run of places: n log n, not n * n."""
    place = {token: i for i, token in enumerate(right)}
    pairs = [(i, place[token]) for i, token in enumerate(left) if token in place]
    ends: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for n, (_, at) in enumerate(pairs):
        k = bisect_left(ends, at)
        before.append(last[k - 1] if k else -1)
        ends[k:k + 1], last[k:k + 1] = [at], [n]
    run = []
    n = last[-1] if last else -1
    while n >= 0:
        run.append(pairs[n])
        n = before[n]
    return run[::-1]


def _between(wrapper: Wrapper, first: int, end: int) -> list[Slot] | None:
    """The group of all that lies from fixed text ``first`` up to ``end``: fixed texts that
    another page does not have become slots, and a path that stands twice repeats."""
    slots: dict[str, Slot] = {}
    for i in range(first, end + 1):
        group = wrapper.groups[i]
        if group is None:
            return None
        for slot in group + ([Slot(path_of(wrapper.fixed[i]))] if i < end else []):
            known = slots.get(slot.path)
            slots[slot.path] = slot if known is None else Slot(slot.path, True, known.optional and slot.optional)
    return list(slots.values())


def _group(left: list[Slot] | None, right: list[Slot] | None) -> list[Slot] | None:
    """One group for both sides: what only one has is optional."""
    if left is None or right is None:
        return None
    one, two = {s.path: s for s in left}, {s.path: s for s in right}
    both = [Slot(s.path, s.repeats or two[s.path].repeats, s.optional or two[s.path].optional) if s.path in two else s._replace(optional=True) for s in left]
    both += [s._replace(optional=True) for s in right if s.path not in one]
    return both if len(both) <= GROUP else None


def aligned(left: Wrapper, right: Wrapper) -> Wrapper:
    """One wrapper for both: the fixed texts that both hold in the same order stay, all
    between them becomes groups. A wrapper never gets more fixed texts than its shortest page
    has blocks, nor more than ``GROUP`` slots to a group, so many pages take linear time."""
    if left.fixed == right.fixed:  # two copies of a page teach nothing
        same = not any(left.groups) and not any(right.groups) and None not in left.groups + right.groups
        pages = max(left.pages, right.pages) if same else left.pages + right.pages
    else:
        pages = left.pages + right.pages
    groups, i, j = [], 0, 0
    run = common(left.fixed, right.fixed)
    for a, b in run + [(len(left.fixed), len(right.fixed))]:
        groups.append(_group(_between(left, i, a), _between(right, j, b)))
        i, j = a + 1, b + 1
    return Wrapper([left.fixed[a] for a, _ in run], groups, pages)


def slots_of(found: list[tuple[str, str]], wrapper: Wrapper | None) -> list[tuple[str, str]] | None:
    """The blocks of a page that stand in the slots of its wrapper; None if the page does not
    match, or if too few pages have given the wrapper to tell what is fixed."""
    if wrapper is None or wrapper.pages < LEAST_PAGES:
        return None
    own = tokens(found)
    run = common(wrapper.fixed, own)
    if len(run) != len(wrapper.fixed):
        return None
    held, at = [], 0
    for group, end in zip(wrapper.groups, [b for _, b in run] + [len(own)]):
        if group is not None and not {path for path, _ in found[at:end]} <= {s.path for s in group}:
            return None
        held += found[at:end]
        at = end + 1
    return held


def _marked(path: str, by_element: bool) -> bool:
    steps = [step.partition(".")[::2] for step in path.split("/")]
    if by_element:
        return any(name in ARTICLE or "articlebody" in names for name, names in steps)
    return any(ARTICLE_NAME.search(names.replace(".", " ")) for _, names in steps)


def article_blocks(found: list[tuple[str, str]], wrapper: Wrapper | None) -> list[tuple[str, str]]:
    """The blocks of a page's article. Blocks outside it go by their element or name. If the
    page marks its article by an element (or, next, by a name), all of that is the article:
    a sentence of it that every page of the host repeats is still part of it. Pages without
    a mark have their article in the slots of their wrapper; where that leaves nothing, or
    no wrapper fits, all blocks count that are not outside."""
    inside = [block for block in found if not outside(block[0])]
    for by_element in (True, False):
        marked = [block for block in inside if _marked(block[0], by_element)]
        if marked:
            return marked
    held = slots_of(found, wrapper)
    return [block for block in held or [] if not outside(block[0])] or inside


def template(found: list[tuple[str, str]]) -> str:
    """Pages of a host whose blocks lie under the same outer elements are aligned with each
    other; parts outside the article, which come and go, do not count. Pages without a block
    inside belong to the template ''."""
    return " ".join(sorted({"/".join(path.split("/")[:DEPTH]) for path, _ in found if not outside(path)}))


def _template_id(found: list[tuple[str, str]]) -> str:
    return hashlib.blake2b(template(found).encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def _merged(wrappers: Iterable[Wrapper]) -> Wrapper | None:
    """Aligned one after the other."""
    merged = None
    for wrapper in wrappers:
        merged = wrapper if merged is None else aligned(merged, wrapper)
    return merged


def _text(wrapper: Wrapper) -> str:
    return json.dumps(wrapper)


def _read(text: str) -> Wrapper:
    fixed, groups, pages = json.loads(text)
    return Wrapper(fixed, [None if g is None else [Slot(*s) for s in g] for g in groups], pages)


_WRAPPERS = pa.schema([("host", pa.string()), ("template", pa.string()), ("wrapper", pa.string())])
#: Wrappers that a task holds at a time before it hands them on.
HELD = 2_000


def _inferred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wrappers of the task's pages; a page's text is gone once it is aligned, and no
    more than ``HELD`` templates are kept before they are handed on."""
    own: dict[tuple[str, str], Wrapper] = {}

    def given() -> pa.RecordBatch:
        rows = {"host": [h for h, _ in own], "template": [t for _, t in own], "wrapper": [_text(w) for w in own.values()]}
        own.clear()
        return pa.RecordBatch.from_pydict(rows, _WRAPPERS)

    for batch in batches:
        for host, page in zip(batch["host"].to_pylist(), batch["html"].to_pylist()):
            found = blocks(page)
            key, wrapper = (host, _template_id(found)), page_wrapper(found)
            own[key] = aligned(own[key], wrapper) if key in own else wrapper
            if len(own) >= HELD:
                yield given()
    yield given()


def _together(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper per template of a task's rows, which come sorted by template."""
    now, merged = None, None
    for batch in tables:
        for host, name, text in zip(*[batch[c].to_pylist() for c in ("host", "template", "wrapper")]):
            if now is not None and now != (host, name):
                yield pa.RecordBatch.from_pydict({"host": [now[0]], "template": [now[1]], "wrapper": [_text(merged)]}, _WRAPPERS)
                merged = None
            now = (host, name)
            merged = _read(text) if merged is None else aligned(merged, _read(text))
    if now is not None:
        yield pa.RecordBatch.from_pydict({"host": [now[0]], "template": [now[1]], "wrapper": [_text(merged)]}, _WRAPPERS)


def wrappers(pages: DataFrame) -> DataFrame:
    """One wrapper per template of a host (columns host, template, wrapper) from all its
    pages: inferred within each task, then merged in ``PARTS`` parts per template, then into
    one. Only wrappers are shuffled, and a merge holds two at a time."""
    shape = "host string, template string, wrapper string"
    found = pages.select("host", "html").mapInArrow(_inferred, shape)
    for part in (F.pmod(F.xxhash64("wrapper"), F.lit(PARTS)), F.lit(0)):
        parted = found.withColumn("part", part)
        found = parted.repartition("host", "template", "part").sortWithinPartitions("host", "template", "part", "wrapper").drop("part").mapInArrow(_together, shape)
    return found


@arrow_udf(T.StringType())
def template_of(pages: pa.Array) -> pa.Array:
    return pa.array([_template_id(blocks(page)) for page in pages.to_pylist()], pa.string())


@arrow_udf(T.StringType())
def article(pages: pa.Array, wrapper: pa.Array) -> pa.Array:
    known: dict[str | None, Wrapper | None] = {None: None}
    texts = []
    for page, own in zip(pages.to_pylist(), wrapper.to_pylist()):
        if own not in known:
            known[own] = _read(own)
        texts.append("\n".join(text for _, text in article_blocks(blocks(page), known[own])))
    return pa.array(texts, pa.string())


def extracted(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, the main text and
    n_chars, its number of code points.

    A page belongs to the host of its url; pages without one share a host. Null and empty
    pages have an empty text, and so have pages without any text in their article. Repeated
    rows give repeated results, and copies of a page count once as long as nothing else is
    known of their template; ids and urls may be null. Texts that all pages of an unmarked
    template share are left out if at least ``LEAST_PAGES`` different pages have given it. Pages
    are read whole; they are not shuffled as long as the wrappers have ``BROADCAST_BYTES`` at most.
    """
    ship(pages.sparkSession)
    rows = pages.select("page_id", "url", "html", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"))
    telling = F.get_json_object("wrapper", "$[2]").cast("long") >= LEAST_PAGES
    found = stored(wrappers(rows).where(telling), "wrappers").toDF("own", "its", "wrapper")
    size = found.agg(F.coalesce(F.sum(F.length("wrapper").cast("long") + F.length("own")), F.lit(0))).first()[0]
    keyed = rows.withColumn("template", template_of("html"))
    joined = keyed.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, (F.col("host") == F.col("own")) & (F.col("template") == F.col("its")), "left")
    texts = joined.select("page_id", "url", article("html", "wrapper").alias("text"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))
