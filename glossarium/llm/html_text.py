"""Main text of web pages: the structure of each page and its host's suffix array.

A page's html becomes blocks of text in four zones: main (inside article, or
main where there is no article), furniture (menus, headers, footers, sidebars,
notices, adverts, forms, comments, known by element, role, class or id),
suspect (in the main part, under a name that only partly tells of furniture)
and plain (pages that mark no main part). The token streams of all blocks of
all pages are cut into suffixes, which are sorted by host and their first
tokens over all tasks (range partitions, so neither a large host nor a frequent
start has to fit into one group). Suffixes that share their first depth tokens
are neighbours there; what recurs on a set share of the host's distinct page
texts (copies count once) is boilerplate. Suffixes that no group of a host's
texts has often enough cannot reach that share and are not sorted. Suspect and
plain blocks keep their other runs; main blocks go where nearly all texts of
the host have them whole; furniture goes in any case.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import blocks
from .common import materialise

MAIN, FURNITURE, PLAIN, SUSPECT = 0, 1, 2, 3
_TITLE = 4  # main if the page has a main part
#: A run of tokens is boilerplate from so many distinct page texts and this share of the host's on.
LEAST, SHARE = 3, 0.25
#: The same for the main part, where shared passages are no boilerplate: what nearly all of a host's pages have is.
INSIDE_LEAST, INSIDE_SHARE = 8, 0.75
#: Texts and windows that end a group of _possible(), and the bits of its result.
GROUP_TEXTS, GROUP_WINDOWS, FILTER_BITS = 1024, 1 << 21, 1 << 24

#: Fixed names: elements whose content is no text, whose content is furniture, that begin and end blocks, and that stay open until closed.
SILENT = "script style noscript template svg iframe object canvas audio video head title select textarea button".split()
_ALONE = frozenset("script style head title select textarea button".split())
ASIDE = frozenset("nav header footer aside form menu".split())
BLOCK = frozenset(
    "p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr caption blockquote pre section article main nav header footer "
    "aside form fieldset figure figcaption hr address details summary body html dialog menu".split()
)
NESTED = frozenset("div section article main nav header footer aside form dialog menu ul ol dl table blockquote figure details fieldset span p li td".split())
#: Words of class, id and role that tell of furniture, and words beside them that do not take that away.
MARKS = frozenset(
    "ad ads advert advertisement adverts sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "menu nav navbar navigation breadcrumb breadcrumbs sidebar side footer header masthead topbar share sharing social related recommended recommendations "
    "comment comments disqus respond newsletter subscribe subscription signup login search pagination pager widget toolbar contentinfo complementary form".split()
)
BESIDE = frozenset(
    "site page main top bottom left right global primary secondary box bar wrapper wrap container list item items area block section module inner outer link "
    "links button buttons icon icons text post posts user users reader readers article slot unit sticky fixed mobile desktop row col column panel group".split()
)

#: Words of MARKS that name ordinary sections, too: inside the main part the host's suffix array decides about them.
AMBIGUOUS = frozenset("side search related alert form social".split())

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9-]*")
#: Blanks and slashes, and then an attribute: quotes count only after an equals sign; a quote that is never closed belongs to a value without quotes.
_ATTRIBUTE = re.compile(r"[\s/]*(?:([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?)?")


class _Finder:
    """Where a pattern comes next: found once for all places before it, so that a page is searched once in all."""

    def __init__(self, pattern: str, html: str):
        self.pattern, self.html, self.since, self.hit = re.compile(pattern, re.I), html, 1, None

    def after(self, at: int) -> re.Match | None:
        known = self.since <= at and (self.hit is None or at <= self.hit.start())
        if self.since == 1 and self.hit is None or not known:
            self.since, self.hit = max(at, 2), self.pattern.search(self.html, at)
        return self.hit


def _tag(html: str, at: int) -> tuple[int, dict[str, str], bool] | None:
    """End, attributes (the first of a name counts) and self-closing of the tag whose name ends at at; None if it never ends."""
    attributes: dict[str, str] = {}
    while True:
        m = _ATTRIBUTE.match(html, at)
        if m[1] is None:
            end = m.end()
            if end >= len(html):
                return None
            if html[end] == ">":
                return end + 1, attributes, html[at:end].rstrip().endswith("/")
            at = end + 1  # an equals sign without a name
            continue
        value = next((v for v in m.groups()[1:] if v is not None), "")
        attributes.setdefault(m[1].lower(), value)
        at = m.end()


def scanned(html: str) -> list[str | tuple[bool, str, dict[str, str], bool]]:
    """Text and tags (closing, name, attributes, self-closing) in one pass from front to end.

    What has no text (SILENT elements, all to their end or, for scripts and
    styles without one, to the page's end) is one blank, comments are nothing.
    Title, select, textarea and button do not nest, head ends where a block
    begins: not closed before, they, like other SILENT elements that are never
    closed, are empty. A tag that never ends is text, with all that follows.
    """
    out: list = []
    finders: dict[str, _Finder] = {}

    def closing(tag: str) -> re.Match | None:
        if tag not in finders:
            if tag == "head":
                pattern = rf"</head\s*>|<(?:{'|'.join(sorted(BLOCK - {'html'}))})\b"
            else:
                pattern = rf"</{tag}\s*>" + (rf"|<{tag}\b" if tag in _ALONE - {"script", "style"} else "")
            finders[tag] = _Finder(pattern, html)
        return finders[tag].after(at)

    at = 0
    while at < len(html):
        start = html.find("<", at)
        if start < 0:
            out.append(html[at:])
            break
        if start > at:
            out.append(html[at:start])
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = len(html) if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), start):
            end = html.find(">", start)
            if end < 0:
                out.append(html[start:])
                break
            at = end + 1
            continue
        closes = html.startswith("</", start)
        name = _NAME.match(html, start + 1 + closes)
        if name is None:
            out.append("<")
            at = start + 1
            continue
        found = _tag(html, name.end())
        if found is None:
            out.append(html[start:])
            break
        at, attributes, alone = found
        tag = name[0].lower()
        if tag in SILENT:
            out.append(" ")
            if not closes and (not alone or tag in ("script", "style")):
                end = closing(tag)
                if end is not None and end[0].startswith("</"):
                    at = end.end()
                elif tag in ("script", "style"):
                    break
            continue
        out.append((closes, tag, attributes, alone))
    return out


#: Words of a name: between - and _, and from capital to capital.
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _named(names: str, inside: bool = False) -> int:
    """What the names of a class or id tell: FURNITURE if one has a word of MARKS and else only words of BESIDE or numbers, SUSPECT if one has other words, too.

    Inside the main part a name whose words of MARKS are all AMBIGUOUS is SUSPECT.
    """
    found = MAIN
    for name in names.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if not MARKS.isdisjoint(words):
            clear = not inside or not AMBIGUOUS.issuperset(w for w in words if w in MARKS)
            if clear and all(w in MARKS or w in BESIDE or w.isdigit() for w in words):
                return FURNITURE
            found = SUSPECT
    return found


def _marked(tag: str, attributes: dict[str, str], inside: bool) -> int:
    """MAIN, or what the element's own tag says that it is: FURNITURE (so are hidden ones) or SUSPECT; inside: of the main part."""
    if tag in ASIDE:
        return FURNITURE
    if tag == "dialog":
        return SUSPECT if "open" in attributes else FURNITURE
    style = attributes.get("style", "").lower().replace(" ", "")
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in style:
        return FURNITURE
    told = [_named(attributes.get(name, ""), inside) for name in ("class", "id", "role")]
    return FURNITURE if FURNITURE in told else SUSPECT if SUSPECT in told else MAIN


def _is_main(attributes: dict[str, str]) -> bool:
    return attributes.get("role", "").strip().lower() == "main"


def page_blocks(html: str) -> list[tuple[int, str]]:
    """(zone, text) of the page's blocks in order, white space as one blank, character references decoded."""
    parts = scanned(html)
    opened = {p[1] for p in parts if type(p) is tuple and not p[0]}
    marked = [c for c in ("article", "main") if c in opened]
    if any(type(p) is tuple and not p[0] and _is_main(p[2]) for p in parts):
        marked.append("")
    for container in marked:
        found = _zones(parts, container)
        if any(zone in (MAIN, SUSPECT) for zone, _ in found):
            return found
    # marked, but without text
    return _zones(parts, marked[0] if marked else None)


def _zones(parts: list, container: str | None) -> list[tuple[int, str]]:
    """page_blocks() where container is the element of the main part: '' is that of role main, None is none.

    A heading that the element main has before its first article belongs to it.
    """
    out: list[tuple[int, str]] = []
    pieces: list[str] = []
    stack: list[tuple[str, int, int, int]] = []  # (tag, furniture, suspect, main)
    open_tags: Counter[str] = Counter()
    furniture = suspect = main = 0
    heading = False  # of a heading inside the header of the main part
    title = False  # of a heading in main before the article
    before = container == "article"  # no article so far
    zone = PLAIN if container is None else FURNITURE

    def flush() -> None:
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                out.append((zone, text))

    def here() -> int:
        if main and (not furniture or heading):
            return SUSPECT if suspect else MAIN
        if title and (not furniture or (furniture == 1 and stack[-1][0] == "header")):
            return _TITLE
        return FURNITURE if furniture or container is not None else PLAIN

    def leave(k: int) -> None:
        nonlocal furniture, suspect, main
        for tag, f, s, a in stack[k:]:
            furniture, suspect, main = furniture - f, suspect - s, main - a
            open_tags[tag] -= 1
        del stack[k:]

    for part in parts:
        if type(part) is str:
            pieces.append(part)
            continue
        closing, tag, attributes, alone = part
        if tag in BLOCK:
            flush()
        elif tag in ("br", "td", "th"):
            pieces.append(" ")
        changed = False
        if tag in _HEADINGS:
            # a heading in a header of the main part is the article's own
            heading = not closing and bool(stack) and main > 0 and stack[-1][0] == "header" and furniture == 1
            title = not closing and before and open_tags["main"] > 0
            changed = True
        elif tag in NESTED:
            if closing and open_tags[tag]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        leave(k)
                        changed = True
                        break
            elif not closing and not alone:
                if stack and stack[-1][0] == "p" and tag in BLOCK:
                    leave(len(stack) - 1)
                told = _marked(tag, attributes, main > 0)
                a = int(tag == container or (container == "" and _is_main(attributes)))
                before = before and not (a and not furniture and told == MAIN)
                if told != MAIN and tag not in BLOCK:
                    flush()
                open_tags[tag] += 1
                stack.append((tag, int(told == FURNITURE), int(told == SUSPECT and main > 0), a))
                _, f, s, a = stack[-1]
                furniture, suspect, main = furniture + f, suspect + s, main + a
                changed = True
        if changed:
            new = here()
            if new != zone:
                flush()
                zone = new
    flush()
    whole = any(z in (MAIN, SUSPECT) for z, _ in out)
    return [((MAIN if whole else FURNITURE) if z == _TITLE else z, text) for z, text in out]


def _hashes(tokens: list[str]) -> list[int]:
    return [xxhash.xxh32_intdigest(t.encode("utf-8", "surrogatepass")) for t in tokens]


def _windows(tokens: np.ndarray, depth: int, host: str) -> np.ndarray:
    """A 64-bit hash of the host and of the low halves of each depth tokens in a row."""
    tokens = (tokens & 0xFFFF).astype(np.uint64)
    n = max(0, len(tokens) - depth + 1)
    out = np.full(n, xxhash.xxh64_intdigest(host.encode("utf-8", "surrogatepass"), 3), np.uint64)
    for k in range(depth):
        out = out * np.uint64(0x9E3779B97F4A7C15) + tokens[k : k + n]
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _bits(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two of FILTER_BITS bits that stand for a window."""
    mask = np.uint64(FILTER_BITS - 1)
    return (windows & mask).astype(np.int64), ((windows >> np.uint64(32)) & mask).astype(np.int64)


def _possible(texts: DataFrame, depth: int) -> np.ndarray:
    """Bits (packed) of all windows that can be on need of their host's n texts.

    Texts of a host lie side by side in groups of any size. A window on need of
    n texts is on need / n of the texts of one group at least, so only what is
    that frequent in a group can be. Others share its bits or halves of tokens by
    chance, which costs rows of the suffix array and changes nothing in it.
    """

    def halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = [np.frombuffer(x, ">u4").astype(">u2").tobytes() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(low, pa.binary()), *batch.columns[3:]], batch.schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[np.ndarray] = []  # distinct windows of each text
        own: list[np.ndarray] = []  # windows of the last text
        last, bound, size, held = None, (0, 0), 0, 0

        def close() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(group), return_counts=True)
            found = np.unique(np.concatenate(_bits(values[counts * bound[0] >= bound[1] * len(group)])))
            return pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["bit"])

        for batch in batches:
            for host, text, stream, n, need in zip(*(c.to_pylist() for c in batch.columns)):
                if last is not None and (host, text) != last:
                    group.append(np.unique(np.concatenate(own)))
                    size, held, own = size + len(group[-1]), 0, []
                    if host != last[0] or len(group) >= GROUP_TEXTS or size >= GROUP_WINDOWS:
                        yield close()
                        group, size = [], 0
                last, bound = (host, text), (n, need)
                own.append(_windows(np.frombuffer(stream, ">u2"), depth, host))
                held += len(own[-1])
                if held >= GROUP_WINDOWS:
                    own = [np.unique(np.concatenate(own))]
                    held = 0
        if last is not None:
            group.append(np.unique(np.concatenate(own)))
            yield close()

    low = texts.select("__host", "__text", "__stream", "n", "need").mapInArrow(halved, "__host string, __text bigint, __stream binary, n bigint, need bigint")
    ordered = low.repartitionByRange("__host", "__text").sortWithinPartitions("__host", "__text")
    words = ordered.mapInArrow(run, "bit bigint").groupBy(F.shiftright("bit", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit % 32))")).alias("bits")).toPandas()
    filled = np.zeros(FILTER_BITS // 32, "<u4")
    filled[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype("<u4")
    return filled.view(np.uint8)


def _suffixes(texts: DataFrame, depth: int) -> DataFrame:
    """host, start (the first depth tokens as big-endian hashes), text, page, pos and need (null: evidence only) of the suffixes that can be repeated."""
    possible = texts.sparkSession.sparkContext.broadcast(_possible(texts, depth))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = possible.value
        for batch in batches:
            hosts, names, pages, at, starts, needs = [], [], [], [], [], []
            for host, text, page, stream, need, inside, outside, open_ in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = np.frombuffer(stream, ">u4")
                if len(tokens) < depth:
                    continue
                first, second = _bits(_windows(tokens, depth, host))
                both = (filled[first >> 3] >> (first & 7)) & (filled[second >> 3] >> (second & 7)) & 1
                found = np.flatnonzero(both).tolist()
                packed = tokens.tobytes()
                hosts += [host] * len(found)
                names += [text] * len(found)
                pages += [page] * len(found)
                at += found
                starts += [packed[4 * i : 4 * (i + depth)] for i in found]
                needs += [inside if i >= outside else need if open_ else None for i in found]
            arrays = [pa.array(hosts, pa.string()), pa.array(starts, pa.binary()), pa.array(names, pa.int64()), pa.array(pages, pa.int64()), pa.array(at, pa.int32()), pa.array(needs, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["host", "start", "text", "page", "pos", "need"])

    columns = texts.select("__host", "__text", "__page", "__stream", "need", "inside", "__outside", "__open")
    return columns.mapInArrow(run, "host string, start binary, text bigint, page bigint, pos int, need bigint")


def repeated_suffixes(parsed: DataFrame, depth: int, share: float = SHARE) -> DataFrame:
    """page and pos of every suffix whose first depth tokens are on LEAST texts and on share of the host's texts, at least.

    parsed: __host, __page (a name), __stream (tokens) and, where wanted, __text
    (pages of equal text are one text; else __page), __outside (tokens from there
    on are those of the main part: INSIDE_LEAST and INSIDE_SHARE hold for them)
    and __open (false: the tokens before are evidence only). A host of fewer
    than LEAST texts has no such suffix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        previous, last_text, several, held = None, None, 0, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            found = []
            for key, text, page, pos, need in zip(keys, *(batch.column(k).to_pylist() for k in (2, 3, 4, 5))):
                if key != previous:
                    previous, last_text, several, held = key, text, 1, {}
                elif text != last_text:  # sorted by text
                    last_text, several = text, several + 1
                if need is not None:
                    held.setdefault(need, []).append((page, pos))
                for least in [x for x in held if several >= x]:
                    found += held.pop(least)
            page, pos = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(page, pa.int64()), pa.array(pos, pa.int32())], ["page", "pos"])

    for name, default in (("__text", F.col("__page")), ("__outside", F.lit(1 << 30)), ("__open", F.lit(True))):
        if name not in parsed.columns:
            parsed = parsed.withColumn(name, default)
    texts = parsed.where(F.length("__stream") > 0)
    hosts = texts.select("__host", "__text").distinct().groupBy("__host").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)
    needs = {"need": (LEAST, share), "inside": (INSIDE_LEAST, max(share, INSIDE_SHARE))}
    hosts = hosts.withColumns({name: F.greatest(F.lit(least), F.ceil(F.lit(part) * F.col("n"))) for name, (least, part) in needs.items()})
    # the sorted suffixes: ties of host and start are never parted by a range partition
    ordered = _suffixes(texts.join(F.broadcast(hosts), "__host"), depth).repartitionByRange("host", "start").sortWithinPartitions("host", "start", "text", "page", "pos")
    return ordered.mapInArrow(run, "page bigint, pos int")


def unique_runs(words: list[str], covered: np.ndarray, depth: int) -> list[str]:
    """The words of a block without its covered runs; a run shorter than depth that is not the whole block only reaches in from a neighbour and stays."""
    edges = np.flatnonzero(np.diff(covered, prepend=-1, append=-1))
    out: list[str] = []
    for a, b in zip(edges, edges[1:]):
        if not covered[a] or (b - a < depth and b - a < len(words)):
            out += words[a:b]
    return out


def kept_blocks(found: list[tuple[int, str]], starts: list[int] | None, depth: int) -> list[str]:
    """The texts of a page's blocks (page_blocks()) that stay; starts: places of repeated suffixes in the stream of its blocks, outside first, then main.

    Furniture goes. Other blocks outside lose their repeated runs. A main block
    goes if all of its words are repeated, but a page of which more than half of
    the main words would go is a copy and loses none.
    """
    if not starts:
        return [text for zone, text in found if zone != FURNITURE]
    lengths = [text.count(" ") + 1 for _, text in found]
    outside = sum(n for n, (zone, _) in zip(lengths, found) if zone != MAIN)
    hit = np.zeros(sum(lengths) + depth, np.int64)
    for start in starts:
        hit[start : start + depth if start >= outside else min(start + depth, outside)] = 1
    at = {False: 0, True: outside}
    own = []
    for n, (zone, _) in zip(lengths, found):
        own.append(hit[at[zone == MAIN] : at[zone == MAIN] + n])
        at[zone == MAIN] += n
    gone = [zone == MAIN and bool(o.all()) for o, (zone, _) in zip(own, found)]
    if 2 * sum(n for n, g in zip(lengths, gone) if g) > sum(lengths) - outside:
        gone = [False] * len(found)
    out = []
    for o, g, (zone, text) in zip(own, gone, found):
        if zone == MAIN and not g:
            out.append(text)
        elif zone in (PLAIN, SUSPECT):
            out.append(" ".join(unique_runs(text.split(" "), o, depth)))
    return list(filter(None, out))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", depth: int = 8) -> DataFrame:
    """id_col, url_col, text (blocks joined by a line end, empty if none) and n_chars of every row.

    All blocks of all pages go through their host's suffix array; kept_blocks()
    says what follows. Null or empty html: empty text. Null url: pages without
    host. Broken markup: what is open at the end is closed there. Rows of a host
    with equal text apart from furniture count as one page, so a copy is no
    evidence of boilerplate, whatever its scripts and adverts; a row each in the
    result. Other columns are not used. No rows: no rows. Pages are parsed twice,
    which takes less than their blocks take on disk.
    """
    source = pages.select(id_col, url_col, html_col)
    kinds = {c: source.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, 2):
            names, tokens, outsides, open_ = [], [], [], []
            for host, html in zip(batch.column(0).to_pylist(), texts):
                found = page_blocks(html)
                outside = [h for z, t in found if z != MAIN for h in _hashes(t.split(" "))]
                inside = [h for z, t in found if z == MAIN for h in _hashes(t.split(" "))]
                own = "\n".join([host, *(t for z, t in found if z != FURNITURE)])
                names.append(xxhash.xxh64_intdigest(own.encode("utf-8", "surrogatepass")) - (1 << 63))
                tokens.append(np.array(outside + inside, ">u4").tobytes())
                outsides.append(len(outside))
                open_.append(any(z in (PLAIN, SUSPECT) for z, _ in found))
            arrays = [batch.column(0), batch.column(1), pa.array(names, pa.int64()), pa.array(tokens, pa.binary()), pa.array(outsides, pa.int32()), pa.array(open_, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, ["__host", "__page", "__text", "__stream", "__outside", "__open"])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, 2):
            out = ["\n".join(kept_blocks(page_blocks(html), starts, depth)) for html, starts in zip(texts, batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], [id_col, url_col, "text"])

    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col).cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1), F.lit("")))
    named = source.select("*", host.alias("__host"), F.xxhash64(host, html_col).alias("__page"))
    schema = "__host string, __page bigint, __text bigint, __stream binary, __outside int, __open boolean"
    parsed = materialise(named.select("__host", "__page", html_col).mapInArrow(streams, schema), "streams")
    covered = materialise(repeated_suffixes(parsed, depth).groupBy("page").agg(F.collect_set("pos").alias("__covered")), "covered")
    joined = named.join(covered, F.col("__page") == F.col("page"), "left").select(id_col, url_col, html_col, "__covered")
    texts = joined.mapInArrow(extract, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string")
    return texts.select(id_col, url_col, "text", F.length("text").cast("long").alias("n_chars"))
