"""Main text of web pages by nearest-URL page differencing and page structure.

A page is read into its blocks of text. Structure takes out what is never text: scripts, styles,
forms, navigation, side bars, footers, adverts, notices and reader comments, by element, role or class
word.
What is left is settled by differencing: the pages of a host lie in the order of their URL paths,
each takes the neighbour whose path shares the longer beginning with its own, the two pages' lines are
aligned by a longest common subsequence, and shared lines are deleted. Of the page's ``article`` (or else
``main``) part only template lines go: a headline or paragraph that two articles happen to have in common
is text of both, so a shared line of that part is deleted only if lines in its container (the chain of
elements and classes around it) are shared with the nearest page more often than not, on at least
``LEAST_PAGES`` pages of the host. Where the neighbour shares more than half of the part's characters the
two hold copies of one article; such pages keep the part and say nothing about containers.

Neighbours are exact and no host is gathered in one task: small rows (path, line hashes) are range
partitioned by (host, path), neighbours come from a window inside each range, and the first and last
rows of the ranges, one pair per partition, join the ranges together.

Defined results: null html gives an empty text; a null url belongs to the empty host; a host's only
page is settled by structure (its article or else main part, or else all lines); equal URLs are ordered by page_id; repeated rows are pages of their own (and
each other's nearest neighbour); other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swellcast.llm import common

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PART = re.compile(r"[A-Za-z]+[0-9]*")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas video audio".split())
GONE = frozenset("head nav footer aside form button select menu dialog fieldset datalist".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSED_BY_BLOCK = frozenset(("p",))
#: Pages of a host on which a container must occur to count as template.
LEAST_PAGES = 8
#: Class, id or role words of parts that are not the article.
GONE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo promotion cookie cookies consent notice notices alert "
    "sidebar aside nav navbar navigation menu breadcrumb breadcrumbs footer contentinfo complementary search comment comments "
    "disqus reply replies share sharing social related newsletter subscribe signup popup modal dialog pagination pager toolbar".split())


def _denied(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in GONE or tag == "header" and not in_article:
        return True
    if not attributes:
        return False
    for _, value in _ATTRIBUTE.findall(attributes):
        words = {w.lower() for w in _PART.findall(value)}
        if words & GONE_WORDS or not in_article and words & {"header", "masthead"}:
            return True
    return False


def _box(outer: int, tag: str, attributes: str) -> int:
    """Number of a container: its element and classes, inside the container ``outer``."""
    classes = sorted({w for name, value in _ATTRIBUTE.findall(attributes) if name.lower() == "class" for w in value.strip("\"'").split()})
    return xxhash.xxh64_intdigest(f"{outer}/{tag}.{'.'.join(classes)}")


def blocks(page: str) -> list[tuple[str, int, int]]:
    """(text, place, container) of the page's blocks that structure does not drop; place 2: article, 1: main, 0: elsewhere."""
    out: list[tuple[str, int, int]] = []
    stack: list[tuple[str, bool, int, int]] = []
    gone, place, box, parts, at = 0, 0, 0, [], 0

    def text(raw: str) -> None:
        if raw and not gone:
            parts.append(html.unescape(raw))

    def flush() -> None:
        if parts:
            own = " ".join("".join(parts).split())
            parts.clear()
            if own:
                out.append((own, place, box))

    def pop() -> None:
        nonlocal gone, place, box
        _, was_gone, place, box = stack.pop()
        gone -= was_gone

    while True:
        match = _TOKEN.search(page, at)
        if match is None:
            text(page[at:])
            break
        text(page[at : match.start()])
        at = match.end()
        tag = (match[2] or "").lower()
        if not tag:
            if match[0].startswith("<![CDATA[") and not gone:
                parts.append(match[0][9:].removesuffix("]]>"))
            continue
        if match[1]:
            if tag not in INLINE:
                flush()
            if any(t == tag for t, *_ in stack):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in RAW and not match[3].endswith("/"):
            if tag not in INLINE:
                flush()
            close = re.compile(f"</{re.escape(tag)}\\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if tag in INLINE and not match[3]:
            continue
        if tag not in INLINE:
            flush()
            while stack and stack[-1][0] in CLOSED_BY_BLOCK:
                pop()
            if tag == "li":
                # An item closes the open one of its list.
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] in ("ul", "ol"):
                        break
                    if stack[depth][0] == "li":
                        while len(stack) > depth:
                            pop()
                        break
        if tag in VOID or match[3].endswith("/"):
            continue
        drop = _denied(tag, match[3], place == 2)
        if drop or tag not in INLINE:
            if drop and tag in INLINE and not gone:
                text(" ")
            stack.append((tag, drop, place, box))
            gone += drop
            if not gone and tag not in INLINE:
                box = _box(box, tag, match[3])
            if tag == "article" and not gone:
                place = 2
            elif place == 0 and not gone and (tag == "main" or 'role="main"' in match[3].lower()):
                place = 1
    flush()
    return out


def settled(found: list[tuple[str, int, int]]) -> tuple[list[str], bool]:
    """The lines that structure alone would take, and whether they are an article or main part."""
    best = max((p for _, p, _ in found), default=0)
    return [t for t, p, _ in found if p == best], best > 0


def shared_lines(own: list[int], other: list[int]) -> list[int]:
    """Indexes of ``own`` in a longest common subsequence with ``other`` (bit rows over ``other``, read backwards)."""
    masks: dict[int, int] = {}
    for j, line in enumerate(other):
        masks[line] = masks.get(line, 0) | 1 << j
    full, row, rows = (1 << len(other)) - 1, (1 << len(other)) - 1, []
    for line in own:
        up = row & masks.get(line, 0)
        row = ((row + up) | (row - up)) & full
        rows.append(row)
    # A zero bit j in row i: the length grows at j. Walk back from the end.
    out, j = [], len(other) - 1
    for i in range(len(own) - 1, -1, -1):
        while j >= 0 and rows[i] >> j & 1:
            j -= 1
        if j < 0:
            break
        before = rows[i - 1] if i else full
        if before >> j & 1:
            out.append(i)
            j -= 1
    return out[::-1]


def guards(found: list[tuple[str, int, int]]) -> list[int]:
    """Per line its length in the page's article (or else main) part, 0 outside of it."""
    best = max((p for _, p, _ in found), default=0)
    return [len(t) if p == best > 0 else 0 for t, p, _ in found]


def judged_lines(own: list[int], guard: list[int], boxes: list[int], other: list[int] | None) -> tuple[
        list[int], list[tuple[int, int]], list[tuple[int, int, int]]]:
    """What differencing with the nearest page (None: there is none) says: lines to delete; shared lines of the
    article, with their container; and per container of the article its lines and those shared."""
    if other is None:
        return ([i for i, g in enumerate(guard) if not g] if any(guard) else []), [], []
    shared = shared_lines(own, other)
    gone = [i for i in shared if not guard[i]]
    if 2 * sum(guard[i] for i in shared) > sum(guard):
        return gone, [], []
    count: dict[int, list[int]] = {}
    for g, box in zip(guard, boxes, strict=True):
        if g:
            count.setdefault(box, [0, 0])[0] += 1
    inside = [(i, boxes[i]) for i in shared if guard[i]]
    for _, box in inside:
        count[box][1] += 1
    return gone, inside, [(box, n, k) for box, (n, k) in count.items()]


def _parsed(pages: DataFrame) -> DataFrame:
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), common.whole_text("html").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = pa.Codec("zstd", compression_level=19)
        for batch, texts in common.slices(batches):
            hosts, paths, lines, sizes, hashes, guard, boxes = [], [], [], [], [], [], []
            for url, text in zip(batch.column("url").to_pylist(), texts, strict=True):
                try:
                    parts = urlsplit(url or "")
                    host, path = (parts.netloc.rpartition("@")[2].lower(), parts.path)
                except ValueError:
                    host, path = "", url
                found = blocks(text)
                hosts.append(host)
                paths.append(path)
                raw = "\n".join(t for t, *_ in found).encode()
                lines.append(pack.compress(raw, asbytes=True))
                sizes.append(len(raw))
                hashes.append([xxhash.xxh64_intdigest(t) - (1 << 63) for t, *_ in found])
                guard.append(guards(found))
                boxes.append([b - (1 << 63) for *_, b in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(hosts, pa.string()), pa.array(paths, pa.string()),
                 pa.array(lines, pa.binary()), pa.array(sizes, pa.int64()), pa.array(hashes, pa.list_(pa.int64())), pa.array(guard, pa.list_(pa.int32())),
                 pa.array(boxes, pa.list_(pa.int64()))],
                ["page_id", "url", "host", "path", "lines", "raw", "hashes", "guard", "boxes"])

    parsed = own.mapInArrow(run, "page_id long, url string, host string, path string, lines binary, raw long, "
                            "hashes array<long>, guard array<int>, boxes array<long>")
    return common.stored(parsed.withColumn("tag", F.monotonically_increasing_id()), "pages")


def _neighbours(parsed: DataFrame) -> DataFrame:
    """(tag, host, path, hashes, guard, boxes, previous, next): the lines of each page and of the pages beside it."""
    order = ["host", "path", "page_id", "tag"]
    count = common.partitions_for(parsed.sparkSession)
    rows = common.stored(
        parsed.select(*order, "hashes", "guard", "boxes").repartitionByRange(count, *order).sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id()), "page-order")
    card = F.struct("host", "path", "hashes")
    place = F.struct(*order)
    ends = rows.groupBy("part").agg(F.min_by(card, place).alias("first"), F.max_by(card, place).alias("last"))
    by_part = Window.orderBy("part")  # one row per partition
    ends = ends.select("part", F.lag("last").over(by_part).alias("before"), F.lead("first").over(by_part).alias("after"))
    inside = Window.partitionBy("part").orderBy(*order)
    near = rows.select("part", "tag", "host", "path", "hashes", "guard", "boxes", F.lag(card).over(inside).alias("lag"),
                       F.lead(card).over(inside).alias("lead")).join(ends, "part", "left")
    side = lambda a, b: F.when(F.coalesce(a, b)["host"] == F.col("host"), F.coalesce(a, b))
    return near.select("tag", "host", "path", "hashes", "guard", "boxes", side(F.col("lag"), F.col("before")).alias("previous"),
                       side(F.col("lead"), F.col("after")).alias("next"))


def _deleted(near: DataFrame) -> DataFrame:
    """(tag, gone array<int>): the line indexes that differencing deletes."""

    def common_start(a: str, b: str) -> int:
        return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = []
            for row in batch.to_pylist():
                sides = [s for s in (row["previous"], row["next"]) if s is not None]
                other = max(sides, key=lambda s: common_start(s["path"] or "", row["path"] or ""), default=None)
                said.append(judged_lines(row["hashes"], row["guard"], row["boxes"], other["hashes"] if other else None))
            yield pa.RecordBatch.from_arrays(
                [batch.column("tag"), batch.column("host"), pa.array([gone for gone, *_ in said], pa.list_(pa.int32())),
                 pa.array([[{"line": i, "box": b} for i, b in inside] for _, inside, _ in said], _INSIDE),
                 pa.array([[{"box": b, "n": n, "shared": k} for b, n, k in count] for *_, count in said], _COUNT)],
                ["tag", "host", "gone", "inside", "count"])

    said = common.stored(near.mapInArrow(
        run, "tag long, host string, gone array<int>, inside array<struct<line: int, box: long>>, "
        "count array<struct<box: long, n: int, shared: int>>"), "page-lines")
    # Sums per container of a host: as many rows as hosts have templates, whatever their pages.
    template = said.select("host", F.inline("count")).groupBy("host", "box").agg(
        F.count("*").alias("pages"), F.sum("n").alias("n"), F.sum("shared").alias("shared")).where(
            (F.col("pages") >= LEAST_PAGES) & (2 * F.col("shared") > F.col("n"))).select("host", "box")
    more = (said.select("tag", "host", F.inline("inside")).join(template, ["host", "box"])
            .groupBy("tag").agg(F.collect_list("line").alias("more")))
    return said.join(more, "tag", "left").select("tag", F.concat("gone", F.coalesce("more", F.array().cast("array<int>"))).alias("gone"))


_INSIDE = pa.list_(pa.struct([("line", pa.int32()), ("box", pa.int64())]))
_COUNT = pa.list_(pa.struct([("box", pa.int64()), ("n", pa.int32()), ("shared", pa.int32())]))


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars. The lines travel compressed, since they are joined to their deletions."""
    parsed = _parsed(pages)
    rest = parsed.select("tag", "page_id", "url", "lines", "raw").join(_deleted(_neighbours(parsed)), "tag")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for lines, raw, gone in zip(batch.column("lines"), batch.column("raw").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                found, gone = pa.decompress(lines.as_buffer(), raw, "zstd", asbytes=True).decode().split("\n"), set(gone)
                texts.append(" ".join(t for i, t in enumerate(found) if i not in gone))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return rest.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_page_text(spark, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
