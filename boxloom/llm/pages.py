"""Main text of web pages with a site style tree.

Pages are parsed to blocks of text, each under a path of elements (tag, id, classes). The
pages of a host are merged into one tree: a branch holds, over all its host's pages, how the
content features (block texts, on a page or not) below it are spread, and in which
presentations (sequences of blocks below it) it appears. A feature's importance is one less its entropy over the branch's
pages, so that what every page repeats has none; a branch's content importance is the mean
over all that stands below it, and its presentation importance the entropy of its presentations,
both scaled by the logarithm of its pages. The two are combined with a damping factor, and a
branch below a threshold is removed from every page with all it holds; branches around an
article or main element stay. On every page the tree judges all blocks.

The markup's own declarations are the tree's prior: menus, headers, footers, asides, forms,
scripts, and branches whose class, id or role is a word for an advert, comment section and
the like have no importance, but no article or main element for the name of a branch around
it; where a page has an article or main element, only what is in it can be main text.

An entropy over one or two pages tells nothing: on hosts with fewer than SUPPORT different
pages the prior alone decides. Pages of a host with the same blocks count once in the tree,
as copies of a page don't show what the site repeats.

Character references are decoded, white space in a block becomes one blank, blocks are
joined by a line feed in page order. Null and empty pages have the empty text. Very long
pages are parsed whole. Rows that repeat a page are extracted each; null urls form one host.
Empty tables give no rows; columns of other names aren't read and can't clash. Hosts are
never gathered in one task: features are counted by (host, branch, feature).
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxloom.llm.common import Scratch, sliced, small_enough

#: Branches of a lower importance are removed.
LEAST = 0.2
#: Weight of the content against the presentation.
DAMPING = 0.9
#: Different pages of a host that must hold a branch before the tree may remove it.
SUPPORT = 3
#: Copies of pages, and low branches, up to this number are broadcast (8 bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000

#: Elements that never hold main text.
NOISE = set("nav header footer aside form button select option menu dialog fieldset label input".split())
#: Elements whose content isn't text of the page.
RAW = set("script style noscript template iframe svg textarea title object canvas math".split())
#: Words in a class, id or role that name a branch without main text.
NAMES = set(
    "ad ads advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments complementary "
    "consent contentinfo cookie cookies disqus footer login masthead menu modal nav navbar navigation newsletter notice overlay "
    "pager pagination popup promo promotion recommendations recommended related replies reply search share sharing sidebar social "
    "sponsor sponsored sponsors subscribe subscription toolbar widget "
    "ad-banner ad-container ad-slot ad-wrapper comment-form comment-list comments-area comments-section cookie-banner cookie-bar "
    "cookie-consent cookie-notice left-sidebar main-menu main-nav newsletter-signup page-footer page-header post-comments "
    "reader-comments related-articles related-posts right-sidebar search-form share-buttons side-bar sidebar-left sidebar-right "
    "site-footer site-header site-menu site-nav skip-link social-links social-share sponsored-content top-bar top-nav user-comments".split()
)
#: Of these words, those that also name parts of an article; inside one, the tree judges them.
DOUBTFUL = set("banner login menu notice overlay search toolbar".split())
#: Elements whose names say what an article is about, not what part of the page they are.
TOPICS = set("h1 h2 h3 h4 h5 h6 p pre blockquote li dl dt dd table tr td th figure figcaption a b i em strong code span".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body center dd details div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSED_BY = {"p": BLOCKS - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}
#: A comment, a tag with its name and what stands behind it (a ">" in a quoted value doesn't end it), or a declaration.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>=]|=\s*"[^"]*"|=\s*'[^']*'|=)*))(?:>|$)|<[!?/][^>]*(?:>|$)""", re.S
)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


def named_noise(tag: str, attributes: list[tuple[str, str]], inside: bool) -> bool:
    """Whether class, id or role, as whole words, name a branch without main text; inside: of an article or main element."""
    if tag in ("html", "body", "article", "main") or inside and tag in TOPICS:
        return False
    if inside and tag == "section":
        attributes = [a for a in attributes if a[0] != "id"]
    words = " ".join(v for _, v in attributes).lower().split()
    return any(w in NAMES and not (inside and w in DOUBTFUL) for w in words)


def parse(page: str) -> tuple[bool, list[tuple[str, str, bool, bool]]]:
    """(has a main element, blocks): each block is (path, text, in main, declared noise)."""
    out, text, stack = [], [], []  # stack: tag, step of the path, noise, main, noise by element
    has_main, at = False, 0

    def flush():
        joined = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if joined:
            out.append((">".join(s[1] for s in stack), joined, bool(stack) and stack[-1][3], bool(stack) and stack[-1][2]))

    def pop(n):
        del stack[n:]

    pos, open_ended = 0, set()
    while token := _TOKEN.search(page, pos):
        pos = token.end()
        if token.start() > at:
            text.append(page[at : token.start()])
        at = pos
        tag = (token[2] or "").lower()
        if not tag:
            continue
        closed = token[3].endswith("/")
        if tag in RAW and not token[1]:
            # its content goes with it; without an end, a script goes to the end of the page, any other only as a tag
            end = None if closed or tag in open_ended else re.compile(rf"</{tag}\s*>", re.I).search(page, pos)
            if end:
                pos = at = end.end()
            elif not closed and tag in ("script", "style"):
                pos = at = len(page)
            else:
                open_ended.add(tag)
            continue
        if token[1]:
            if tag in BLOCKS:
                flush()
            for n in range(len(stack) - 1, -1, -1):
                if stack[n][0] == tag:
                    pop(n)
                    break
                if stack[n][0] in ("article", "main", "body") and tag not in ("body", "html", "article", "main"):
                    break
            continue
        if tag in BLOCKS:
            flush()
        elif tag == "br":
            text.append(" ")
        if tag in VOID:
            continue
        if tag in BLOCKS:
            for n in range(len(stack) - 1, -1, -1):
                if tag in CLOSED_BY.get(stack[n][0], ()):
                    pop(n)
                    break
                if stack[n][0] in BLOCKS:
                    break
        if closed:
            continue
        attributes = [(k.lower(), a or b or c) for k, a, b, c in _NAMED.findall(token[3])] if token[3].strip() else []
        named = " ".join(v for _, v in attributes)
        above = stack[-1] if stack else ("", "", False, False, False)
        main = above[3] or tag in ("article", "main")
        element = above[4] or (tag in NOISE and not (tag == "header" and above[3]))
        # what names say of a branch doesn't hold for the article or main element in it
        noise = element or (above[2] and (above[3] or not main)) or named_noise(tag, attributes, above[3])
        has_main |= main and not noise
        stack.append((tag, tag + ("." + ".".join(sorted(named.lower().replace(">", "").split())) if named else ""), noise, main, element))
    text.append(page[at:])
    flush()
    return has_main, out


def _code(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


_CODES = "host string, sum long, pairs array<struct<branch: bigint, feature: int>>, styles array<struct<branch: bigint, style: int, around: boolean>>"
_TEXT = "page_id long, url string, text string, n_declared long, n_removed long"


class Tree:
    """A page's blocks, which of them the markup declares to be no main text, and the branches around each."""

    def __init__(self, host: str, page: str):
        self.main, found = parse(page)
        self.blocks = [text for _, text, _, _ in found]
        self.declared = [noise or self.main and not inside for _, _, inside, noise in found]
        self.chains, self.around = [], set()
        self.held: dict[int, tuple[list[str], set[int]]] = {}  # branch -> the paths below it, its features
        codes: dict[str, list[int]] = {}
        for path, text, _, _ in found:
            if path not in codes:
                steps = path.split(">") if path else []
                tags = [s.partition(".")[0] for s in steps]
                inner = max((i for i, t in enumerate(tags) if t in ("article", "main")), default=-1)
                own = [(i, _code(f"{host} {'>'.join(steps[: i + 1])}")) for i, t in enumerate(tags) if t not in ("html", "body")]
                self.around.update(b for i, b in own if i <= inner)
                codes[path] = [b for _, b in own]
            self.chains.append(codes[path])
            feature = zlib.crc32(text.encode()) - (1 << 31)
            for b in codes[path]:
                styles, features = self.held.setdefault(b, ([], set()))
                styles.append(path)
                features.add(feature)
        self.sum = _code(repr([(p, t) for p, t, _, _ in found]))

    def text(self, low: set[int]) -> tuple[str, int, int]:
        """Main text, blocks the markup rules out, and further ones in low branches; a main element keeps half of its text at least, else all."""
        left = [i for i, gone in enumerate(self.declared) if not gone]
        kept = [i for i in left if low.isdisjoint(self.chains[i])] if low else left
        size = lambda rows: sum(len(self.blocks[i]) for i in rows)
        if self.main and 2 * size(kept) < size(left):
            kept = left
        return "\n".join(self.blocks[i] for i in kept), len(self.blocks) - len(left), len(left) - len(kept)


def _coded(batches):
    pair = pa.list_(pa.struct([("branch", pa.int64()), ("feature", pa.int32())]))
    style = pa.list_(pa.struct([("branch", pa.int64()), ("style", pa.int32()), ("around", pa.bool_())]))
    for batch in batches:
        sums, pairs, styles = [], [], []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            tree = Tree(host, page or "")
            sums.append(tree.sum)
            pairs.append([{"branch": b, "feature": f} for b, (_, features) in tree.held.items() for f in sorted(features)])
            styles.append([{"branch": b, "style": zlib.crc32("|".join(s).encode()) - (1 << 31), "around": b in tree.around} for b, (s, _) in tree.held.items()])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.int64()), pa.array(pairs, pair), pa.array(styles, style)], ["host", "sum", "pairs", "styles"])


def _extracted(batches):
    for batch in batches:
        rows = [Tree(host, page or "").text(set(low or ())) for host, page, low in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))]
        cols = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 3, (pa.string(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["page_id", "url", "text", "n_declared", "n_removed"])


def importance(pages: DataFrame) -> DataFrame:
    """(branch, host, pages, around, importance) from pages (host, pairs, styles); a branch's code holds its host."""
    each = pages.select("host", F.explode("styles").alias("s")).select("host", "s.*")
    styles = each.groupBy("branch", "style").agg(F.count(F.lit(1)).alias("n"), F.max("around").alias("around"), F.min("host").alias("host"))
    held = styles.groupBy("branch").agg(F.sum("n").alias("pages"), F.max("around").alias("around"), F.min("host").alias("host"), F.sum(F.col("n") * F.log("n")).alias("part"))
    pairs = pages.select(F.explode("pairs").alias("p")).select("p.*")
    # a feature stands on a page or not: its entropy over the pages that have it is the logarithm of their number
    spread = pairs.groupBy("branch", "feature").agg(F.count(F.lit(1)).alias("n"))
    content = spread.groupBy("branch").agg((F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("bits"))
    base = F.log(F.greatest("pages", F.lit(2)))
    node = F.when(F.col("pages") > 1, F.least((F.log("pages") - F.col("part") / F.col("pages")) / base, F.lit(1.0))).otherwise(1.0)
    leaf = F.when(F.col("pages") > 1, 1 - F.least(F.col("bits") / base, F.lit(1.0))).otherwise(1.0)
    return held.join(content, "branch").select("branch", "host", "pages", "around", ((1 - DAMPING) * node + DAMPING * leaf).alias("importance"))


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: float = LEAST, support: int = SUPPORT) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars, n_declared (blocks the markup rules out), n_removed (further blocks in branches the tree removes).

    Pages are parsed twice, for the tree and for their text, so that only codes are stored in between.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("html"))
    scratch = Scratch(pages.sparkSession, "pages")
    coded = rows.select("host", "html").mapInArrow(sliced(_coded, 500), _CODES).withColumn("key", F.monotonically_increasing_id())
    coded = scratch.keep(coded, "coded")
    again = coded.select("host", "sum", "key").withColumn("first", F.min("key").over(Window.partitionBy("host", "sum"))).where("key > first").select("key")
    again = scratch.keep(again, "again")
    once = coded.join(F.broadcast(again) if small_enough(again, BROADCAST_ROWS) else again, "key", "left_anti")
    low = importance(once).where((F.col("importance") < least) & (F.col("pages") >= support) & ~F.col("around"))
    low = scratch.keep(low.groupBy("host").agg(F.collect_list("branch").alias("low"), F.count(F.lit(1)).alias("n")), "low")
    total = low.agg(F.sum("n")).first()[0] or 0
    scratch.drop("coded", "again")
    low = low.select("host", "low")
    both = rows.join(F.broadcast(low) if total <= BROADCAST_ROWS else low, "host", "left").select("page_id", "url", "host", "html", "low")
    out = both.mapInArrow(sliced(_extracted, 500), _TEXT)
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_declared", "n_removed")
