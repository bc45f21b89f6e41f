"""Main text of web pages, with a host suffix array for repeated boilerplate.

Pages are cut into blocks. The markup settles most of them: what stands in an article is
main text, what stands in menus, footers, adverts and the like is not. The token streams of
all blocks outside an article are put together per host, and a suffix array over them finds
substrings that distinct pages share. Blocks that the markup leaves open are dropped where
such substrings cover them, and their unique runs are kept.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm.common import map_columns, signed, stored

LEAST = 8  # tokens of a repeated substring
COVERED = 0.5  # share of a block's tokens that makes it boilerplate
SHARD = 2000  # pages of a host in one suffix array, about

# Elements that start a block, elements without main text, and class or id words.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead title tr ul".split()
)
DROPPED = frozenset("nav header footer aside form menu dialog head title button select iframe object svg canvas template noscript".split())
RAW = "script|style|textarea|noscript|template|iframe|xmp|noembed"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|banner|sponsored|promo|promotion|cookies?|consent|gdpr|notice|popup|modal|newsletter|"
    r"subscribe|nav|navbar|navigation|menu|breadcrumbs?|sidebar|footer|header|masthead|social|share|sharing|related|recommended|"
    r"comments?|commentlist|respond|replies|disqus|login|signup|search|pagination|pager|widget|skip|toolbar)(?:$|[\s_-])",
    re.I,
)

_TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


def attributes(inside: str) -> dict[str, str]:
    """Attributes of a tag by lower-case name; the first of equal names counts."""
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(inside):
        found.setdefault(name.lower(), double or single or bare)
    return found


def hidden(found: dict[str, str]) -> bool:
    """Whether the attributes ``hidden`` (but not until found), ``aria-hidden`` or ``style`` hide an element."""
    if "hidden" in found and found["hidden"].strip().lower() != "until-found":
        return True
    shown = "".join(found.get("style", "").lower().split())
    return found.get("aria-hidden", "").strip().lower() == "true" or "display:none" in shown


def blocks(page: str | None) -> list[tuple[str, int]]:
    """Blocks of a page in order: (text, 1 in an article, 0 open, -1 not main text)."""
    page = page or ""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = []  # open elements, and what they say
    words: list[str] = []

    def state() -> int:
        said = [s for _, s in stack]
        if -1 in said and 1 in said:  # the inner one decides, but an article's own notices go
            return -1 if len(said) - said[::-1].index(-1) > said.index(1) else 1
        return -1 if -1 in said else 1 if 1 in said else 0

    def close() -> None:
        text = " ".join(html.unescape("".join(words)).split())
        words.clear()
        if text:
            out.append((text, state()))

    at = 0
    for m in _TAG.finditer(page):
        words.append(page[at : m.start()])
        at = m.end()
        if m[1] or not m[3]:
            continue
        name = m[3].lower()
        if name in VOID:
            if name == "br":
                words.append(" ")
            elif name == "hr":
                close()
            continue
        if name in BLOCKS or name in DROPPED:
            close()
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if m[4].rstrip().endswith("/") and name not in BLOCKS:
            continue
        if name in ("p", "li", "dt", "dd", "option", "tr", "td", "th"):  # these close an open one of their kind
            if stack and stack[-1][0] == name:
                stack.pop()
            elif name == "p" and any(s[0] == "p" for s in stack):
                k = max(i for i, s in enumerate(stack) if s[0] == "p")
                if not any(s[0] in BLOCKS for s in stack[k + 1 :]):
                    del stack[k:]
        said = 0
        found = attributes(m[4])
        named = " ".join(found[a] for a in ("class", "id", "role") if a in found)
        if name in DROPPED and not (name == "header" and any(s == 1 for _, s in stack)):
            said = -1
        elif name in ("article", "main") or re.search(r"(?:^|\s)main(?:$|\s)", named):
            said = 1
        if name not in ("html", "body") and (NAMES.search(named) or hidden(found)):
            said = -1
        if name in BLOCKS or name in DROPPED or said:
            stack.append((name, said))
    words.append(page[at:])
    close()
    return out


def repeated(streams: list[list[int]], least: int = LEAST) -> list[np.ndarray]:
    """For every stream, which positions start a substring of ``least`` tokens, as its rank.

    A suffix array of the streams put together, sorted by the first ``least`` tokens with
    prefix doubling; suffixes that are equal so far share a rank. Suffixes too short have -1.
    """
    lengths = [len(s) for s in streams]
    tokens = np.concatenate([np.array(s, dtype=np.int64) for s in streams]) if streams else np.zeros(0, np.int64)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < least:
        step = min(width, least - width)
        shifted = np.full(len(rank), -1, dtype=np.int64)
        shifted[: len(rank) - step] = rank[step:]
        rank = np.unique(rank * (len(rank) + 2) + shifted + 1, return_inverse=True)[1].astype(np.int64)
        width += step
    out, at = [], 0
    for n in lengths:
        own = rank[at : at + n].copy()
        own[max(0, n - least + 1) :] = -1
        out.append(own)
        at += n
    return out


def _hash(token: str) -> int:
    return signed(xxhash.xxh3_64_intdigest(token))


def extract(
    pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html",
    least: int = LEAST, covered: float = COVERED,
) -> DataFrame:
    """Id, url and ``text`` of every page: the kept blocks in order, joined by line feeds.

    A null page is empty, and an empty page has an empty text. Rows with equal ids stay
    apart. A page whose url has no host belongs to the host of no name.
    """

    def build():
        def step(ids, urls, pages_):
            found = [blocks(p) for p in pages_]
            return ids, urls, [[b[0] for b in f] for f in found], [[b[1] for b in f] for f in found]

        return step

    kinds = dict(pages.dtypes)
    schema = f"id {kinds[id_column]}, url {kinds[url_column]}, texts array<string>, said array<int>"
    parsed = stored(
        map_columns(pages, [id_column, url_column, html_column], build, schema).withColumn("row", F.monotonically_increasing_id())
    )
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))
    outside = (
        parsed.where(F.exists("said", lambda s: s <= 0))
        .withColumn("host", host)
        .withColumn("open", F.exists("said", lambda s: s == 0))
        .select("row", "host", "open", F.filter(
            F.transform(F.arrays_zip("texts", "said"), lambda b, i: F.struct(b["texts"].alias("texts"), b["said"].alias("said"), i.alias("place"))),
            lambda b: b["said"] <= 0,
        ).alias("blocks"))
    )
    dropped = _covered(outside, least, covered)
    # Only pages with blocks that the markup leaves open lose any, so only their texts are shuffled.
    undecided = F.exists("said", lambda s: s == 0)
    none = F.lit(None).cast("array<int>").alias("places")
    joined = parsed.where(undecided).join(dropped, "row", "left").unionByName(parsed.where(~undecided).select("*", none))
    kept = F.filter(
        F.transform(
            F.arrays_zip("texts", "said"),
            lambda b, i: F.when((b["said"] == 1) | ((b["said"] == 0) & ~F.coalesce(F.array_contains("places", i), F.lit(False))), b["texts"]),
        ),
        lambda t: t.isNotNull(),
    )
    return joined.select(F.col("id").alias(id_column), F.col("url").alias(url_column), F.array_join(kept, "\n").alias("text"))


def _covered(outside: DataFrame, least: int, covered: float) -> DataFrame:
    """(row, places): the open blocks of a page that repeated substrings cover.

    Hosts of many pages are cut into shards of bounded size with a suffix array each. A
    shard gives the number of its pages that hold each substring; the sums over shards tell
    what distinct pages share, so the cut does not matter.
    """
    sizes = outside.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / SHARD).alias("shards"))
    sharded = outside.join(sizes, "host").withColumn("shard", F.pmod(F.xxhash64("row"), F.col("shards")))

    def suffixes(group: pd.DataFrame) -> pd.DataFrame:
        streams = [[_hash(t) for b in blocks_ for t in b["texts"].split()] for blocks_ in group["blocks"]]
        ranks = repeated(streams, least)
        rows = np.repeat(np.arange(len(streams)), [len(s) for s in streams])
        flat = np.concatenate(ranks) if ranks else np.zeros(0, np.int64)
        held = np.flatnonzero(flat >= 0)
        pairs = np.unique(np.stack([flat[held], rows[held]]), axis=1)
        names, first = np.unique(flat[held], return_index=True)
        pages = np.bincount(pairs[0], minlength=int(names.max()) + 1 if len(names) else 0)
        starts = np.cumsum([0, *[len(s) for s in streams]])
        texts = [np.array(streams[rows[p]][p - starts[rows[p]] : p - starts[rows[p]] + least], dtype=np.int64) for p in held[first]]
        return pd.DataFrame({"host": group["host"].iloc[0], "part": [signed(xxhash.xxh3_64_intdigest(t.tobytes())) for t in texts], "pages": pages[names] if len(names) else []})

    shared = (
        sharded.groupBy("host", "shard")
        .applyInPandas(suffixes, "host string, part bigint, pages bigint")
        .groupBy("host", "part")
        .agg(F.sum("pages").alias("pages"))
        .where("pages > 1")
    )

    def windows():
        def step(rows, hosts, blocks_):
            out = []
            for row, host, found in zip(rows, hosts, blocks_):
                tokens = np.array([_hash(t) for b in found for t in b["texts"].split()], dtype=np.int64)
                for at in range(len(tokens) - least + 1):
                    out.append((row, host, signed(xxhash.xxh3_64_intdigest(tokens[at : at + least].tobytes())), at))
            return [list(c) for c in zip(*out)] if out else [[]] * 4

        return step

    open_pages = outside.where("open")
    places = map_columns(open_pages, ["row", "host", "blocks"], windows, "row bigint, host string, part bigint, at int")
    hits = places.join(shared, ["host", "part"]).groupBy("row").agg(F.collect_list("at").alias("at"))

    def judge():
        def step(rows, blocks_, starts):
            out = []
            for found, at in zip(blocks_, starts):
                sizes = [len(b["texts"].split()) for b in found]
                hit = np.zeros(sum(sizes), dtype=bool)
                for a in at:
                    hit[a : a + least] = True
                ends = np.cumsum([0, *sizes])
                out.append([int(b["place"]) for b, i, j in zip(found, ends, ends[1:]) if b["said"] == 0 and hit[i:j].mean() >= covered])
            return rows, out

        return step

    numbered = open_pages.join(hits, "row")
    return map_columns(numbered, ["row", "blocks", "at"], judge, "row bigint, places array<int>")
