"""HTML extraction: a suffix array over the token streams of each host finds what its
pages repeat; that, and the structure of the page, vote on every block."""

from __future__ import annotations

import html as entities
import json
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import bits_at, forget, mixed_bits, shuffles_freed, text_of, written

# Elements by their role in a page, as the HTML standard names them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
HIDDEN = frozenset("noscript template iframe noembed noframes xmp svg object canvas audio video select datalist button".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul hr".split()
)
AROUND = frozenset("nav aside footer header form fieldset menu dialog head".split())
CENTRE = frozenset(("article", "main"))
CONTAINERS = frozenset("div section aside ul ol dl table details figure".split())
CLOSED_BY = {"p": BLOCKS, "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr",)), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr"))}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
# Words of class and id attributes that name what surrounds an article, and
# words that go with them in compound names.
NAMES = frozenset(
    "ad ads adbox adslot adunit adsense advert adverts advertisement advertising banner sponsor sponsored sponsors promo promos promotion nav navbar navigation menu sidebar footer masthead "
    "breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login search share sharing social related "
    "recommend recommended recommendations comment comments commentlist respond responses replies disqus pagination pager toolbar widget copyright disclaimer skiplink".split()
)
GENERIC = frozenset("area bar block body box btn button buttons container content group header heading inner item items links list main outer panel section site slot title unit widget wrap wrapper".split())

#: Votes: a block with two or more is left out.
OUT = 2

_OPEN = re.compile(r"<(?=[a-zA-Z/!?])")
_PLAIN = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)([^"'>]*+)>""")
_QUOTED = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """The tags of a page as (start, end, "/" or "", name, attributes); comments and
    declarations have no name, the text of a CDATA section is given as name "!".

    Reads every character a bounded number of times: an end that is not found once is
    not looked for again. After a tag whose quotes never close, tags end at the first
    ">" whatever the quotes; what has no ">" after it is text.
    """
    at, n, last = 0, len(page), page.rfind(">")
    quotes, comment, cdata = True, True, True
    while m := _OPEN.search(page, at):
        a = m.start()
        if page.startswith("<!--", a):
            end = page.find("-->", a + 4) if comment else -1
            comment = end >= 0
            at = end + 3 if comment else n
            yield a, at, "", "", ""
            continue
        if a > last:
            return
        if page.startswith("<![CDATA[", a) and cdata:
            end = page.find("]]>", a)
            if end >= 0:
                at = end + 3
                yield a, at, "", "!", page[a + 9 : end]
                continue
            cdata = False
        if page[a + 1] in "!?":
            at = page.find(">", a) + 1
            yield a, at, "", "", ""
            continue
        t = _PLAIN.match(page, a) or (quotes and _QUOTED.match(page, a)) or None
        if t:
            at = t.end()
            yield a, at, t[1], t[2].lower(), t[3]
            continue
        at = page.find(">", a) + 1
        body = page[a + 1 : at - 1]
        shut = "/" if body.startswith("/") else ""
        name = re.match(r"[a-zA-Z][^\s/>]*+", body[len(shut) :])
        if name:
            quotes = False
            yield a, at, shut, name[0].lower(), body[len(shut) + len(name[0]) :]
        else:  # "</" and no name: a comment to the standard
            yield a, at, "", "", ""


def votes(name: str, attributes: str, in_centre: bool) -> int:
    """How far an element seems to hold what is around an article: ``OUT`` where the
    standard says so (nav, footer, hidden, roles); a class or id that consists of words
    for such parts says so of a container in the centre of a page; any such word in it,
    or on another element, is one vote, and needs a second one."""
    if name in HIDDEN or name in AROUND and not (name == "header" and in_centre):
        return OUT
    if not attributes.strip() or name in ("html", "body") or name in CENTRE:
        return 0
    got = 0
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "role" and value.lower() in ROLES or key == "style" and _UNSEEN.search(value):
            return OUT
        if key in ("class", "id"):
            for token in value.lower().split():
                parts = [p for p in re.split(r"[-_]+", token) if p]
                named = [p in NAMES for p in parts]
                if any(named):
                    sure = name in CONTAINERS and all(n or p in GENERIC for n, p in zip(named, parts, strict=True))
                    got = max(got, OUT if sure and in_centre else 1)
    return got


def blocks(page: str) -> list[tuple[int, bool, str]]:
    """The text blocks of a page in order, each as (votes, inside the centre, text).

    Scripts, styles, comments, markup and what a browser does not show are not text; a
    script without an end tag takes the rest of the page, a picture or frame without
    one ends with the element around it. The centre is an article or main element; on
    a page with one, what stands outside has a vote against it. Character references
    are decoded, white space becomes one blank. An end tag that matches nothing open
    is ignored; one that does closes what was left open inside it.
    """
    out: list[tuple[int, bool, str]] = []
    stack: list[tuple[str, int, bool]] = []  # name, votes, centre
    block_at: list[int] = []  # places in the stack of blocks and paragraphs
    open_names: Counter = Counter()
    parts: list[str] = []
    against, unseen, centre, seen_centre, of_parts = [0], 0, 0, False, (0, False)

    def add(text: str) -> None:
        nonlocal of_parts
        if text and not unseen:
            if not parts:
                of_parts = against[-1], centre > 0
            parts.append(text)

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((*of_parts, text))

    def close(to: int) -> None:
        nonlocal centre, unseen
        while len(stack) > to:
            name, _, c = stack.pop()
            against.pop()
            open_names[name] -= 1
            centre -= c
            unseen -= name in HIDDEN or name == "head"
        while block_at and block_at[-1] >= to:
            block_at.pop()

    at, skip = 0, 0
    for start, end, shut, name, attributes in tags(page):
        if start < skip:
            continue
        add(page[at:start])
        at = end
        if name == "!":
            add(entities.escape(attributes))
        elif not name:
            continue
        elif shut:
            k = len(stack)
            if open_names[name] > 0:
                k -= 1
                while stack[k][0] != name:
                    k -= 1
            if name in BLOCKS or any(x in BLOCKS or v and x not in HIDDEN for x, v, _ in stack[k:]):
                flush()
            close(k)
        elif name in RAW:
            found = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = skip = found.end() if found else len(page)
        elif name == "br":
            add(" ")
        elif name in VOID:
            if name == "hr":
                flush()
        else:
            if name in BLOCKS:
                flush()
                if stack and stack[-1][0] in CLOSED_BY and name in CLOSED_BY[stack[-1][0]]:
                    close(len(stack) - 1)
                elif block_at and stack[block_at[-1]][0] == "p":
                    close(block_at[-1])
            if not attributes.rstrip().endswith("/") or name in BLOCKS:
                v = votes(name, attributes, centre > 0)
                if v and name not in BLOCKS and name not in HIDDEN:
                    flush()  # an inline element with votes is a block of its own
                c = name in CENTRE
                if name in BLOCKS:
                    block_at.append(len(stack))
                stack.append((name, v, c))
                against.append(against[-1] + v)
                open_names[name] += 1
                centre += c
                seen_centre |= c
                unseen += name in HIDDEN or name == "head"
    add(page[at:])
    flush()
    return [(v + (seen_centre and not c), c, t) for v, c, t in out]


def suffix_array(tokens: np.ndarray, length: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``tokens`` in the order of their suffixes, and the rank of each
    position, by prefix doubling. With ``length``, suffixes are in order by that many
    tokens only, and those that share them have one rank."""
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank, width = tokens - tokens.min(), 1
    base = max(int(rank.max()), n) + 2
    while True:
        step = min(width, length - width) if length else width
        ahead = np.zeros(n, np.int64)
        if step < n:
            ahead[: n - step] = rank[step:] + 1
        key = rank * base + ahead
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.r_[0, np.cumsum(key[1:] != key[:-1])]
        width += step
        if rank[order[-1]] == n - 1 or width >= n or width == length:
            return order, rank


def covered(n: int, at: np.ndarray, length: int) -> np.ndarray:
    """Of ``n`` tokens those of the passages that begin at the positions ``at``."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + length, -1)
    return np.cumsum(steps[:-1]) > 0


def own_pages(page: np.ndarray, main: np.ndarray, repeated: np.ndarray, pages: int, unique_share: float) -> np.ndarray:
    """Which pages are evidence: by token its page, whether it is main text, whether a repeat
    covers it. A page whose main text is nearly all repeats (less than ``unique_share`` is
    not) is a copy of others, not an article in boilerplate, and is none."""
    all_main = np.bincount(page, main, pages)
    return (np.bincount(page, main & ~repeated, pages) / np.maximum(all_main, 1) >= unique_share) | (all_main == 0)


def within(here: np.ndarray, length: int) -> np.ndarray:
    """Of the covered words of a block those to remove: all if the block is covered
    whole, else stretches of a passage's length. What a passage that began in the block
    before covers of the next one's first words is no repeat of that block."""
    if here.all():
        return here
    edges = np.flatnonzero(np.diff(np.r_[False, here, False]))
    out = np.zeros(len(here), bool)
    for a, b in edges.reshape(-1, 2).tolist():
        out[a:b] = b - a >= length
    return out


def main_texts(pages: list[list[tuple[int, bool, str]]], gone: np.ndarray, most: np.ndarray, length: int) -> list[str]:
    """The main text of each page, given which tokens of the streams are covered by the
    passages of enough of the host's pages, and which by those of most of them.

    Outside a centre the words that they cover go and unique runs stay. In a centre
    passages of most pages are a vote against a block that they cover whole."""
    out, at, most_at, gone_at = [], 0, np.r_[0, np.cumsum(most)].tolist(), np.r_[0, np.cumsum(gone)].tolist()
    for page in pages:
        lines = []
        for v, centre, text in page:
            to = at + text.count(" ") + 1
            if v < OUT and not centre and gone_at[to] > gone_at[at]:
                text = " ".join(w for w, g in zip(text.split(), within(gone[at:to], length).tolist(), strict=True) if not g)
            elif centre and v + (most_at[to] - most_at[at] == to - at) >= OUT:
                v = OUT
            at = to
            if v < OUT and text:
                lines.append(text)
        at += 1
        out.append("\n".join(lines))
    return out


class WordHashes(dict):
    """64-bit hashes of words, each worked out once."""

    def __missing__(self, word: str) -> int:
        import xxhash

        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = WordHashes()


class Streams:
    """The token streams of pages, one after the other, and their suffix array.

    A page is a list of blocks (votes, inside the centre, text). Every page ends in a
    token of its own, so no repeat goes over the end of a page. ``run`` numbers the
    passages of ``length`` tokens by the array (-1 where a page ends sooner).
    """

    def __init__(self, pages: list[list[tuple[int, bool, str]]], length: int):
        self.pages, self.length = pages, length
        self.words = words = []
        counts, kinds, size = [], [], []  # words of a block and what it is; words of a page
        for page in pages:
            before = len(words)
            for v, centre, text in page:
                w = text.split()
                words += w
                counts.append(len(w))
                kinds.append((v < OUT, v < OUT and not centre, v == OUT - 1 and centre))
            size.append(len(words) - before)
        self.size = np.array(size, np.int64)
        ends = np.cumsum(self.size + 1) - 1
        n = len(words) + len(pages)
        self.inside = inside = np.ones(n, bool)
        inside[ends] = False
        self.page = np.repeat(np.arange(len(pages)), self.size + 1)
        self.fits = np.arange(n) + length <= np.repeat(ends, self.size + 1)
        of_tokens = np.zeros((3, n), bool)
        of_tokens[:, inside] = np.repeat(np.array(kinds, bool).reshape(-1, 3).T, counts, axis=1)
        # main text; of it what repeats take away, and what they are the second vote against
        self.main, self.loose, self.voted = of_tokens
        # pages of one main text are one: copies of an article are no evidence
        bodies: dict[str, int] = {}
        self.body = np.array([bodies.setdefault("\n".join(t for v, _, t in page if v < OUT), len(bodies)) for page in pages], np.int64)
        self.bodies = list(bodies)

    @cached_property
    def run(self) -> np.ndarray:
        return self.runs(self.fits)

    def runs(self, chosen: np.ndarray) -> np.ndarray:
        """The numbers of the passages that begin at the ``chosen`` positions, by the
        suffix array of their tokens; -1 elsewhere."""
        n = len(self.page)
        at = np.flatnonzero(covered(n, np.flatnonzero(chosen), self.length))  # words only: a passage holds no end
        out = np.full(n, -1, np.int64)
        tokens = pd.factorize(np.array(self.words, dtype=object)[at - self.page[at]])[0]
        out[at] = suffix_array(tokens.astype(np.int64), self.length)[1]
        return np.where(chosen, out, -1)

    def carriers(self, at: np.ndarray) -> np.ndarray:
        """By run, how many distinct main texts carry it at the positions ``at``."""
        n = int(self.body.max(initial=0)) + 1
        return np.bincount(np.unique(self.run[at] * n + self.body[self.page[at]]) // n, minlength=len(self.page))

    def of_runs(self, chosen: np.ndarray) -> np.ndarray:
        """The positions of runs for which ``chosen`` is true."""
        return np.flatnonzero(self.fits & chosen[self.run])

    def repeats(self, unique_share: float) -> tuple[np.ndarray, int]:
        """How many pages with main texts of their own carry each run, and their number."""
        marked = self.of_runs(self.carriers(np.flatnonzero(self.fits)) > 1)
        own = own_pages(self.page, self.main, covered(len(self.page), marked, self.length), len(self.pages), unique_share)
        n = self.carriers(marked[own[self.page[marked]]])
        return np.where(n > 1, n, 0), len(np.unique(self.body[own]))

    def texts(self, marked: np.ndarray, mostly: np.ndarray) -> list[str]:
        """The main text of each page, given where the passages to go begin (``main_texts``)."""
        return main_texts(self.pages, *(covered(len(self.page), at, self.length) for at in (marked, mostly)), self.length)

    @cached_property
    def hashed(self) -> np.ndarray:
        """By token a 64-bit hash of the word, 0 for an end."""
        if len(_HASHES) > 1 << 19:
            _HASHES.clear()
        h = np.zeros(len(self.page), np.uint64)
        h[self.inside] = np.fromiter(map(_HASHES.__getitem__, self.words), np.uint64, len(self.words))
        return h

    def hashes(self, at: np.ndarray, length: int) -> np.ndarray:
        """64-bit hashes of the ``length`` words from the positions ``at``."""
        out = np.zeros(len(at), np.uint64)
        for k in range(length):
            out = mixed_bits(out * np.uint64(0x9E3779B97F4A7C15) + self.hashed[at + k])
        return out

    def stretches(self, at: np.ndarray, body: np.ndarray) -> np.ndarray:
        """For the passages that begin at the positions ``at`` the unbroken stretch of main text
        they lie in, as a hash of the main text (``body``, by page) and the stretch's place in
        it; 0 for those with other words. Pages that share the stretch have all its passages."""
        edges = np.flatnonzero(np.diff(np.r_[False, self.main, False]))
        begins, ends = edges[::2], edges[1::2]
        if not len(begins):
            return np.zeros(len(at), np.uint64)
        before = np.r_[0, np.cumsum(self.main)]
        first = np.r_[0, np.cumsum(self.size + 1)][self.page[begins]]  # where the page begins
        place = (before[begins] - before[first]).astype(np.uint64) << np.uint64(32) | (ends - begins).astype(np.uint64)
        unit = mixed_bits(body[self.page[begins]] + mixed_bits(place)) | np.uint64(1)
        k = np.searchsorted(begins, at, side="right") - 1
        return np.where((k >= 0) & (at + self.length <= ends[k]), unit[k], np.uint64(0))

    def anchors(self, words: int) -> np.ndarray:
        """For each passage, where it ``fits``, the least hash of ``words`` words in a row in
        it: equal passages have equal anchors, neighbours mostly share one."""
        at, words = np.flatnonzero(self.fits), min(words, self.length)
        n, steps = len(self.page), self.length - words + 1
        h = np.full(n + steps, np.iinfo(np.uint64).max)
        h[: max(0, n - words + 1)] = self.hashes(np.arange(max(0, n - words + 1)), words)
        return np.minimum.reduce([h[at + k] for k in range(steps)])


def told_once(key: np.ndarray, page: np.ndarray, unit: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of a shard's passages (by passage its anchor, page and unit, see
    ``Streams.stretches``): the units, how many keys each has, and the keys (40 bits).

    A key is told once a page, under 0 if any passage that has it is no part of a unit, and
    once for pages that share the unit (under 0 the main text)."""
    first = np.r_[True, (key[1:] != key[:-1]) | (page[1:] != page[:-1]) | (unit[1:] != unit[:-1])][: len(key)]
    key, page, unit = key[first] & np.uint64((1 << 40) - 1), page[first], unit[first]
    order = np.lexsort((unit, key, page))
    key, page, unit = key[order], page[order], unit[order]
    first = np.r_[True, (key[1:] != key[:-1]) | (page[1:] != page[:-1])][: len(key)]
    key, page, unit = key[first], page[first], unit[first]
    of = np.where(unit == 0, body[page], np.uint64(0))
    order = np.lexsort((key, of, unit))
    key, unit, of = key[order], unit[order], of[order]
    first = np.r_[True, (key[1:] != key[:-1]) | (unit[1:] != unit[:-1]) | (of[1:] != of[:-1])][: len(key)]
    units, numbers = np.unique(unit[first], return_counts=True)
    return units, numbers.astype(np.uint32), key[first]


def dealt(key: np.ndarray, body: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Keys of one shard and the main texts that hold them, each pair once, by bucket of
    keys, and the buckets as (bucket, from, to). Two texts a key are enough to tell that it
    repeats. The order depends on the keys and texts only."""
    order = np.lexsort((body, key))
    key, body = key[order], body[order]
    fresh = np.r_[True, (key[1:] != key[:-1]) | (body[1:] != body[:-1])][: len(key)]
    key, body = key[fresh], body[fresh]
    few = np.r_[[True, True], key[2:] != key[:-2]][: len(key)]
    key, body = key[few], body[few]
    bucket = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((body, bucket))
    key, body, bucket = key[order], body[order], bucket[order]
    cuts = np.r_[np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket)].tolist()
    return key, body, [(int(bucket[a]), a, b) for a, b in zip(cuts, cuts[1:])]


def of_two_texts(key: np.ndarray, body: np.ndarray) -> np.ndarray:
    """The keys that two main texts or more hold."""
    order = np.lexsort((body, key))
    key, body = key[order], body[order]
    return np.unique(key[1:][(key[1:] == key[:-1]) & (body[1:] != body[:-1])])


def repeated_keys(rows: DataFrame) -> DataFrame:
    """By shard and bucket (of those with any) which of its keys, in the order of ``dealt``, two
    main texts or more of all shards hold: shard, buckets (ints), hits (a bit for each key)."""

    def repeated(group: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(k, np.uint64) for k in group["keys"]]
        key, cuts = np.concatenate(parts), np.cumsum([0, *map(len, parts)]).tolist()
        hit = np.isin(key, of_two_texts(key, np.concatenate([np.frombuffer(b, np.uint64) for b in group["bodies"]])))
        out = pd.DataFrame({"shard": group["shard"], "bucket": group["bucket"], "hits": [np.packbits(hit[a:b]).tobytes() if hit[a:b].any() else b"" for a, b in zip(cuts, cuts[1:])]})
        return out[out["hits"].str.len() > 0]

    found = rows.groupBy("bucket").applyInPandas(repeated, "shard long, bucket int, hits binary")
    found = found.groupBy("shard").agg(F.collect_list(F.struct("bucket", "hits")).alias("found"))
    return found.select("shard", F.col("found.bucket").alias("buckets"), F.col("found.hits").alias("hits"))


def repeated_field(rows: DataFrame, bits: int) -> np.ndarray:
    """2^``bits`` bits, those at the last bits of the keys that are there twice or more; the
    driver gets them in 64 compressed slices."""
    slices, low = 64, np.uint32((1 << bits) - 1)
    width = (1 << bits) // slices

    def repeated(group: pd.DataFrame) -> pd.DataFrame:
        key = np.sort(np.concatenate([np.frombuffer(k, np.uint32) for k in group["keys"]]))
        place = np.unique(key[1:][key[1:] == key[:-1]] & low).astype(np.int64)
        cuts = np.searchsorted(place, np.arange(slices + 1) * width).tolist()
        return pd.DataFrame({"slice": np.arange(slices), "places": [place[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]})

    def drawn(group: pd.DataFrame) -> pd.DataFrame:
        field = np.zeros(width, bool)
        for places in group["places"]:
            field[np.frombuffer(places, np.int64) % width] = True
        return pd.DataFrame({"slice": group["slice"].iloc[:1], "part": [zlib.compress(np.packbits(field, bitorder="little").tobytes(), 1)]})

    places = rows.groupBy("bucket").applyInPandas(repeated, "slice int, places binary")
    field = np.zeros((slices, width // 32), np.uint32)
    for r in places.groupBy("slice").applyInPandas(drawn, "slice int, part binary").collect():
        field[r["slice"]] = np.frombuffer(zlib.decompress(r["part"]), np.uint32)
    return field.ravel()


def unsigned(longs) -> np.ndarray:
    """A list of longs, or null for none, as unsigned numbers."""
    return np.asarray(() if longs is None else longs, np.int64).view(np.uint64)


def squeezed(data: bytes) -> bytes:
    import pyarrow as pa

    return pa.Codec("zstd", compression_level=3).compress(data, asbytes=True)


def unsqueezed(data: bytes) -> bytes:
    import pyarrow as pa

    return pa.input_stream(pa.py_buffer(data), compression="zstd").read()


def packed(page: list[tuple[int, bool, str]]) -> str:
    """Blocks as lines, each after a digit for its votes and its place; texts hold no line end."""
    return "\n".join(f"{2 * min(v, OUT) + c}{text}" for v, c, text in page)


def unpacked(read: str) -> list[tuple[int, bool, str]]:
    return [(int(line[0]) // 2, line[0] in "135", line[1:]) for line in read.split("\n")] if read else []


def stored(pages: list[tuple], reads: list[str]) -> bytes:
    """The pages of a shard, what is known of each (a list JSON can hold) and its packed blocks."""
    lines = [json.dumps(about) + ("\n" + read if read else "") for about, read in zip(pages, reads, strict=True)]
    return squeezed("\n".join(lines).encode())


def restored(data: bytes) -> tuple[list[list], list[list[tuple[int, bool, str]]]]:
    about, pages = [], []
    for line in unsqueezed(data).decode().split("\n"):
        if line[0] == "[":
            about.append(json.loads(line))
            pages.append([])
        else:
            pages[-1].append((int(line[0]) // 2, line[0] in "135", line[1:]))
    return about, pages


DEALT = "page_id long, url string, host string, read string"
SHARDS = "kind string, shard long, units array<long>, held array<long>, data binary"
GATHERED = "bucket int, keys binary"
SEEN = "shard long, n long, data binary"
TOLD = "shard long, bucket int, keys binary, bodies binary"


def frame(rows: list[dict], schema: str) -> pd.DataFrame:
    """Rows as ``mapInPandas`` takes them; what a row does not have is null."""
    names = [part.split()[0] for part in schema.split(", ")]
    return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in names})


def over_shards(pages: DataFrame, length: int, share: float, most: float, unique_share: float, least: int, shard_chars: int, chars: int, anchor: int = 5, filter_bits: int = 28) -> DataFrame:
    """The texts of hosts of many pages (page_id, url, salt: the host's hash, html), as one array of all
    pages of a host gives them, whichever shard a page is in.

    A shard is what a task reads, ``shard_chars`` of html at a time; pages are parsed once
    and stored by shard. Three rounds over the shards find what one array would:

    1. Each shard tells the anchors of its passages (``Streams.anchors``, a fifth or so as
       many), once for each main text; those of a stretch of main text that several shards
       hold (``Streams.stretches``) are told by one of them. Only passages whose anchor is
       told twice can be in two main texts of the host (by a filter of at most
       2^``filter_bits`` bits, which misses none); of these each shard numbers the equal ones by a suffix array and tells
       the passages, again with main texts. Those of two are repeats.
    2. By all repeats of the host each page is evidence or not. How many main texts of
       pages that are carry a repeat, and how many there are, is summed over the shards;
       a main text that several shards hold is named in the sum and counts once.
    3. Each shard learns which of its passages enough pages carry, or most.
    """
    buckets = -(-chars // (1 << 25))
    bits = min(filter_bits, max(16, (chars // 16).bit_length()))
    spark = pages.sparkSession

    def salted(keys, salt: np.ndarray) -> np.ndarray:
        return mixed_bits(keys ^ salt)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            for _, part in batch.groupby(batch["html"].str.len().cumsum().to_numpy() // shard_chars):
                read = [blocks(page) for page in part["html"]]
                s, salt = Streams(read, length), part["salt"].to_numpy(np.int64).view(np.uint64)
                text = np.array([xxhash.xxh64_intdigest(t) for t in s.bodies], np.uint64)
                body = salted(text[s.body], salt)
                at = np.flatnonzero(s.fits)
                page = s.page[at]
                units, numbers, keys = told_once(salted(s.anchors(anchor), salt[page]), page, s.stretches(at, body), body)
                about = zip(part["page_id"], part["url"], salt.tolist(), body.tolist(), strict=True)
                data = stored([(None if i is None else int(i), u, h, b) for i, u, h, b in about], [packed(page) for page in read])
                told = pickle.dumps((numbers, keys.astype(np.uint32), (keys >> np.uint64(32)).astype(np.uint8)))
                yield frame([{"kind": "anchors", "shard": shard, "units": units.view(np.int64), "data": told}, {"kind": "pages", "shard": shard, "held": np.unique(body).view(np.int64), "data": data}], SHARDS)
                shard += 1

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The anchors of many shards as a row for each bucket, without units that another shard tells."""
        parts: list[np.ndarray] = []

        def out() -> pd.DataFrame:
            key = np.sort(np.concatenate(parts))
            parts.clear()
            key = key[np.r_[[True, True], key[2:] != key[:-2]][: len(key)]]
            cuts = np.searchsorted(key, (np.arange(buckets + 1, dtype=np.uint64) << np.uint64(40)) // np.uint64(buckets)).tolist()
            return frame([{"bucket": k, "keys": key[a:b].astype(np.uint32).tobytes()} for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a], GATHERED)

        for batch in batches:
            for units, data, copies in zip(batch["units"], batch["data"], batch["copies"], strict=True):
                numbers, low, high = pickle.loads(data)
                told = np.repeat(~np.isin(unsigned(units), unsigned(copies)), numbers)
                parts.append(low[told] | high[told].astype(np.uint64) << np.uint64(32))
                if sum(map(len, parts)) >= 1 << 21:
                    yield out()
        if parts:
            yield out()

    def passages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, data in zip(batch["shard"], batch["data"], strict=True):
                about, read = restored(data)
                s = Streams(read, length)
                salt, body = (np.array([a[k] for a in about], np.uint64) for k in (2, 3))
                at, may = np.flatnonzero(s.fits), np.zeros(len(s.page), bool)
                may[at] = bits_at(field.value, (salted(s.anchors(anchor), salt[s.page[at]]) & np.uint64((1 << bits) - 1)).astype(np.int64))
                at = np.flatnonzero(may)
                run, first, of = np.unique(s.runs(may)[at], return_index=True, return_inverse=True)
                word = s.hashes(at[first], length)[of] if len(at) else np.zeros(0, np.uint64)
                key = salted(word, salt[s.page[at]])
                seen = {"after": np.diff(at, prepend=0).astype(np.int32), "key": key, "size": s.size.astype(np.int32), "main": np.packbits(s.main), "loose": np.packbits(s.loose), "voted": np.packbits(s.voted), "salt": salt, "body": body}
                yield frame([{"shard": shard, "n": len(at), "data": squeezed(pickle.dumps(seen))}], SEEN)

    def recalled(data: bytes) -> tuple[dict, np.ndarray, np.ndarray]:
        """What a shard has seen, where its passages begin and their page by position."""
        x = pickle.loads(unsqueezed(data))
        return x, np.cumsum(x["after"], dtype=np.int64), np.repeat(np.arange(len(x["size"])), x["size"].astype(np.int64) + 1)

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, data in zip(batch["shard"], batch["data"], strict=True):
                x, at, page = recalled(data)
                key, body, parts = dealt(x["key"], x["body"][page[at]], groups)
                yield frame([{"shard": shard, "bucket": k, "keys": key[a:b].tobytes(), "bodies": body[a:b].tobytes()} for k, a, b in parts], TOLD)

    def repeated(x: dict, at: np.ndarray, page: np.ndarray, bucket, hits) -> np.ndarray:
        """The keys of a shard that ``repeated_keys`` found."""
        if bucket is None:
            return np.zeros(0, np.uint64)
        key, _, parts = dealt(x["key"], x["body"][page[at]], groups)
        found = dict(zip(bucket, hits, strict=True))
        return np.concatenate([key[a:b][np.unpackbits(np.frombuffer(found[k], np.uint8), count=b - a).astype(bool)] for k, a, b in parts if k in found])

    def holds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, data, bucket, hits in zip(batch["shard"], batch["data"], batch["buckets"], batch["hits"], strict=True):
                keys = np.unique(repeated(*recalled(data), bucket, hits))
                yield pd.DataFrame({"shard": np.full(len(keys), shard), "passage": keys.view(np.int64)})

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data, bucket, hits, several in zip(batch["data"], batch["buckets"], batch["hits"], batch["several"], strict=True):
                x, at, page = recalled(data)
                n, body, salt = len(page), x["body"], x["salt"]
                marked = np.isin(x["key"], repeated(x, at, page, bucket, hits))
                at = at[marked]
                own = own_pages(page, np.unpackbits(x["main"], count=n).astype(bool), covered(n, at, length), len(body), unique_share)
                named = np.isin(body, unsigned(several))
                p, k = page[at], x["key"][marked]
                # a passage (or, under 0, the host) and a main text of its own pages, each pair once
                pairs = pd.DataFrame({"salt": np.r_[salt[p][own[p]], salt[own]], "passage": np.r_[k[own[p]], np.zeros(own.sum(), np.uint64)], "of": np.r_[np.zeros(own[p].sum(), bool), np.ones(own.sum(), bool)]})
                pairs["body"], pairs["named"] = np.r_[body[p][own[p]], body[own]], np.r_[named[p][own[p]], named[own]]
                pairs = pairs.drop_duplicates()
                pairs["body"] = pairs["body"].where(pairs["named"], np.uint64(0))
                out = pairs.groupby(["salt", "passage", "of", "named", "body"], as_index=False).size().rename(columns={"size": "n"})
                for c in ("salt", "passage", "body"):
                    out[c] = out[c].to_numpy(np.uint64).view(np.int64)
                yield out[["salt", "passage", "of", "named", "body", "n"]]

    def marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for shard, data, found, mostly in zip(batch["shard"], batch["data"], batch["passages"], batch["mostly"], strict=True):
                (x, begins, page), row = recalled(data), {"shard": shard}
                n = len(page)
                for c, keys, where in (("gone", found, "loose"), ("most", mostly, "voted")):
                    at = begins[np.isin(x["key"], unsigned(keys))]
                    before = np.r_[0, np.cumsum(np.unpackbits(x[where], count=n))]
                    at = at[before[at + length] > before[at]]  # those that decide on a word
                    row[c] = at.astype(np.int32).tobytes() if len(at) else None
                if row["gone"] or row["most"]:
                    rows.append(row)
            yield frame(rows, "shard long, gone binary, most binary")

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data, gone, mostly in zip(batch["data"], batch["gone"], batch["most"], strict=True):
                about, read = restored(data)
                n = sum(t.count(" ") + 1 for page in read for _, _, t in page) + len(read)
                at = (np.frombuffer(b or b"", np.int32).astype(np.int64) for b in (gone, mostly))
                out = main_texts(read, *(covered(n, a, length) for a in at), length)
                yield pd.DataFrame({"page_id": pd.array([a[0] for a in about], "Int64"), "url": pd.Series([a[1] for a in about], dtype=object), "text": pd.Series(out, dtype=object)})

    # each of these runs once, so that what it shuffles goes when it ends
    with shuffles_freed(spark):
        both = written(pages.mapInPandas(parse, SHARDS), "kind")
        anchors, kept = (both.where(F.col("kind") == kind) for kind in ("anchors", "pages"))
        anchors._written_at = f"{both._written_at}/kind=anchors"
        units = anchors.select("shard", F.explode("units").alias("unit")).where("unit <> 0")
        homes = units.groupBy("unit").agg(F.min("shard").alias("home"), F.count("*").alias("n")).where("n > 1")
        copies = written(units.join(homes, "unit").where("shard <> home").groupBy("shard").agg(F.collect_list("unit").alias("copies")))
        gathered = anchors.select("shard", "units", "data").join(copies, "shard", "left").mapInPandas(gather, GATHERED)
        field = spark.sparkContext.broadcast(repeated_field(gathered, bits))
        forget(anchors)
        forget(copies)
        seen = written(kept.select("shard", "data").mapInPandas(passages, SEEN))
        field.unpersist()
        groups = -(-(seen.agg(F.sum("n")).first()[0] or 1) // (1 << 21))
        repeats = written(repeated_keys(seen.mapInPandas(tell, TOLD)))
        held = kept.select("shard", F.explode("held").alias("body"))
        several = held.join(held.groupBy("body").count().where("count > 1"), "body").groupBy("shard").agg(F.collect_list("body").alias("several"))
        sums = seen.join(repeats, "shard", "left").join(several, "shard", "left").mapInPandas(counts, "salt long, passage long, of boolean, named boolean, body long, n long")
        sums = sums.groupBy("salt", "passage", "of", "named", "body").agg(F.sum("n").alias("n"))
        sums = written(sums.groupBy("salt", "passage", "of").agg(F.sum(F.when(F.col("named"), 1).otherwise(F.col("n"))).alias("n")))
        known = sums.where("not of and n > 1").drop("of").join(sums.where("of").select("salt", F.col("n").alias("pages")), "salt")
        known = known.where((F.col("n") >= least) & (F.col("n") >= share * F.col("pages")))
        # stored, so that Spark sees how few they are: then what shards hold is not shuffled to meet them
        known = written(known.select("passage", (F.col("n") >= most * F.col("pages")).alias("mostly")))
        forget(sums)
        of = F.col("passage")
        has = seen.join(repeats, "shard").mapInPandas(holds, "shard long, passage long").join(known, "passage")
        has = written(has.groupBy("shard").agg(F.collect_list(of).alias("passages"), F.collect_list(F.when(F.col("mostly"), of)).alias("mostly")))
        marked = written(seen.join(has, "shard").mapInPandas(marks, "shard long, gone binary, most binary"))
        for done in (seen, repeats, known, has):
            forget(done)
    return kept.select("shard", "data").join(marked, "shard", "left").mapInPandas(texts, "page_id long, url string, text string")


def extract(pages: DataFrame, length: int = 12, share: float = 0.05, most: float = 0.5, unique_share: float = 0.25, least: int = 3, shard_chars: int = 1 << 19, broadcast_rows: int = 100_000) -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars.

    Every page is read into blocks of text with the votes of its structure (``votes``,
    ``blocks``), and all blocks of all pages of a host form its token streams. A suffix
    array of the streams finds the passages of ``length`` words or more that stand on
    ``least`` or more of its pages, and on ``share`` of them or more; pages of one main text
    count once and near copies of others not at all, so a host's copied articles are
    no boilerplate. Outside an article or main element, blocks that such passages cover
    whole go, and of others the stretches of ``length`` words or more that they cover;
    unique runs of words stay. Inside one, passages of ``most`` of the
    host's pages are a vote beside that of a class or id. A block with two votes goes;
    what has fewer stays, wherever it stands.

    A host whose html is longer than ``shard_chars`` is many tasks (``over_shards``): each
    shard of pages has an array of its own, and what shards find is summed by (host,
    passage), compared by 64-bit hashes. ``shard_chars`` changes no result.

    Cases: null html is empty and gives an empty text; pages with a null or odd url are
    pages of one host (""), ids may be null or repeat (each row is a page); an empty
    table gives an empty result; other columns are ignored.
    """
    host = F.coalesce(F.lower(F.try_parse_url(F.col("url").cast("string"), F.lit("HOST"))), F.lit(""))
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), text_of("html").alias("html"))
    large = source.groupBy("host").agg(F.sum(F.length("html")).alias("chars")).where(F.col("chars") > shard_chars)
    hosts, chars = large.agg(F.count("*"), F.sum("chars")).first()
    large = large.select("host", F.lit(True).alias("large"))
    placed = source.join(F.broadcast(large) if hosts <= broadcast_rows else large, "host", "left")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 500):  # the blocks of 500 pages at a time
                part = batch.iloc[a : a + 500]
                frame = part[["page_id", "url", "host"]].copy()
                frame["page_id"] = frame["page_id"].astype("Int64")
                frame["read"] = [packed(blocks(page)) for page in part["html"]]
                yield frame

    def whole_host(group: pd.DataFrame) -> pd.DataFrame:
        group = group.reset_index(drop=True)
        s = Streams([unpacked(read) for read in group["read"]], length)
        n, of = s.repeats(unique_share)
        texts = s.texts(s.of_runs(n >= max(least, share * of)), s.of_runs(n >= max(least, most * of)))
        return pd.DataFrame({"page_id": group["page_id"].astype("Int64"), "url": group["url"].astype(object), "text": pd.Series(texts, dtype=object)})

    small = placed.where("large is null").drop("large").mapInPandas(parse, DEALT)
    texts = small.groupBy("host").applyInPandas(whole_host, "page_id long, url string, text string")
    if hosts:
        wide = placed.where("large").select(F.col("page_id").cast("string").alias("page_id"), "url", F.xxhash64("host").alias("salt"), "html")
        texts = texts.unionByName(over_shards(wide, length, share, most, unique_share, least, shard_chars, chars))
    return texts.withColumn("n_chars", F.length("text").cast("long"))
