"""Secret scans: Aho-Corasick prefilter, anchored expressions near hits, checksums."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import text_of

# The base expressions and the lengths below which a match is dropped.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
# Token families that end in a checksum of six base-62 digits.
CHECKED_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
CHECKED = r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KINDS = ("assign", "access", "hex", "checked", "card")

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_checked long, n_card long"


def base62_crc(body: str) -> str:
    """CRC-32 of ``body`` as six base-62 digits, the form such tokens end in."""
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits


def luhn(digits: str) -> bool:
    """Whether the last digit is the Luhn check digit of the others."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


@lru_cache(maxsize=1)
def automaton():
    """Every keyword that can begin a match, over text with A-Z lowered."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, keywords in (("assign", ASSIGN_WORDS), ("access", ("akia",)), ("checked", CHECKED_PREFIXES)):
        for w in keywords:
            found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


EXPRESSIONS = {
    "assign": re.compile(ASSIGN.replace("(password", "((?i:password", 1).replace("key)", "key))", 1), re.ASCII),
    "access": re.compile(ACCESS),
    "checked": re.compile(CHECKED),
}
#: A run of hex digits long enough to count: greedy, so it is the base expression's own match.
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
CARD = re.compile(r"(?<![0-9])[3-6][0-9]{12,18}(?![0-9])")


def secrets(text: str) -> list[tuple[int, int, int]]:
    """All spans of ``text`` as (start, rank of kind in ``KINDS``, end).

    The automaton reads the lowered text once; an expression is tried only where one
    of its keywords begins, left to right, and not inside the match before. Matches
    that are too short are dropped but still cover their text, as in a plain search.
    Runs of hex digits have no keyword, so their own class is the filter.
    """
    lowered = text if text.islower() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes: A-Z only
    spans, ends = [], {"assign": 0, "access": 0, "checked": 0}
    hits = sorted((end - n + 1, kind) for end, (kind, n) in automaton().iter(lowered))
    for start, kind in hits:
        if start < ends[kind] or not (m := EXPRESSIONS[kind].match(text, start)):
            continue
        ends[kind] = m.end()
        if kind == "assign":
            good = len(m[2]) >= LEAST["assign"]
        elif kind == "access":
            good = m.end() - start >= LEAST["access"]
        else:
            good = base62_crc(m[1]) == m[2]
        if good:
            spans.append((start, KINDS.index(kind), m.end()))
    spans += [(m.start(), KINDS.index("hex"), m.end()) for m in LONG_HEX.finditer(text)]
    spans += [(m.start(), KINDS.index("card"), m.end()) for m in CARD.finditer(text) if luhn(m[0])]
    return sorted(spans)


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts by kind and the spans found.

    Base kinds are assign, access and hex; the method adds ``checked`` (tokens of
    known families whose last six characters are the checksum of the rest) and
    ``card`` (13 to 19 digits that pass the Luhn check). Spans are
    kind:start:end in code points, end exclusive, sorted by start, then kind.
    A pure map: no shuffle.

    Cases: a null text is an empty one and has no spans; null and repeated ids pass
    through; an empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                spans = secrets(text)
                counts = [sum(k == i for _, k, _ in spans) for i in range(len(KINDS))]
                told = [f"{KINDS[k]}:{a}:{b}" for a, k, b in spans]
                base = ",".join(x for x, s in zip(told, spans, strict=True) if s[1] < 3)
                out.append((doc_id, *counts[:3], hashlib.sha256(base.encode()).hexdigest(), ",".join(told), *counts[3:]))
            frame = pd.DataFrame(out, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_checked", "n_card"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInPandas(run, SCHEMA)
