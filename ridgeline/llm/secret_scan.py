"""Secret scans: keywords by Aho-Corasick, anchored expressions at the hits only, then embedded checksums.

Kinds and their order: assign, access and hex are the base kinds; token is the kind that this method adds, for tokens
that carry a CRC-32 of their own text, which is recomputed, so a random look-alike is not reported.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import arrow_map

KINDS = ("assign", "access", "hex", "token")
BASE = KINDS[:3]
# Keywords of assignments and the prefixes of tokens with a checksum in their last six characters.
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = "AKIA"
CHECKED = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

ASSIGN_AT = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS_AT = re.compile(r"AKIA[A-Z0-9]+")
CHECKED_AT = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
#: A run of 16 or more is found whole, as a shorter run can't hold a match: the same as taking runs and dropping short ones.
HEX_AT = re.compile(r"[0-9a-f]{16,}")
HEX_DIGITS = "0123456789abcdef"
#: Keywords of hex runs are all strings of so many digits: a long run has one at each of its first places.
HEX_KEYWORD = 4
LEAST_ASSIGN, LEAST_ACCESS = 12, 18


def checksum(body: str) -> str:
    """CRC-32 in six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out


class Scanner:
    def __init__(self):
        import ahocorasick

        self.spot = ahocorasick.Automaton()
        for word in KEYWORDS:
            self.spot.add_word(word, ("assign", len(word)))
        self.spot.add_word(ACCESS.lower(), ("access", len(ACCESS)))
        for word in CHECKED:
            self.spot.add_word(word, ("token", len(word)))
        for digits in product(HEX_DIGITS, repeat=HEX_KEYWORD):
            if (word := "".join(digits)) not in self.spot:
                self.spot.add_word(word, ("hex", HEX_KEYWORD))
        self.spot.make_automaton()

    def hits(self, text: str) -> dict[str, list[int]]:
        """Ascending places of keywords, letters in either case."""
        low = text.lower()
        if len(low) != len(text):  # a capital whose small form has two characters would shift the places
            low = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
        out: dict[str, list[int]] = {}
        for end, (kind, n) in self.spot.iter(low):
            out.setdefault(kind, []).append(end - n + 1)
        return out

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) by start, then by kind. In each kind matches are leftmost and don't overlap."""
        out: list[tuple[int, int, str]] = []
        hits = self.hits(text)
        for kind, expression, good in (
            ("assign", ASSIGN_AT, lambda m: len(m[2]) >= LEAST_ASSIGN),
            ("access", ACCESS_AT, lambda m: m.end() - m.start() >= LEAST_ACCESS),
            ("hex", HEX_AT, lambda m: True),
            ("token", CHECKED_AT, lambda m: checksum(m[1]) == m[2]),
        ):
            done = 0
            for at in sorted(hits.get(kind, ())):
                if at >= done and (m := expression.match(text, at)):
                    done = m.end()
                    if good(m):
                        out.append((m.start(), m.end(), kind))
        return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Replaces spans, overlapping ones as one, by [kind], the kind of the first."""
    out, at, k = [], 0, 0
    while k < len(spans):
        a, b, kind = spans[k]
        k += 1
        while k < len(spans) and spans[k][0] < b:
            b = max(b, spans[k][1])
            k += 1
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_assign, n_access, n_hex, n_token, base_sha256, spans ("kind:start:end", comma-joined).

    Places are code points, ends exclusive. Null and empty texts have no spans; null ids and repeated rows keep a row
    each; texts of any length are scanned whole; other columns are left out.
    """

    def make():
        scanner = Scanner()

        def work(cols: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"id": cols["id"], "base_sha256": [], "spans": []} | {f"n_{k}": [] for k in KINDS}
            for text in cols["text"]:
                found = scanner.spans(text or "")
                for k in KINDS:
                    out[f"n_{k}"].append(sum(x[2] == k for x in found))
                out["base_sha256"].append(hashlib.sha256(listed([x for x in found if x[2] in BASE]).encode()).hexdigest())
                out["spans"].append(listed(found))
            return out

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return arrow_map(rows, make, f"id {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_token bigint, base_sha256 string, spans string").withColumnRenamed("id", id_col)


def redacted(docs: DataFrame, *, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """docs with every span in its text replaced by its kind in brackets, and chars_col counted anew where that changed it.

    Null texts stay null. Columns and their order are kept.
    """
    out = docs.schema
    names = [f"c{k}" for k in range(len(out))]
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, out, strict=True))
    at = names[docs.columns.index(text_col)]
    chars = names[docs.columns.index(chars_col)] if chars_col in docs.columns else None

    def make():
        scanner = Scanner()

        def work(cols: dict[str, list]) -> dict[str, list]:
            for k, text in enumerate(cols[at]):
                if text and (found := scanner.spans(text)):
                    cols[at][k] = redact(text, found)
                    if chars:
                        cols[chars][k] = len(cols[at][k])
            return cols

        return work

    return arrow_map(docs.toDF(*names), make, schema).toDF(*docs.columns)
