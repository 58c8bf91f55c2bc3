"""Byte-level BPE encoding and decoding by prefix dynamic programming.

A BPE encoding is the only token sequence in which every two neighbours would also stand beside each other if just
their own bytes were encoded. So each byte prefix of a piece has exactly one valid last token, and storing it for every
prefix gives the encoding of any of them by walking back. Appending bytes keeps all stored entries; an edit keeps those
before it. Pieces are the matches of the split pattern, encoded separately.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import arrow_map

#: Pieces that each of two generations of a worker's memo keeps with their ids. Results don't depend on it.
MEMO_PIECES = 150_000
#: Pair verdicts that a worker keeps, by the right token.
MEMO_PAIRS = 300_000
#: Texts over so many characters are split and hashed piecewise, in groups of so many pieces.
LONG_TEXT, LONG_GROUP = 1 << 20, 1 << 16
#: Characters of texts that are split at once.
TOGETHER = 1 << 19


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Lines of base64 token and rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class PrefixBPE:
    """Encoder over a rank table: the lowest rank among the concatenations of neighbours merges first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.spot = None  # made when first used, as it isn't pickled
        self._split: dict[int, tuple[int, int] | None | bool] = {}
        self._pairs: dict[int, dict[int, bool]] = {t: {} for t in self.bytes_of}
        self._known = 0
        self.memo = _Memo(self)
        self.bytes_of_text = {str(i): b for i, b in self.bytes_of.items()}

    def split(self, token: int):
        """The two tokens whose merge yields this one; None for a single byte, False if merging never reaches it."""
        found = self._split.get(token, 0)
        if found != 0:
            return found
        b = self.bytes_of[token]
        found = None
        if len(b) > 1:
            parts = [b[i : i + 1] for i in range(len(b))]
            while len(parts) > 2:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    r = self.ranks.get(parts[i] + parts[i + 1])
                    if r is not None and (best is None or r < best):
                        best, at = r, i
                if best is None:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            found = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else False
        self._split[token] = found
        return found

    def beside(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b together would be encoded as just these two tokens.

        Merges inside a and b happen by rank; the two stay apart unless, at some moment, the last part of a and the
        first part of b have a concatenation of lower rank than the merges that are due next to them (on a tie the
        left one goes first)."""
        found = self._pairs[b].get(a)
        if found is None:
            if self._known >= MEMO_PAIRS:
                self._known = 0
                for row in self._pairs.values():
                    row.clear()
            found = self._pairs[b][a] = self._beside(a, b)
            self._known += 1
        return found

    def _beside(self, a: int, b: int) -> bool:
        ranks, of = self.ranks, self.bytes_of
        # Chains of the parts that touch the border, from the whole token down to one byte.
        limit_a = limit_b = 1 << 60  # ranks of the merges that swallow the present border parts
        while True:
            r = ranks.get(of[a] + of[b])
            # The merge across happens before a's part is merged into its parent (that merge lies to the left, so it
            # wins ties) and before b's part is (to the right, so the merge across wins ties).
            if r is not None and r < limit_a and r <= limit_b:
                return False
            sa, sb = self.split(a), self.split(b)
            # Undo the later of the two merges: of equal ranks the right one is the later.
            if sa is None and sb is None:
                return True
            if sb is None or (sa is not None and a > b):
                limit_a, a = a, sa[1]
            else:
                limit_b, b = b, sb[0]

    def spotter(self):
        """Automaton that names all tokens that end at a byte, the longest first, without those that merging never reaches."""
        if self.spot is None:
            import ahocorasick

            self.spot = ahocorasick.Automaton()
            for b, t in self.ranks.items():
                if self.split(t) is not False:
                    self.spot.add_word(b.decode("latin-1"), (len(b), t))
            self.spot.make_automaton()
        return self.spot

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """Fills last, where last[i] is the last token of the encoding of piece[:i + 1], up to the piece's end."""
        have, pairs, beside = len(last), self._pairs, self.beside
        for end, (n, t) in self.spotter().iter(piece.decode("latin-1"), max(0, have - self.longest)):
            if end == have:
                if n <= end:
                    a = last[end - n]
                    ok = pairs[t].get(a)
                    if not (beside(a, t) if ok is None else ok):
                        continue
                last.append(t)
                have += 1
        return last

    def walk(self, last: list[int]) -> list[int]:
        out, at = [], len(last)
        while at:
            out.append(t := last[at - 1])
            at -= len(self.bytes_of[t])
        out.reverse()
        return out

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.walk(self.extend(piece, []))

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.ids_text(text).split(" ") if x]

    def ids_text(self, text: str) -> str:
        """Decimal ids joined by one space."""
        return " ".join(map(self.memo.of().__getitem__, self.pattern.findall(text)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def learn(self, pieces: Iterable[str]) -> None:
        """Puts unknown pieces into the memo. Taken in order, each is the one before with its end changed, so it keeps the
        last tokens of the prefixes that both have."""
        memo, older, ranks = self.memo.of(), self.memo.older, self.ranks
        before, last = b"", []
        for piece in sorted(p for p in pieces if p not in memo):
            if (known := older.get(piece)) is not None:
                memo[piece] = known
                continue
            raw = piece.encode()
            if (whole := ranks.get(raw)) is not None:
                memo[piece] = str(whole)
            elif len(piece) < 64:
                same = 0
                for x, y in zip(before, raw):  # noqa: B905
                    if x != y:
                        break
                    same += 1
                last = self.extend(raw, last[:same])
                before = raw
                memo[piece] = " ".join(map(str, self.walk(last)))

    def digests(self, texts: list[str], with_ids: bool = False) -> list[tuple]:
        """For each text the number of ids, hex SHA-256 of the ids' text and of the bytes decoded from it, and the ids if asked for."""
        out: list[tuple] = []
        at = 0
        while at < len(texts):
            upto, chars = at, 0
            while upto < len(texts) and (upto == at or chars + len(texts[upto]) <= TOGETHER):
                chars += len(texts[upto])
                upto += 1
            split = [self.pattern.findall(t) if len(t) <= LONG_TEXT else None for t in texts[at:upto]]
            self.learn(set().union(*(x for x in split if x)))
            out += [self._long_digest(t, with_ids) if x is None else self._of(" ".join(map(self.memo.__getitem__, x)), with_ids) for t, x in zip(texts[at:upto], split, strict=True)]
            at = upto
        return out

    def digest(self, text: str) -> tuple[int, str, str]:
        return self.digests([text])[0]

    def _of(self, s: str, with_ids: bool) -> tuple:
        ids = s.split(" ") if s else []
        found = len(ids), hashlib.sha256(s.encode()).hexdigest(), hashlib.sha256(b"".join(map(self.bytes_of_text.__getitem__, ids))).hexdigest()
        return (*found, np.array(ids, np.int32)) if with_ids else found

    def _long_digest(self, text: str, with_ids: bool) -> tuple:
        n, of_ids, of_bytes, parts = 0, hashlib.sha256(), hashlib.sha256(), []
        pieces = (m.group() for m in self.pattern.finditer(text))
        while group := list(islice(pieces, LONG_GROUP)):
            s = " ".join(map(self.memo.of().__getitem__, group))
            of_ids.update(((" " if n else "") + s).encode())
            ids = s.split(" ")
            n += len(ids)
            of_bytes.update(b"".join(map(self.bytes_of_text.__getitem__, ids)))
            if with_ids:
                parts.append(np.array(ids, np.int32))
        found = n, of_ids.hexdigest(), of_bytes.hexdigest()
        return (*found, np.concatenate(parts)) if with_ids else found


class _Memo(dict):
    """Ids' text of pieces, in two generations: what the older one still gives moves to the newer."""

    def __init__(self, coder: PrefixBPE):
        super().__init__()
        self.coder, self.older = coder, {}

    def of(self) -> _Memo:
        if len(self) > MEMO_PIECES:
            self.older = dict(self)
            self.clear()
        return self

    def __missing__(self, piece: str) -> str:
        out = self.older.get(piece) or " ".join(map(str, self.coder.encode_piece(piece.encode())))
        if len(piece) < 64:
            self[piece] = out
        return out


class EditableEncoding:
    """A text with its pieces and, for each piece, the last token of every byte prefix.

    append() and replace() split again from shortly before the change until the new split meets an old boundary, and
    re-encode only pieces that changed, each from its first changed byte on."""

    def __init__(self, coder: PrefixBPE, text: str = ""):
        self.coder, self.text = coder, ""
        self.starts: list[int] = []
        self.pieces: list[bytes] = []
        self.last: list[list[int]] = []
        self.steps = 0  # prefixes that were computed, for tests of the saving
        self.replace(0, 0, text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, begin: int, end: int, new: str) -> None:
        from bisect import bisect_left

        old_starts, shift = self.starts, len(new) - (end - begin)
        text = self.text[:begin] + new + self.text[end:]
        ends = [*old_starts[1:], len(self.text)]
        # A match looks at one character past its end, and at a second one where white space is given back.
        keep = bisect_left(ends, begin - 1) if old_starts else 0
        at = old_starts[keep] if keep < len(old_starts) else (len(self.text) if old_starts else 0)
        if at > begin:
            at, keep = begin, keep
        known = {s + shift: k for k, s in enumerate(old_starts) if s >= end and k >= keep}
        starts, pieces, last, tail = [], [], [], len(old_starts)
        old = self.pieces[keep] if keep < len(self.pieces) else b""
        old_last = self.last[keep] if keep < len(self.last) else []
        for m in self.coder.pattern.finditer(text, at):
            if m.start() >= begin + len(new) and m.start() in known:
                tail = known[m.start()]
                break
            piece = m.group().encode()
            same = 0
            while same < min(len(old), len(piece)) and old[same] == piece[same]:
                same += 1
            table = self.coder.extend(piece, list(old_last[:same]))
            self.steps += len(piece) - min(same, len(old_last))
            starts.append(m.start())
            pieces.append(piece)
            last.append(table)
            nxt = keep + len(pieces)
            old, old_last = (self.pieces[nxt], self.last[nxt]) if nxt < len(self.pieces) else (b"", [])
        self.text = text
        self.starts = old_starts[:keep] + starts + [s + shift for s in old_starts[tail:]]
        self.pieces = self.pieces[:keep] + pieces + self.pieces[tail:]
        self.last = self.last[:keep] + last + self.last[tail:]

    def ids(self) -> list[int]:
        out: list[int] = []
        for piece, table in zip(self.pieces, self.last, strict=True):
            whole = self.coder.ranks.get(piece)
            out += [whole] if whole is not None else self.coder.walk(table)
        return out


_CODERS: dict[tuple[int, int, str], PrefixBPE] = {}


def coder_for(data: bytes, pattern: str) -> PrefixBPE:
    """The worker's coder for a rank file; one is kept."""
    key = (len(data), hash(data), pattern)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = PrefixBPE(parse_ranks(data), pattern)
    return _CODERS[key]


def _sent(spark: SparkSession, ranks_path: str):
    """The rank file, broadcast if it isn't too long for that."""
    with open(ranks_path, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError("a rank file of more than 64 MB is not broadcast")
    return spark.sparkContext.broadcast(data)


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row of docs: id, n_tokens, ids_sha256, decoded_sha256, and ids (array<int>) if with_ids.

    The rank file is read by the driver and broadcast (under 1 MB for 50,000 tokens). Null and empty texts have no ids;
    a null id stays null; repeated rows are encoded each; other columns are left out, whatever their names.
    """
    held = _sent(docs.sparkSession, ranks_path)

    def make():
        coder = coder_for(held.value, pattern)

        def work(cols: dict[str, list]) -> dict[str, list]:
            found = coder.digests([t or "" for t in cols["text"]], with_ids)
            names = ("n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else []))
            return {"id": cols["id"]} | {k: [x[i] for x in found] for i, k in enumerate(names)}

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = arrow_map(rows, make, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else ""))
    return out.withColumnRenamed("id", id_col)


def decode(rows: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text decoded from an array of ids (null: empty); bytes that are no UTF-8 become replacement characters."""
    held = _sent(rows.sparkSession, ranks_path)

    def make():
        coder = coder_for(held.value, pattern)
        return lambda cols: {"id": cols["id"], "text": [coder.decode(x or ()).decode("utf-8", "replace") for x in cols["ids"]]}

    kind = rows.schema[id_col].dataType.simpleString()
    out = arrow_map(rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")), make, f"id {kind}, text string")
    return out.withColumnRenamed("id", id_col)
