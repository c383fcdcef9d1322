"""Secret scan over a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams that every match must contain.  Documents
are indexed in blocks: a block's postings list, for every trigram that some rule asks for, the documents that hold
it (ASCII letters lower-cased).  A rule's query intersects and unites postings to candidates, which the regular
expression itself then verifies; a rule without mandatory trigrams scans the whole block.  Blocks
are independent, so the index is built where the texts are read and nothing is shuffled.

Defined results: null counts as empty, an empty text has no spans; spans are in code points, end exclusive, ordered by
start, then by the order of the rules; matches of one rule do not overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from sparsile.llm.text import cut_by_bytes, raw, sizes_of

MOST_STRINGS = 64
ANY = ("any",)


@dataclass(frozen=True)
class Rule:
    """A kind of secret; a match counts if ``group`` of it has ``least`` characters."""

    kind: str
    pattern: str
    any_case: bool = False
    group: int = 0
    least: int = 0

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}"),  # the maximal runs of 24 and more
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]{0,20}PRIVATE KEY-----)?"),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{30,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pay_key", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9._~+/-]{16,}=*", True),
)
RULES = BASE_RULES + MORE_RULES


def _all(parts: list) -> tuple:
    parts = [p for p in dict.fromkeys(parts) if p != ANY]
    return ANY if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _either(parts: list) -> tuple:
    parts = list(dict.fromkeys(parts))
    return ANY if ANY in parts or not parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _of_string(text: str) -> tuple:
    data = text.encode()
    return _all([("has", data[i : i + 3]) for i in range(len(data) - 2)])


class _Sequence:
    """Strings that the part of the pattern read last can be, and what is required so far."""

    def __init__(self) -> None:
        self.tails, self.required, self.whole = {""}, [], True

    def settle(self) -> None:
        self.required.append(_either([_of_string(s) for s in self.tails]))
        self.tails, self.whole = {""}, False

    def extend(self, strings: set[str]) -> None:
        if len(self.tails) * len(strings) > MOST_STRINGS:
            self.settle()
        self.tails = {a + b for a in self.tails for b in strings} if len(strings) <= MOST_STRINGS else {""}


def _class_members(items: list) -> set[str] | None:
    out: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            out.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < 8:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _read(tokens) -> tuple[set[str] | None, tuple]:
    """(all strings the tokens can match, or None; the query they imply)."""
    seq = _Sequence()
    for kind, value in tokens:
        if kind is op.LITERAL:
            seq.extend({chr(value).lower()})
        elif kind is op.IN and (members := _class_members(value)):
            seq.extend(members)
        elif kind is op.SUBPATTERN or kind is op.BRANCH:
            parts = [_read(p) for p in ([value[-1]] if kind is op.SUBPATTERN else value[1])]
            if all(strings is not None for strings, _ in parts) and sum(len(s) for s, _ in parts) <= MOST_STRINGS:
                seq.extend(set().union(*[s for s, _ in parts]))
            else:
                seq.settle()
                seq.required.append(_either([query for _, query in parts]))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            low, high, inner = value
            strings, query = _read(inner)
            if strings is not None and (low, high) == (0, 1):
                seq.extend(strings | {""})
                continue
            if strings is not None and low <= 4:
                for _ in range(low):
                    seq.extend(strings)
            elif low:
                seq.settle()
                seq.required.append(query)
            if high != low or strings is None or low > 4:
                seq.settle()
        elif kind not in (op.AT, op.ASSERT, op.ASSERT_NOT):
            seq.settle()
    if seq.whole:
        return seq.tails, _either([_of_string(s) for s in seq.tails])
    seq.settle()
    return None, _all(seq.required)


def trigram_query(rule: Rule) -> tuple:
    """Boolean query (``any``, ``has``, ``and``, ``or``) that every text with a match satisfies."""
    return _read(parser.parse(rule.pattern, rule.compiled().flags))[1]


def trigrams_of(query: tuple) -> set[bytes]:
    return {query[1]} if query[0] == "has" else set().union(*[trigrams_of(q) for q in query[1:]]) if query != ANY else set()


_LOWER = np.arange(256, dtype=np.int32)
_LOWER[65:91] += 32


class BlockIndex:
    """Postings of the wanted trigrams over one block of texts."""

    def __init__(self, texts: list[bytes], slots: np.ndarray, wanted: list[bytes]) -> None:
        self.n = len(texts)
        buffer = _LOWER[np.frombuffer(b"\0\0".join(texts), np.uint8)]
        self.postings = {t: np.empty(0, np.int64) for t in wanted}
        if len(buffer) < 3:
            return
        found = slots[(buffer[:-2] << 16) | (buffer[1:-1] << 8) | buffer[2:]]
        at = np.flatnonzero(found)
        ends = np.cumsum(sizes_of(texts) + 2)
        pairs = np.unique(found[at].astype(np.int64) * self.n + np.searchsorted(ends, at, side="right"))
        kinds, docs = np.divmod(pairs, self.n)
        cuts = np.searchsorted(kinds, np.arange(1, len(wanted) + 2))
        self.postings = {t: docs[cuts[i] : cuts[i + 1]] for i, t in enumerate(wanted)}

    def candidates(self, query: tuple) -> np.ndarray:
        if query == ANY:
            return np.arange(self.n)
        if query[0] == "has":
            return self.postings[query[1]]
        found = [self.candidates(q) for q in query[1:]]
        out = min(found, key=len) if query[0] == "and" else np.empty(0, np.int64)
        for other in found:
            out = np.intersect1d(out, other, assume_unique=True) if query[0] == "and" else np.union1d(out, other)
        return out


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = [(r.kind, r.compiled(), r.group, r.least, trigram_query(r)) for r in rules]
        self.wanted = sorted(set().union(*[trigrams_of(q) for *_, q in self.rules]))
        self.slots = np.zeros(1 << 24, np.int16)
        for i, t in enumerate(self.wanted):
            self.slots[int.from_bytes(t, "big")] = i + 1

    def block(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """(start, rule number, end) of the secrets of each text, in order."""
        index = BlockIndex(texts, self.slots, self.wanted)
        decoded: dict[int, str] = {}
        spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for number, (_, pattern, group, least, query) in enumerate(self.rules):
            for doc in index.candidates(query).tolist():
                text = decoded.get(doc)
                if text is None:
                    text = decoded[doc] = texts[doc].decode()
                spans[doc] += [(m.start(), number, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
        return [sorted(s) for s in spans]


def find_secrets(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Array of (kind, start, end) of the secrets of each text."""

    @arrow_udf("array<struct<kind:string, start:long, end:long>>")
    def found(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for part in parts:
            rows = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in spans] for piece in cut_by_bytes(part) for spans in scanner.block(raw(piece))]
            yield pa.array(rows, type=kind)

    return found(text)


def mask_secrets(text: Column, rules: tuple[Rule, ...] = RULES, mask: str = "[secret]") -> Column:
    """Each text with its secrets (overlaps joined) replaced by ``mask``; null stays null."""

    @arrow_udf("string")
    def masked(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(rules)
        for part in parts:
            out: list[str | None] = []
            for piece in cut_by_bytes(part):
                texts = piece.to_pylist()
                for t, spans in zip(texts, scanner.block(raw(piece))):
                    if not spans:
                        out.append(t)
                        continue
                    kept, at = [], 0
                    for start, _, end in spans:
                        if start >= at:
                            kept += [t[at:start], mask]
                        at = max(at, end)
                    out.append("".join([*kept, t[at:]]))
            yield pa.array(out, type=pa.string())

    return masked(text)
