"""Operator 9: secret scans by assignment-aware lexing.

Two scans of every whole text, in Arrow batches:

* patterns (fixed by the contract): assignments to password-like names, access keys, long hexadecimal runs;
* the lexer cuts source and configuration syntax into tokens (strings of one line, of several lines and back-quoted ones, names,
  operators, brackets, element tags) and reads name-literal pairs from them: ``name = "literal"``, ``name: literal``,
  ``"name": "literal"``, ``NAME=literal``, ``table["name"] = "literal"``, ``setName("literal")``, ``get("name", "default")``,
  ``<name>literal</name>``, a ``name`` / ``key`` entry followed by its ``value`` entry. Values may be in brackets on the next lines, joined by
  ``+`` or by standing side by side in brackets, and hold names: constants bound before are put in for them. A literal scores by the words of
  the names it is bound to (password, token, key, ...) and by its form (length, character classes, entropy); a pair over the threshold adds a
  span of kind ``lexed`` that covers the literal where it stands, also when the telling name gets it through other names; joined
  literals are covered from the first to the last. Spans inside a pattern span of the same text are not repeated.

Defined results: null text is empty; no finds give zero counts, empty ``spans`` and the digest of the empty string;
rows repeat their results; extra columns are ignored. Unclosed brackets end at the next empty line, unclosed strings with their
line. The lexer goes over a text once, without recursion; its memory is one text and its names.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

# The patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
TELLING = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Words of a name and what they add to the score of a literal bound to it.
NAME_SCORES = {"password": 3.0, "passwd": 3.0, "pwd": 3.0, "passphrase": 3.0, "secret": 3.0, "token": 2.5, "apikey": 3.0, "api": 0.5, "key": 1.5,
               "auth": 1.5, "credential": 2.5, "credentials": 2.5, "private": 1.5, "access": 1.0, "bearer": 2.0, "salt": 1.0, "signature": 1.0}
THRESHOLD = 4.0
_PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|changeme|example|placeholder|none|null|true|false|todo|your[-_].*|<.*>|\$\{.*\}|test)$")
_PREFIX = r"(?<!\w)[rbfuRBFU]{0,2}"
#: The tokens; whatever is none of them is passed over. Of words in a row (prose) none but the last can be a target, so they are one token.
TOKEN = re.compile(rf"""
    <(?P<tag>[A-Za-z_][\w.:-]*)(?:\s[^<>\n]*)?>(?P<body>[^<>\n]+)</(?P=tag)\s*>
  | {_PREFIX}(?P<fence>\x22{{3}}|\x27{{3}})(?P<long>[\s\S]*?)(?P=fence)
  | {_PREFIX}(?P<quote>["'`])(?P<short>(?:(?!(?P=quote))[^\\\n]|\\.)*)(?P=quote)
  | (?P<prose>[A-Za-z]++)\x20(?=[A-Za-z])(?:[A-Za-z]++\x20(?=[A-Za-z]))*+
  | (?P<name>[A-Za-z_$][\w$]*(?:[.-][A-Za-z_$][\w$]*)*)
  | (?P<number>[0-9][\w.]*)
  | (?P<gap>\n[\x20\t\r]*\n)
  | (?P<op>:=|=>|===?|!=|<=|>=|\|\||\?\?|[=:+,;()\[\]{{}}<>\n])
""", re.X)
#: What may stand unquoted behind an assignment, to the next white space, quote or bracket.
BARE = re.compile(r"""[\x20\t]*([^\s"'`,;()\[\]{}<>]+)""")
_NAME = re.compile(r"[A-Za-z_$][\w$]*(?:[.-][A-Za-z_$][\w$]*)*\Z")
_WHOLE = re.compile(r"[A-Za-z_$][\w$.-]{0,63}\Z")
ASSIGNS = {"=", ":", ":=", "=>", "==", "==="}
JOINS = {"+", "||", "??"}
CLOSES = {")": "(", "]": "[", "}": "{"}
#: First words of calls whose single literal is a name or a message.
GETTERS = {"get", "getenv", "load", "read", "fetch", "find", "is", "has", "check", "lookup", "input", "prompt", "print", "log", "raise"}
_CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def name_score(name: str) -> float:
    """The words of a name count once each, plurals like their singular."""
    return sum(max(NAME_SCORES.get(w, 0.0), NAME_SCORES.get(w.removesuffix("s"), 0.0)) for w in {w.lower() for w in _CAMEL.findall(name)})


def literal_score(value: str) -> float:
    """0 to 2.5: long, mixed and irregular literals look like secrets; placeholders and names of fields never do."""
    words = _CAMEL.findall(value)
    if len(value) < 6 or _PLACEHOLDER.match(value) or (words and all(w.lower() in NAME_SCORES for w in words)):
        return -10.0
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, len(value) / 20) + 0.25 * (classes - 1) + min(1.0, entropy(value) / 4.0)


class Piece(NamedTuple):
    """A part of a value: a literal that stands at lo:hi, or a name (value None) still to be looked up."""

    value: str | None
    lo: int
    hi: int
    name: str = ""


class Frame:
    """An open bracket (or the text itself): the statement being read in it, and the finished arguments if it is a call."""

    __slots__ = ("args", "callee", "joining", "last", "op", "opened", "pieces", "target")

    def __init__(self, opened: str = "", callee: str = "", target: str = "", op: str = ""):
        self.opened, self.callee, self.target, self.op = opened, callee, target, op
        self.pieces: list[Piece] = []
        self.args: list[list[Piece]] = []
        self.joining = False
        self.last: Piece | None = None  # the operand just read: a target if an assignment follows


class Lexer:
    """One pass over the tokens of a text; ``found`` gets the spans that score, ``bound`` the constants by name."""

    def __init__(self, text: str):
        self.text = text
        self.bound: dict[str, tuple[str, int, int]] = {}
        self.found: set[tuple[int, int]] = set()
        self.label = ""  # the value of a name / key entry, for the value entry behind it
        self.stack = [Frame()]
        self.no_bare = 0

    def resolve(self, pieces: list[Piece]) -> tuple[str, int, int] | None:
        """The joined value and the place of its literals; a constant from elsewhere counts with its own place if no literal stands here."""
        here, there, value = [], [], []
        for p in pieces:
            if p.value is not None:
                value.append(p.value)
                here.append(p)
            elif p.name in self.bound:
                there.append(self.bound[p.name])
                value.append(there[-1][0])
            elif len(pieces) == 1 and re.search("[0-9]", p.name):
                value.append(p.name)  # an unquoted literal in the shape of a name
                here.append(p)
        if here:
            return "".join(value), here[0].lo, here[-1].hi
        return ("".join(value), *there[0][1:]) if there else None

    def judge(self, name: str, value: tuple[str, int, int]) -> None:
        score = name_score(name)
        if score and score + literal_score(value[0]) >= THRESHOLD:
            self.found.add(value[1:])

    def pair(self, name: str, pieces: list[Piece], op: str = "=") -> None:
        word = name.rpartition(".")[2].lower()
        if word in ("name", "key") and len(pieces) == 1:
            self.label = pieces[0].value or pieces[0].name
        value = self.resolve(pieces)
        if value is not None:
            if word == "value" and self.label:
                self.judge(self.label, value)
            self.judge(name, value)
            if op[:2] != "==":
                self.bound[name] = value
        if word not in ("name", "key"):
            self.label = ""

    def flush(self, f: Frame) -> None:
        """End the statement of a frame; a call keeps what was no assignment as an argument."""
        if f.target and f.pieces:
            self.pair(f.target, f.pieces, f.op)
        elif f.pieces and f.callee:
            f.args.append(f.pieces)
        f.pieces, f.joining, f.last = [], False, None
        if f.op != "inherited":  # the elements of a bracket behind an assignment all belong to its target
            f.target = f.op = ""

    def operand(self, p: Piece) -> None:
        f = self.stack[-1]
        side_by_side = f.opened in ("(", "[") and p.value is not None and f.pieces and f.pieces[-1].value is not None
        if f.pieces and not f.joining and not side_by_side:
            self.flush(f)
        if f.target or f.callee:
            f.pieces.append(p)
        f.joining, f.last = False, p

    def assign(self, op: str) -> None:
        f = self.stack[-1]
        if f.last is None:
            return
        target = f.last.name or f.last.value or ""
        if f.target and f.pieces[-1:] == [f.last] and f.last.value is not None:
            target = ""  # the literal is that statement's value: if a == "b":
        elif f.pieces and f.pieces[-1] is f.last:
            f.pieces.pop()  # it is the next statement's target
        self.flush(f)
        if _WHOLE.match(target):
            f.target, f.op = target, op

    def open(self, bracket: str, adjacent: bool) -> None:
        f = self.stack[-1]
        if adjacent and bracket != "{" and f.last is not None and f.last.name:
            if f.pieces and f.pieces[-1] is f.last:
                f.pieces.pop()
            self.stack.append(Frame(bracket, callee=f.last.name))
        elif bracket != "{" and f.target and (f.joining or not f.pieces):
            self.stack.append(Frame(bracket, target=f.target, op="inherited"))
        else:
            self.stack.append(Frame(bracket))

    def close(self, bracket: str, lo: int, hi: int) -> None:
        f = self.stack[-1]
        if f.opened != CLOSES[bracket]:
            return
        self.stack.pop()
        outer = self.stack[-1]
        if f.op == "inherited":  # the value goes on to the outer statement, where more may be joined to it
            outer.pieces.extend(f.pieces)
            outer.joining, outer.last = False, None
            return
        self.flush(f)
        outer.joining, outer.last = False, None
        if not f.callee:
            return
        first = f.args[0][0].value if f.args and len(f.args[0]) == 1 else None
        if f.opened == "[":  # table["name"]: a target, or a constant
            if first:
                outer.last = Piece(None, lo, hi, first)
                if outer.target or outer.callee:
                    outer.pieces.append(outer.last)
            return
        callee = f.callee.rpartition(".")[2]
        verb = (_CAMEL.findall(callee) or [""])[0].lower()
        given: list[Piece] = []
        if len(f.args) >= 2 and first:
            given = f.args[1]
            self.pair(first, given)
        elif f.args and verb not in GETTERS:
            given = f.args[0]
            value = self.resolve(given)
            if value and any(p.value is not None for p in given):
                self.judge(callee, value)
        if outer.target or outer.callee:
            outer.pieces.extend(given or [Piece(None, lo, hi)])

    def line_end(self) -> None:
        f = self.stack[-1]
        waits = f.target and not f.pieces and f.op in ("=", ":=", "=>")
        if not (f.joining or waits or f.opened in ("(", "[")):  # else the value goes on in the next line
            self.flush(f)

    def end(self) -> None:
        """Close whatever is open."""
        for f in reversed(self.stack):
            self.flush(f)
        del self.stack[1:]

    def run(self) -> set[tuple[int, int]]:
        text, pos, before = self.text, 0, -1
        while m := TOKEN.search(text, pos):
            lo, pos = m.span()
            kind = m.lastgroup
            if m["tag"]:
                self.flush(self.stack[-1])
                self.pair(m["tag"], [Piece(m["body"], *m.span("body"))])
            elif m["fence"] or m["quote"]:
                which = "long" if m["fence"] else "short"
                self.operand(Piece(m[which], *m.span(which)))
            elif m["name"] == "or":
                self.stack[-1].joining = True
            elif kind in ("name", "number", "prose"):
                self.operand(Piece(None, lo, m.end(kind), m[kind]))
            elif kind == "gap":
                self.end()
                pos -= 1  # its second line end may begin another empty line
            elif (op := m["op"]) in ASSIGNS:
                self.assign(op)
                if self.stack[-1].target and not self.stack[-1].pieces:
                    pos = self.bare(pos)
            elif op in JOINS:
                self.stack[-1].joining = True
            elif op == "\n":
                self.line_end()
            elif op in CLOSES.values():
                self.open(op, lo == before)
            elif op in CLOSES:
                self.close(op, lo, pos)
            else:
                self.flush(self.stack[-1])
            before = pos
        self.end()
        return self.found

    def bare(self, pos: int) -> int:
        """Read an unquoted value that is not just a name or the start of an expression; the position behind it."""
        if pos < self.no_bare:  # what was no value from an earlier start is none from here
            return pos
        m = BARE.match(self.text, pos)
        if not m or _NAME.match(m[1]):
            return pos
        if m[1][-1] in "+=:" or self.text[m.end():m.end() + 1] in ("(", "[") or not re.search("[0-9]", m[1]):
            self.no_bare = m.end()
            return pos
        self.operand(Piece(m[1], *m.span(1)))
        return m.end()


def lexed(text: str) -> list[tuple[int, int]]:
    """Spans of the literals that score as secrets, by start. A text without any telling word has no telling name."""
    low = text.lower()
    return sorted(Lexer(text).run()) if any(w in low for w in NAME_SCORES) else []


def patterns(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the contract's patterns, sorted."""
    found = []
    low = text.lower()
    if any(w in low for w in TELLING):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def scan_text(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    if not text:
        return [], []
    base = patterns(text)
    starts = [a for a, _, _ in base]
    reach = list(itertools.accumulate((b for _, _, b in base), max))  # furthest end of the pattern spans up to each

    def covered(lo: int, hi: int) -> bool:
        k = bisect.bisect_right(starts, lo)
        return k > 0 and reach[k - 1] >= hi

    return base, [s for s in lexed(text) if not covered(*s)]


SCHEMA = "doc_id long, kinds array<string>, starts array<long>, ends array<long>"


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, kinds, starts, ends): all spans of each document, by start, then kind; ends are exclusive code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, starts, ends = [], [], []
            for text in batch.column(1):
                base, more = scan_text(text.as_py())
                rows = sorted([*base, *((a, len(KINDS), b) for a, b in more)])
                kinds.append([(*KINDS, "lexed")[k] for _, k, _ in rows])
                starts.append([a for a, _, _ in rows])
                ends.append([b for _, _, b in rows])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.list_(pa.string())), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))],
                                             ["doc_id", "kinds", "starts", "ends"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)


def digest(spans: list[str]) -> str:
    return hashlib.sha256(",".join(spans).encode()).hexdigest()
