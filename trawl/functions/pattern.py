"""Regular expressions: a parser for a linear-time dialect, and what runs them on Spark.

The dialect has Unicode classes by default, POSIX classes, class set operations, named groups and
inline flags; it has no look-around, back-references, atomic groups or possessive quantifiers, and
a quantifier after a quantifier nests. User text never reaches Java's engine as it is: the syntax
tree is emitted anew, once for Java and once for the regex module. Matching is line by line.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import regex


#: A quantifier's count at most.
MOST_REPEATS = 100_000


class BadPattern(ValueError):
    """The pattern is not in the dialect."""


@dataclass(frozen=True)
class Lit:
    text: str


@dataclass(frozen=True)
class Class:
    """ranges of code points, or only the emitted form (java, python) where the set is large."""

    ranges: tuple[tuple[int, int], ...] | None
    form: str = ""


@dataclass(frozen=True)
class Look:
    kind: str


@dataclass(frozen=True)
class Repeat:
    node: object
    least: int
    most: int | None
    greedy: bool


@dataclass(frozen=True)
class Cat:
    parts: tuple = ()


@dataclass(frozen=True)
class Alt:
    parts: tuple = ()


#: POSIX classes, ASCII only.
POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": "\x00-\x7f", "blank": "\t ", "cntrl": "\x00-\x1f\x7f", "digit": "0-9",
    "graph": "!-~", "lower": "a-z", "print": " -~", "punct": "!-/:-@\\[-`{-~", "space": "\t-\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
_CONTROLS = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v", "a": "\a"}
_LAST = 0x10FFFF


@lru_cache(1)
def _folds() -> dict[str, tuple[str, ...]]:
    """Characters that differ by simple case only, each with all of its group."""
    groups: dict[str, list[str]] = {}
    for code in range(_LAST + 1):
        c = chr(code)
        upper = c.upper() if len(c.upper()) == 1 else c
        low = upper.lower() if len(upper.lower()) == 1 else c
        if (low != c or upper != c) and code != 0x131:
            groups.setdefault(low, []).append(c)
    out = {}
    for low, members in groups.items():
        every = tuple(sorted({low, *members}))
        if len(every) > 1:
            out.update(dict.fromkeys(every, every))
    return out


def merged(ranges) -> tuple[tuple[int, int], ...]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return tuple(map(tuple, out))


def _outside(ranges) -> tuple[tuple[int, int], ...]:
    out, at = [], 0
    for a, b in merged(ranges):
        if a > at:
            out.append((at, a - 1))
        at = b + 1
    return tuple([*out, (at, _LAST)] if at <= _LAST else out)


def _char(code: int) -> str:
    return f"\\x{{{code:x}}}" if code > 126 or not chr(code).isalnum() else chr(code)


def _range_form(ranges) -> str:
    return "[" + "".join(_char(a) if a == b else f"{_char(a)}-{_char(b)}" for a, b in ranges) + "]"


class _Set:
    """A class while it is read: ranges as long as they are known, and its form."""

    def __init__(self, ranges, form: str | None = None):
        self.ranges = merged(ranges) if ranges is not None else None
        self.form = form if form is not None else (_range_form(self.ranges) if self.ranges else "[a&&b]")

    def union(self, other: _Set) -> _Set:
        if self.ranges is not None and other.ranges is not None:
            return _Set(self.ranges + other.ranges)
        return _Set(None, f"[{self.form}{other.form}]")

    def negated(self) -> _Set:
        return _Set(_outside(self.ranges)) if self.ranges is not None else _Set(None, f"[^{self.form}]")

    def both(self, other: _Set) -> _Set:
        if self.ranges is not None and other.ranges is not None:
            return _Set([(max(a, c), min(b, d)) for a, b in self.ranges for c, d in other.ranges if max(a, c) <= min(b, d)])
        return _Set(None, f"[{self.form}&&{other.form}]")

    def folded(self) -> _Set:
        if self.ranges is None:
            return self
        folds = _folds()
        size = sum(b - a + 1 for a, b in self.ranges)
        chars = (chr(c) for a, b in self.ranges for c in range(a, b + 1)) if size < len(folds) else (c for c in folds if any(a <= ord(c) <= b for a, b in self.ranges))
        return _Set([*self.ranges, *((ord(x), ord(x)) for c in chars for x in folds.get(c, ()))])

    def node(self) -> object:
        if self.ranges is not None and len(self.ranges) == 1 and self.ranges[0][0] == self.ranges[0][1]:
            return Lit(chr(self.ranges[0][0]))
        return Class(self.ranges, self.form)


def _perl(c: str) -> _Set:
    return _Set(None, {"d": r"\p{Nd}", "D": r"\P{Nd}"}.get(c, "\\" + c))


class _Parser:
    def __init__(self, text: str, ignore_case: bool):
        self.text, self.at = text, 0
        self.flags = {"i": ignore_case, "s": False, "m": True, "x": False, "U": False}
        self.names: set[str] = set()
        self.depth = 0

    def fail(self, why: str):
        raise BadPattern(f"{why} at {self.at} in {self.text!r}")

    def peek(self, s: str) -> bool:
        return self.text.startswith(s, self.at)

    def take(self, s: str) -> bool:
        if self.peek(s):
            self.at += len(s)
            return True
        return False

    def next(self) -> str:
        if self.at >= len(self.text):
            self.fail("unexpected end")
        self.at += 1
        return self.text[self.at - 1]

    def whole(self) -> object:
        node = self.alternation()
        if self.at < len(self.text):
            self.fail("unmatched )")
        return node

    def alternation(self) -> object:
        held, self.depth = dict(self.flags), self.depth + 1
        if self.depth > 200:
            self.fail("too deeply nested")
        parts = [self.sequence()]
        while self.take("|"):
            parts.append(self.sequence())
        self.flags, self.depth = held, self.depth - 1
        return alternatives(parts)

    def skip_blank(self) -> None:
        while self.flags["x"] and self.at < len(self.text):
            if self.text[self.at].isspace():
                self.at += 1
            elif self.text[self.at] == "#":
                self.at = (self.text.find("\n", self.at) + 1) or len(self.text)
            else:
                return

    def sequence(self) -> object:
        parts: list = []
        while True:
            self.skip_blank()
            if self.at >= len(self.text) or self.text[self.at] in "|)":
                return sequence_of(parts)
            if (node := self.atom()) is None:
                continue
            while (again := self.quantifier()) is not None:
                node = Repeat(node, *again)
            parts.append(node)

    def quantifier(self) -> tuple[int, int | None, bool] | None:
        self.skip_blank()
        start = self.at
        if self.take("*"):
            least, most = 0, None
        elif self.take("+"):
            least, most = 1, None
        elif self.take("?"):
            least, most = 0, 1
        elif self.take("{"):
            m = regex.compile(r"\s*(\d+)\s*(?:(,)\s*(\d*)\s*)?\}").match(self.text, self.at)
            if not m:
                self.at = start
                self.fail("bad repetition")
            self.at = m.end()
            least = int(m[1])
            most = least if not m[2] else int(m[3]) if m[3] else None
            if most is not None and most < least or max(least, most or 0) > MOST_REPEATS:
                self.fail("bad repetition")
        else:
            return None
        lazy = self.take("?")
        return least, most, lazy == self.flags["U"]

    def atom(self) -> object | None:
        c = self.next()
        if c in "*+?{":
            self.fail("repetition of nothing")
        if c == "(":
            return self.group()
        if c == "[":
            return self.folded(self.bracket()).node()
        if c == ".":
            return _Set([(0, _LAST)] if self.flags["s"] else [(0, 9), (11, _LAST)]).node()
        if c in "^$":
            return Look({"^": "line_start", "$": "line_end"}[c] if self.flags["m"] else {"^": "text_start", "$": "text_end"}[c])
        if c == "\\":
            return self.escape()
        return self.literal(c)

    def literal(self, c: str) -> object:
        return self.folded(_Set([(ord(c), ord(c))])).node()

    def folded(self, s: _Set) -> _Set:
        return s.folded() if self.flags["i"] else s

    def group(self) -> object | None:
        if self.take("?"):
            named = self.take("P<") or (self.peek("<") and not self.peek("<=") and not self.peek("<!") and self.take("<"))
            if named:
                name = regex.compile(r"[A-Za-z_][A-Za-z0-9_.\[\]]*>").match(self.text, self.at)
                if not name or name[0] in self.names:
                    self.fail("bad group name")
                self.names.add(name[0])
                self.at = name.end()
            elif not self.take(":"):
                m = regex.compile(r"([a-zA-Z]*)(?:-([a-zA-Z]+))?([:)])").match(self.text, self.at)
                if not m or not (m[1] or m[2]) or (set(m[1]) | set(m[2] or "")) - set("imsxUu") or "u" in (m[2] or ""):
                    self.fail("unknown group or flag")
                self.at = m.end()
                on = {**dict.fromkeys(m[1], True), **dict.fromkeys(m[2] or "", False)}
                on.pop("u", None)
                if m[3] == ")":
                    self.flags.update(on)
                    return None
                held = dict(self.flags)
                self.flags.update(on)
                node = self.alternation()
                self.flags = held
                if not self.take(")"):
                    self.fail("unclosed group")
                return node
        node = self.alternation()
        if not self.take(")"):
            self.fail("unclosed group")
        return node

    def escape(self) -> object:
        c = self.next()
        if c in "dDwWsS":
            return _perl(c).node()
        if c in "pP":
            return self.folded(self.property(c == "P")).node()
        if c == "b" and self.peek("{"):
            for kind in ("start-half", "end-half", "start", "end"):
                if self.take(f"{{{kind}}}"):
                    return Look(f"word_{kind}")
            self.fail("bad boundary")
        if c in "bBAz<>":
            return Look({"b": "boundary", "B": "no_boundary", "A": "text_start", "z": "text_end", "<": "word_start", ">": "word_end"}[c])
        return self.literal(self.code(c))

    def code(self, c: str) -> str:
        """The character of an escape that stands for one."""
        if c in _CONTROLS:
            return _CONTROLS[c]
        if c in "xuU":
            size = {"x": 2, "u": 4, "U": 8}[c]
            m = regex.compile(r"\{([0-9A-Fa-f]+)\}").match(self.text, self.at) or regex.compile(rf"([0-9A-Fa-f]{{{size}}})").match(self.text, self.at)
            if not m or int(m[1], 16) > _LAST or 0xD800 <= int(m[1], 16) < 0xE000:
                self.fail("bad code point")
            self.at = m.end()
            return chr(int(m[1], 16))
        if c.isascii() and not c.isalnum() and c not in "<>":
            return c
        self.fail("unknown escape")

    def property(self, negative: bool) -> _Set:
        m = regex.compile(r"\{(\^?)([A-Za-z0-9_ =:-]+)\}|([A-Z])").match(self.text, self.at)
        if not m:
            self.fail("bad property")
        self.at = m.end()
        negative ^= bool(m[1])
        name = (m[3] or m[2]).strip()
        name = name.split("=")[-1].split(":")[-1]
        short = {"letter": "L", "number": "N", "punctuation": "P", "symbol": "S", "mark": "M", "separator": "Z", "other": "C", "uppercase": "Lu", "lowercase": "Ll"}.get(name.lower(), name)
        try:
            regex.compile(rf"\p{{{short}}}")
        except regex.error:
            self.fail("unknown property")
        if len(short) <= 2:
            return _Set(None, f"\\{'P' if negative else 'p'}{{{short}}}")
        return _Set(None, f"\\{'P' if negative else 'p'}{{Is{short}}}")

    def bracket(self) -> _Set:
        negative = self.take("^")
        total: _Set | None = None
        first = True
        while True:
            if self.at >= len(self.text):
                self.fail("unclosed class")
            if not first and self.take("]"):
                break
            for sign in ("&&", "--", "~~"):
                if not first and self.take(sign):
                    right = self.operand()
                    left = total or _Set(())
                    total = left.both(right) if sign == "&&" else left.both(right.negated()) if sign == "--" else left.both(right.negated()).union(right.both(left.negated()))
                    break
            else:
                item = self.item(first)
                total = item if total is None else total.union(item)
            first = False
        total = self.folded(total or _Set(()))
        return total.negated() if negative else total

    def operand(self) -> _Set:
        """What follows a set operation, up to the next one or the end."""
        total: _Set | None = None
        while self.at < len(self.text) and not self.peek("]") and not any(map(self.peek, ("&&", "--", "~~"))):
            item = self.item(False)
            total = item if total is None else total.union(item)
        return total or _Set(())

    def item(self, first: bool) -> _Set:
        if self.peek("[:"):
            m = regex.compile(r"\[:(\^?)([a-z]+):\]").match(self.text, self.at)
            if m and m[2] in POSIX:
                self.at = m.end()
                inner = _Parser("[" + POSIX[m[2]] + "]", False)
                inner.next()
                known = inner.bracket()
                return known.negated() if m[1] else known
        c = self.next()
        if c == "[":
            return self.bracket()
        if c == "\\":
            e = self.next()
            if e in "dDwWsS":
                return _perl(e)
            if e in "pP":
                return self.property(e == "P")
            c = self.code(e)
        if self.peek("-") and not self.peek("--") and self.at + 1 < len(self.text) and self.text[self.at + 1] != "]":
            self.at += 1
            end = self.next()
            if end == "\\":
                end = self.code(self.next())
            if end < c:
                self.fail("bad range")
            return _Set([(ord(c), ord(end))])
        return _Set([(ord(c), ord(c))])


def sequence_of(parts: list) -> object:
    """Neighbouring literals become one."""
    out: list = []
    for p in (q for part in parts for q in (part.parts if isinstance(part, Cat) else [part])):
        if isinstance(p, Lit) and out and isinstance(out[-1], Lit):
            out[-1] = Lit(out[-1].text + p.text)
        else:
            out.append(p)
    return out[0] if len(out) == 1 else Cat(tuple(out))


def alternatives(parts: list) -> object:
    """Alternatives of one character each become a class."""
    if len(parts) == 1:
        return parts[0]
    ranges = []
    for p in parts:
        if isinstance(p, Lit) and len(p.text) == 1:
            ranges.append((ord(p.text), ord(p.text)))
        elif isinstance(p, Class) and p.ranges is not None:
            ranges += p.ranges
        else:
            return Alt(tuple(parts))
    return _Set(ranges).node()


_WORD_LOOKS = {
    "boundary": r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))", "no_boundary": r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))", "word_start": r"(?<!\w)(?=\w)",
    "word_end": r"(?<=\w)(?!\w)", "word_start-half": r"(?<!\w)", "word_end-half": r"(?!\w)",
}


def _escaped(text: str, python: bool) -> str:
    return "".join(c if c.isalnum() and c.isascii() else (f"\\U{ord(c):08x}" if python else f"\\x{{{ord(c):x}}}") for c in text)


def emit(node: object, python: bool = False, first: bool = True, last: bool = True) -> str:
    """For Java, to follow (?dU), or for the regex module (V1); first, last: of a line that begins or ends the text."""
    go = lambda n: emit(n, python, first, last)
    if isinstance(node, Lit):
        return _escaped(node.text, python)
    if isinstance(node, Class):
        form = node.form if node.ranges != () else "(?!)"
        return regex.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", form).replace("{Is", "{") if python else form
    if isinstance(node, Look):
        if node.kind in _WORD_LOOKS:
            return _WORD_LOOKS[node.kind]
        start = "start" in node.kind
        if node.kind.startswith("text") and not (first if start else last):
            return "(?!)"
        return r"\A" if start else (r"\Z" if python else r"\z")
    if isinstance(node, Repeat):
        most = "" if node.most is None else node.most
        count = {(0, ""): "*", (1, ""): "+", (0, 1): "?"}.get((node.least, most), f"{{{node.least},{most}}}")
        return f"(?:{go(node.node)}){count}{'' if node.greedy else '?'}"
    if isinstance(node, Alt):
        return "(?:" + "|".join(map(go, node.parts)) + ")"
    return "".join(map(go, node.parts))


def can_be_empty(node: object) -> bool:
    if isinstance(node, Lit):
        return not node.text
    if isinstance(node, Class):
        return False
    if isinstance(node, Look):
        return True
    if isinstance(node, Repeat):
        return node.least == 0 or can_be_empty(node.node)
    return (any if isinstance(node, Alt) else all)(map(can_be_empty, node.parts))


def recursive_in_java(node: object) -> bool:
    """Whether Java's engine would use its stack for each repetition, which a long line would overflow."""
    if isinstance(node, Repeat):
        single = isinstance(node.node, Class) or isinstance(node.node, Lit) and len(node.node.text) == 1
        return not single and (node.most is None or node.most > 100) or recursive_in_java(node.node)
    return isinstance(node, (Alt, Cat)) and any(map(recursive_in_java, node.parts))


def _has(node: object, kind: str) -> bool:
    if isinstance(node, Look):
        return node.kind == kind
    return _has(node.node, kind) if isinstance(node, Repeat) else isinstance(node, (Alt, Cat)) and any(_has(p, kind) for p in node.parts)


@dataclass(frozen=True)
class Pattern:
    text: str
    tree: object
    fixed: str | None = None  # the text itself, where plain containment decides
    empty: bool = field(default=False)
    in_python: bool = field(default=False)
    at_text_start: bool = field(default=False)
    at_text_end: bool = field(default=False)

    def java(self, first: bool = True, last: bool = True) -> str:
        return "(?dU)" + emit(self.tree, False, first, last)

    def python(self, first: bool = True, last: bool = True) -> str:
        return "(?V1)" + emit(self.tree, True, first, last)


def compile_pattern(text: str, ignore_case: bool = False, fixed: bool = False) -> Pattern:
    """Raises BadPattern for an empty pattern and for whatever is not in the dialect."""
    if not text:
        raise BadPattern("empty pattern")
    tree = sequence_of([_Parser("", ignore_case).literal(c) for c in text]) if fixed else _Parser(text, ignore_case).whole()
    p = Pattern(text, tree, text if fixed and not ignore_case else None, can_be_empty(tree), recursive_in_java(tree), _has(tree, "text_start"), _has(tree, "text_end"))
    try:
        regex.compile(p.python())
    except regex.error as e:
        raise BadPattern(f"{e} in {text!r}") from e
    return p
