"""Secret scans by assignment-aware lexing.

Three fixed forms (assign, access, hex) are matched over the whole text. Beyond them a lexer goes
through source and configuration syntax once: strings (quoted, triple-quoted, back-quoted, with
prefixes and escapes), comments, and the operators that stand outside of both. Each operator gives
a name and its literals:

* names: `name`, `a.b-c`, `"name"`, `a["name"]`, `$a{name}`, `name[]`, `name: type`, `name type`, `<name>`;
* operators: `=`, `:`, `:=`, `=>`, `+=`; comparisons are none;
* values: strings and bare words with a digit, in brackets, lists and calls, joined by `+`, `.`, `..`,
  `&` or standing next to one another; names of constants, dotted or by subscript, stand for their
  literals.

Constants are carried from one assignment to the next, in the order of the text and whatever block
they stand in; the last assignment of a name holds. Each literal is scored by how sensitive the name
is that it reaches; those give spans of kind `lex`.

Nulls and empty texts have no spans. Rows are independent: repeated rows, null doc_ids and extra
columns change nothing, and an empty table gives an empty result. Equal starts are ordered by kind
as listed in KINDS, then by end. Time is linear in the text.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from trawl.llm.shared import chunks, extended, pick, table

KINDS = ("assign", "access", "hex", "lex")
#: Words of a name that make its literal a secret, and how much they count.
NAME_SCORES = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "bearer": 0.8, "auth": 0.7, "key": 0.6, "signature": 0.5,
}
#: Pairs of words that count as one.
NAME_PAIRS = {("api", "key"): 1.0, ("access", "key"): 1.0, ("private", "key"): 1.0, ("secret", "key"): 1.0}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|changeme|change_me|example|placeholder|none|null|true|false|todo|redacted|<.*>|\$\{.*\}|\{\{.*\}\})$")
LEAST_SCORE = 0.5

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")
_NAME_START = re.compile(r"[A-Za-z_]")
#: What a lexer must look at: openings of strings and comments, and operators.
_EVENT = re.compile(r"""["'`#]|/[/*]|<!--|=>|:=|\+=|[=!<>]=+|=~|=|:+""")
_CLOSED = {q: re.compile(rf"(?:[^{q}\\\n]|\\[^\n])*{q}") for q in "\"'`"}
_ANNOTATED = re.compile(r"[ \t]*[A-Za-z_][A-Za-z0-9_.]*(?:\[[^\]\n=]*\])?(?:[ \t]*\|[ \t]*[A-Za-z_][A-Za-z0-9_.]*)*[?!]?[ \t]+(?==(?![=>~]))")
_TYPE_WORDS = frozenset("string String str char bytes text varchar".split())
_BLANKS, _SPACES = re.compile(r"[ \t]*"), re.compile(r"\s*")
_NAME = re.compile(r"[$@]?[A-Za-z_][A-Za-z0-9_.-]*")
_BARE = re.compile(r"[A-Za-z0-9+/_.=@!%^~-]+")
_JOIN = re.compile(r"[ \t]*(?:\+(?!=)|\.\.|[.&](?=[ \t]*[\"'`$]))")
_ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.:-]*)>[ \t]*([^<>\s]+)[ \t]*</")
_NO_DIGIT = re.compile(r"[^0-9]*\Z")
_PREFIXES = frozenset("rRbBfFuU")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

Span = tuple[str, int, int, int, int]


def base_spans(text: str) -> list[Span]:
    """(kind, start, end, start and end of the secret itself) of the fixed forms."""
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [("assign", m.start(), m.end(), m.start(2), m.end(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", m.start(), m.end(), m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


def name_score(name: str) -> float:
    words = [w.lower() for w in _WORD.findall(name)]
    return max([0.0, *(NAME_SCORES.get(w, 0.0) for w in words), *(NAME_PAIRS.get(p, 0.0) for p in zip(words, words[1:], strict=False))])


class Value:
    """A sum of literals, kept as the spans it names itself and the constants it was made of."""

    def __init__(self, text: str, spans: list[tuple[int, int]], carried: list[Value]):
        self.spans, self.carried, self.told = spans, carried, False
        self.counts = Counter(text[i] for a, b in spans for i in range(a, b))
        for v in carried:
            self.counts.update(v.counts)
        # a constant alone, however often it was carried, is still the one literal
        first = spans + [v.only for v in carried]
        self.only = first[0] if len(first) == 1 else None

    def score(self, text: str) -> float:
        """0 for short, placeholder-like or monotonous literals, up to 1 for long random ones."""
        n = sum(self.counts.values())
        if n < 8 or " " in self.counts or self.only and PLACEHOLDER.match(text[slice(*self.only)]):
            return 0.0
        entropy = -sum(c / n * math.log2(c / n) for c in self.counts.values())
        kinds = len({"a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else "" for c in self.counts})
        return min(1.0, 0.25 * entropy * (0.5 + 0.25 * min(kinds, 2)))

    def tell(self) -> Iterator[tuple[int, int]]:
        """The spans of all its literals that haven't been told before."""
        todo = [self]
        while todo:
            v = todo.pop()
            if not v.told:
                v.told = True
                yield from v.spans
                todo += v.carried


class Lexed:
    """Strings, comments and operators of a text, in one pass."""

    def __init__(self, text: str):
        self.text = text
        self.strings: dict[int, tuple[int, int, int]] = {}  # opening quote -> inner start, inner end, end
        self.ending: dict[int, int] = {}  # end of a string -> its opening quote
        self.operators: list[tuple[int, int, str]] = []
        unclosed, at = {}, 0  # per kind of opening: up to where it is known to stay open
        while m := _EVENT.search(text, at):
            i, at, what = m.start(), m.end(), m[0]
            if what in "\"'`":
                before = text[i - 1] if i else " "
                if what == "'" and before.isalnum() and not (before in _PREFIXES and not text[max(0, i - 2)].isalnum()):
                    continue  # an apostrophe
                fence = what * 3
                if text.startswith(fence, i):
                    if what == "`":
                        at = i + 3  # a fence of code, not a string
                        continue
                    end = text.find(fence, i + 3) if unclosed.get(fence, -1) < i else -1
                    if end >= 0:
                        at = self._string(i, i + 3, end, end + 3)
                        continue
                    unclosed[fence] = len(text)
                if unclosed.get(what, -1) >= i:
                    continue
                if c := _CLOSED[what].match(text, i + 1):
                    at = self._string(i, i + 1, c.end() - 1, c.end())
                else:  # no quote up to the line's end closes this one, nor any opened later in the line
                    unclosed[what] = self._line_end(i)
            elif what == "#":
                if not i or text[i - 1] in " \t\r\n;{}(),":
                    at = self._line_end(i)
            elif what == "//":
                if not i or text[i - 1] not in ":/" and not text[i - 1].isalnum() or text[i + 2 : i + 3] in ("", " ", "\t"):
                    at = self._line_end(i)
            elif what in ("/*", "<!--"):
                close = "*/" if what == "/*" else "-->"
                end = text.find(close, at) if unclosed.get(what, -1) < i else -1
                if end >= 0:
                    at = end + len(close)
                else:
                    unclosed[what] = len(text)
            elif what in ("=", ":=", "=>", "+=") or what == ":" and text[at : at + 1] != "/":
                self.operators.append((i, at, what))

    def _line_end(self, i: int) -> int:
        end = self.text.find("\n", i)
        return len(self.text) if end < 0 else end

    def _string(self, i: int, inner: int, inner_end: int, end: int) -> int:
        self.strings[i] = (inner, inner_end, end)
        self.ending[end] = i
        return end

    def _back(self, end: int) -> int:
        while end and self.text[end - 1] in " \t":
            end -= 1
        return end

    def _name_start(self, end: int) -> int:
        while end and self.text[end - 1] in _NAME_CHARS:
            end -= 1
        return end

    def target(self, end: int) -> str | None:
        """The name that ends before end, blanks aside. No operator is passed, so all calls are linear together."""
        text, key = self.text, ""
        end = self._back(end)
        if end in self.ending:
            name = text[slice(*self.strings[self.ending[end]][:2])]
            return name if _NAME_START.match(name) else None
        if end and text[end - 1] in "]}":
            at = self._back(end - 1)
            if at in self.ending:
                at = self.ending[at]
                key = "." + text[slice(*self.strings[at][:2])]
            elif (start := self._name_start(at)) < at:
                key, at = "." + text[start:at], start - (start > 0 and text[start - 1] == ":")
            at = self._back(at)
            if not at or text[at - 1] not in "[{":
                return None
            end = self._back(at - 1)
        start = self._name_start(end)
        if not key and text[start:end] in _TYPE_WORDS:  # name type = value
            up = self._back(start)
            if (first := self._name_start(up)) < up < start:
                start, end = first, up
        first = _NAME_START.search(text, start, end)
        return text[first.start() : end] + key if first else None

    def subscript(self, at: int) -> tuple[str, int] | None:
        """Of ["key"] at this place the key and the end."""
        if self.text[at : at + 1] in ("[", "{"):
            i = _BLANKS.match(self.text, at + 1).end()
            if i in self.strings:
                a, b, end = self.strings[i]
                end = _BLANKS.match(self.text, end).end()
                if self.text[end : end + 1] in ("]", "}"):
                    return self.text[a:b], end + 1
        return None

    def values(self, at: int, constants: dict[str, list[Value]]) -> list[Value]:
        """The values that start here: one, or those of a list or of a call's arguments."""
        text, out, depth, called = self.text, [], 0, False
        spans: list[tuple[int, int]] = []
        carried: list[Value] = []
        terms = 0

        def close() -> None:
            nonlocal spans, carried, terms
            if terms == 1 and carried:
                out.extend(carried)  # another name of the same constant
            elif spans or carried:
                out.append(Value(text, spans, carried))
            spans, carried, terms = [], [], 0

        while True:
            at = (_SPACES if depth else _BLANKS).match(text, at).end()
            c, quote = text[at : at + 1], at
            while quote < at + 2 and text[quote : quote + 1] in _PREFIXES:
                quote += 1
            if quote in self.strings:
                i, j, at = self.strings[quote]
                if not (called and _NO_DIGIT.match(text, i, j)):  # arguments without a digit are names of settings
                    spans.append((i, j))
                terms += 1
            elif c and c in "([":
                depth, at = depth + 1, at + 1
                continue
            elif c and c in ")]" and depth:
                depth, at = depth - 1, at + 1
            elif c == "," and depth:
                close()
                at += 1
                continue
            elif m := _NAME.match(text, at):
                name, end = m[0].lstrip("$@"), m.end()
                while known := self.subscript(end):
                    name, end = f"{name}.{known[0]}", known[1]
                if name in constants:
                    carried = carried + constants[name]
                elif text[end : end + 1] == "(":
                    depth, at, called = depth + 1, end + 1, True
                    continue
                elif not (depth or terms or end > m.end() or c in "$@"):
                    end = _BARE.match(text, at).end()
                    if not _NO_DIGIT.match(text, at, end):
                        spans.append((at, end))
                terms, at = terms + 1, end
            elif not depth and (m := _BARE.match(text, at)):
                spans.append(m.span())
                terms, at = terms + 1, m.end()
            else:
                break
            if j := _JOIN.match(text, at):
                at = j.end()
                continue
            at = (_SPACES if depth else _BLANKS).match(text, at).end()
            if not (depth and text[at : at + 1] in (")", "]", ",") or terms and at in self.strings):
                break
        close()
        return out


def lexed_spans(text: str, least: float = LEAST_SCORE) -> list[Span]:
    """Literals that reach a sensitive name, directly, through a named constant or in a sum."""
    constants: dict[str, list[Value]] = {}
    found: set[tuple[int, int]] = set()
    annotated: dict[int, str] = {}
    lexed = Lexed(text)

    def assign(name: str, values: list[Value], more: bool = False) -> None:
        if more and name in constants:
            values = [Value(text, [], constants[name] + values)]
        constants[name] = values
        if score := name_score(name):
            for v in values:
                if score * v.score(text) >= least:
                    found.update((i, j) for i, j in v.tell() if j > i)

    for start, end, operator in lexed.operators:
        name = annotated.pop(start, None) or lexed.target(start)
        if not name:
            continue
        if operator == ":" and (m := _ANNOTATED.match(text, end)):
            annotated[m.end()] = name
        elif values := lexed.values(end, constants):
            assign(name, values, operator == "+=")
    if "</" in text:
        for m in _ELEMENT.finditer(text):
            assign(m[1], [Value(text, [m.span(2)], [])])
    return [("lex", i, j, i, j) for i, j in sorted(found)]


def all_spans(text: str | None) -> list[Span]:
    if not text:
        return []
    out = base_spans(text)
    if "=" in text or ":" in text or "</" in text:
        out += lexed_spans(text)
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """text with each secret replaced by mark; overlapping ones become one."""
    if not (spans := all_spans(text)):
        return text
    parts, at, upto = [], 0, -1
    for i, j in sorted((s[3], s[4]) for s in spans):
        if i >= upto:
            parts += [text[at:i] if upto < 0 else text[upto:i], mark]
            upto = j
        upto = max(upto, j)
    return "".join([*parts, text[upto:]])


def secret_spans(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, spans array of (kind, start, end, secret_start, secret_end) in code points, end exclusive."""
    rows = pick(docs, "doc_id", "text")
    kind = pa.struct([("kind", pa.string()), *((k, pa.int64()) for k in ("start", "end", "secret_start", "secret_end"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            spans = [[dict(zip(("kind", "start", "end", "secret_start", "secret_end"), s, strict=True)) for s in all_spans(t)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, pa.list_(kind))], names=["doc_id", "spans"])

    return rows.mapInArrow(run, extended(rows.select("doc_id").schema, "spans array<struct<kind:string,start:long,end:long,secret_start:long,secret_end:long>>"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs, all columns and rows, with the secrets in text replaced and n_chars counted anew."""

    columns = docs.columns
    rows = docs.toDF(*[f"_c{i}" for i in range(len(columns))])  # names that can't hold dots
    text, size = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, f"_c{text}"):
            old = b.column(text).to_pylist()
            new = [redact(t) for t in old]
            b = b.set_column(text, b.schema.field(text), pa.array(new, b.schema.field(text).type))
            if size is not None:
                counts = [n if o == t else len(t) for n, o, t in zip(b.column(size).to_pylist(), old, new, strict=True)]
                b = b.set_column(size, b.schema.field(size), pa.array(counts, b.schema.field(size).type))
            yield b

    return rows.mapInArrow(run, rows.schema).toDF(*columns)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


def secret_digest(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    rows = pick(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            every = [all_spans(t) for t in b.column("text").to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in spans) for spans in every], pa.int64()) for k in KINDS[:3]]
            base = pa.array([hashlib.sha256(joined([s for s in spans if s[0] != "lex"]).encode()).hexdigest() for spans in every])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, base, pa.array(map(joined, every), pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return rows.mapInArrow(run, extended(rows.select("doc_id").schema, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(table(spark, sf_dir, "documents"))


def base_sql() -> str:
    """doc_id, the counts and the digest of the fixed forms, by the lengths of what stands between their matches."""
    either = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    words = "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key")))
    quote = "[\"'']?"
    forms = [("assign", f"({words}){quote}\\x20*[:=]\\x20*{quote}([A-Za-z0-9+/_.=-]+)", 2, 12), ("access", "AKIA[A-Z0-9]{14,}", 0, 18), ("hex", "[0-9a-f]{16,}", 0, 16)]
    found = " UNION ALL ".join(
        f"SELECT r, {k} AS o, '{kind}' AS kind, k, gaps, hits, secrets FROM (SELECT r, regexp_split_to_array(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS hits, regexp_extract_all(t, '{p}', {g}) AS secrets, "
        f"unnest(range(1, len(regexp_extract_all(t, '{p}')) + 1)) AS k FROM d) WHERE length(secrets[k]) >= {n}"
        for k, (kind, p, g, n) in enumerate(forms)
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({found}),
spans AS (SELECT r, o, kind, CAST(list_sum(list_transform(gaps[:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[:k - 1], lambda x: length(x))), 0) AS BIGINT) AS a, length(hits[k]) AS n FROM found),
per AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, o) AS joined FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(joined, '')) AS base_sha256
FROM d LEFT JOIN per USING (r)"""
