"""The confirming scan: texts become lines, lines become matches, spans, contexts, counts and totals."""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F

from trawl.functions.pattern import Pattern
from trawl.plans.trigrams import Query
from trawl.schemas import SPANS

NUL_PROBE = 8192


def looks_binary(content: Column) -> Column:
    """A NUL within the first bytes."""
    return F.contains(F.substring(content, 1, NUL_PROBE), F.lit(bytearray(1)))


def text_of(content: Column) -> Column:
    return F.make_valid_utf8(content.cast("string"))


def may_match(content: Column, query: Query) -> Column:
    """The planner's condition on the text itself: a cheap filter ahead of the regular expression."""
    return query.column(lambda tri: F.contains(content, F.lit(bytearray(tri.to_bytes(3, "big")))))


def let(value: Column, use) -> Column:
    """use(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def line_array(text: Column) -> Column:
    """The lines of a text, split at \\n only; an empty last one isn't a line."""

    def cut(t: Column) -> Column:
        whole = F.when(t.endswith("\n"), F.substring(t, F.lit(1), F.char_length(t) - 1)).otherwise(t)
        return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(whole, "\n", -1))

    return let(text, cut)


def to_lines(corpus: DataFrame) -> DataFrame:
    """path, line_number from 1, line, is_last."""
    arrays = corpus.select("path", line_array(text_of(F.col("content"))).alias("lines"))
    rows = arrays.select("path", F.size("lines").alias("n"), F.posexplode("lines").alias("at", "line"))
    return rows.select("path", (F.col("at") + 1).cast("long").alias("line_number"), "line", (F.col("at") + 1 == F.col("n")).alias("is_last"))


def line_matches(pattern: Pattern, line: Column, number: Column | None = None, is_last: Column | None = None) -> Column:
    """Whether the line matches; what Java would overflow its stack on goes to a vectorised UDF."""
    if pattern.fixed is not None:
        return F.contains(line, F.lit(pattern.fixed)) if "\n" not in pattern.fixed else F.lit(False)

    def test(first: bool, last: bool) -> Column:
        if not pattern.in_python:
            return line.rlike(pattern.java(first, last))
        form = pattern.python(first, last)

        @F.pandas_udf("boolean")
        def found(lines: pd.Series) -> pd.Series:
            search = regex.compile(form).search
            return lines.map(lambda x: None if x is None else search(x) is not None)

        return found(line)

    if not (pattern.at_text_start or pattern.at_text_end):
        return test(True, True)
    out = test(False, False)
    if pattern.at_text_end:
        out = F.when(is_last, test(False, True)).otherwise(out)
    if pattern.at_text_start:
        inner = F.when(is_last, test(True, True)).otherwise(test(True, False)) if pattern.at_text_end else test(True, False)
        out = F.when(number == 1, inner).otherwise(out)
    return out


def spans_of(pattern: Pattern, line: Column, number: Column, is_last: Column) -> Column:
    """Byte offsets [start, end) of the matches in the line, in order, empty ones left out."""
    if not (pattern.empty or pattern.in_python or pattern.at_text_start or pattern.at_text_end):
        form = pattern.java()
        gaps, found = F.split(line, form, -1), F.regexp_extract_all(line, F.lit(form), F.lit(0))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))

        def step(a: Column, x: Column) -> Column:
            start = a["at"] + F.octet_length(x["gap"])
            end = start + F.octet_length(x["found"])
            return F.struct(end.alias("at"), F.concat(a["spans"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("spans"))

        pairs = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("found"))
        return F.aggregate(pairs, zero, step, lambda a: a["spans"])
    forms = {(f, e): pattern.python(f, e) for f in (True, False) for e in (True, False)}

    @F.pandas_udf(SPANS)
    def spans(lines: pd.Series, numbers: pd.Series, lasts: pd.Series) -> pd.Series:
        ready = {k: regex.compile(v) for k, v in forms.items()}

        def one(text: str, n: int, last: bool) -> list[dict]:
            out, at, byte = [], 0, 0
            for m in ready[n == 1, bool(last)].finditer(text):
                byte += len(text[at : m.start()].encode())
                end = byte + len(m[0].encode())
                if m.end() > m.start():
                    out.append({"start": byte, "end": end})
                at, byte = m.end(), end
            return out

        return pd.Series([one(*x) for x in zip(lines, numbers, lasts, strict=True)])

    return spans(line, number, is_last)


def _marked(lines: Column, pattern: Pattern) -> Column:
    """Of each line: line_number, line, is_last, hit."""

    def plain(x: Column, i: Column, n: Column, hit: Column) -> Column:
        return F.struct((i + 1).cast("long").alias("line_number"), x.alias("line"), (i + 1 == n).alias("is_last"), hit.alias("hit"))

    if not pattern.in_python:
        return let(lines, lambda a: F.transform(a, lambda x, i: plain(x, i, F.size(a), line_matches(pattern, x, i + 1, i + 1 == F.size(a)))))
    forms = {(f, e): pattern.python(f, e) for f in (True, False) for e in (True, False)}

    @F.pandas_udf("array<boolean>")
    def found(texts: pd.Series) -> pd.Series:
        ready = {k: regex.compile(v).search for k, v in forms.items()}
        return texts.map(lambda a: [ready[k == 0, k == len(a) - 1](x) is not None for k, x in enumerate(a)])

    hits = found(lines)
    return F.transform(F.arrays_zip(lines.alias("line"), hits.alias("hit")), lambda s, i: plain(s["line"], i, F.size(lines), s["hit"]))


def _exploded(corpus: DataFrame, structs: Column) -> DataFrame:
    """A row for each struct. The outer form keeps the optimizer from testing the array below, where it would be made again."""
    return corpus.select("path", F.explode_outer(structs).alias("_s")).where("_s is not null").select("path", "_s.*")


def _split(corpus: DataFrame) -> Column:
    return line_array(text_of(F.col("content")))


def matching_lines(corpus: DataFrame, pattern: Pattern, max_count: int | None = None) -> DataFrame:
    """path, line_number, line, is_last of the matching lines, at most max_count of a text, in order of their numbers."""
    hits = F.filter(_marked(_split(corpus), pattern), lambda s: s["hit"])
    if max_count is not None:
        hits = F.slice(hits, 1, max_count)
    return _exploded(corpus, hits).drop("hit")


def line_numbers(corpus: DataFrame, tests: list[tuple[str, Pattern, Column]]) -> DataFrame:
    """name, path, numbers: of each text the lines that match, for each (name, pattern, condition on the text); texts are split once.

    Not for patterns that go to Python.
    """
    flags = {f"_{k}": condition for k, (_, _, condition) in enumerate(tests)}

    def each(lines: Column, k: int, name: str, pattern: Pattern) -> Column:
        hit = lambda x, i: F.when(line_matches(pattern, x, i + 1, i + 1 == F.size(lines)), (i + 1).cast("long"))
        numbers = F.when(F.col(f"_{k}"), F.filter(F.transform(lines, hit), lambda n: n.isNotNull()))
        return F.struct(F.lit(name).alias("name"), numbers.alias("numbers"))

    structs = let(_split(corpus), lambda lines: F.array(*[each(lines, k, name, p) for k, (name, p, _) in enumerate(tests)]))
    wanted = corpus.select("path", "content", *[c.alias(n) for n, c in flags.items()]).where(" OR ".join(flags))
    return _exploded(wanted, structs).where("size(numbers) > 0").select("name", "path", "numbers")


def with_spans(hits: DataFrame, pattern: Pattern) -> DataFrame:
    return hits.withColumn("spans", spans_of(pattern, F.col("line"), F.col("line_number"), F.col("is_last")))


def with_context(corpus: DataFrame, pattern: Pattern, before: int, after: int, max_count: int | None = None) -> DataFrame:
    """Matching lines and their neighbours: is_match, and group_id, which grows at each gap.

    A line past the cap that would match is a neighbour. All is done in the row of the text, without a shuffle.
    """

    def groups(lines: Column) -> Column:
        every = F.transform(F.filter(lines, lambda s: s["hit"]), lambda s: s["line_number"])
        return let(every if max_count is None else F.slice(every, 1, max_count), lambda at: spread(lines, at))

    def spread(lines: Column, at: Column) -> Column:
        apart = lambda p, q: q - before > p + after + 1
        heads = F.filter(at, lambda p, j: (j == 0) | apart(F.get(at, j - 1), p))
        tails = F.filter(at, lambda p, j: (j == F.size(at) - 1) | apart(p, F.get(at, j + 1)))
        last = F.element_at(at, -1)
        ranges = F.zip_with(heads, tails, lambda h, t: F.struct(F.greatest(h - before, F.lit(1)).alias("low"), F.least(t + after, F.size(lines)).alias("high")))
        return F.transform(ranges, lambda r, g: F.transform(F.slice(lines, r["low"].cast("int"), (r["high"] - r["low"] + 1).cast("int")), lambda s: F.struct(
            s["line_number"].alias("line_number"), s["line"].alias("line"), (s["hit"] & (s["line_number"] <= last)).alias("is_match"), g.cast("long").alias("group_id"))))

    return _exploded(corpus, F.flatten(let(_marked(_split(corpus), pattern), groups)))


def match_counts(corpus: DataFrame, pattern: Pattern, max_count: int | None = None) -> DataFrame:
    """Matching lines per text; texts without any are absent."""
    n = F.size(F.filter(_marked(_split(corpus), pattern), lambda s: s["hit"])).cast("long")
    # counted in an exploded array of one, so that the filter below doesn't count once more
    counts = corpus.select("path", F.explode_outer(F.array(n if max_count is None else F.least(n, F.lit(max_count).cast("long")))).alias("matches"))
    return counts.where("matches > 0")


def files_with_matches(corpus: DataFrame, pattern: Pattern) -> DataFrame:
    """Paths with a match, without making rows of their lines."""
    if pattern.in_python:
        return match_counts(corpus, pattern).select("path")
    test = let(_split(corpus), lambda a: F.exists(F.transform(a, lambda x, i: line_matches(pattern, x, i + 1, i + 1 == F.size(a))), lambda hit: hit))
    if not (pattern.at_text_start or pattern.at_text_end):
        test = F.exists(_split(corpus), lambda x: line_matches(pattern, x))
    return corpus.where(test).select("path")


def totals(counts: DataFrame) -> DataFrame:
    """Of match_counts(): matched_lines, matched_files."""
    return counts.agg(F.coalesce(F.sum("matches"), F.lit(0)).alias("matched_lines"), F.count("*").alias("matched_files"))


def json_lines(hits: DataFrame) -> DataFrame:
    """One JSON object a matching line: path, line, text, spans."""
    spans = F.transform("spans", lambda s: F.array(s["start"], s["end"]))
    return hits.select("path", "line_number", F.to_json(F.struct("path", F.col("line_number").alias("line"), F.col("line").alias("text"), spans.alias("spans"))).alias("json"))


def highlighted(line: str, spans: list, on: str = "\x1b[30;43m", off: str = "\x1b[0m") -> str:
    """The line with its byte spans marked."""
    raw, out, at = line.encode(), b"", 0
    for s in spans:
        out += raw[at : s["start"]] + on.encode() + raw[s["start"] : s["end"]] + off.encode()
        at = s["end"]
    return (out + raw[at:]).decode("utf-8", "replace")


