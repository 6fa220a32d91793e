"""Search: a pattern over a corpus, with or without an index.

With an index only its candidates are read: from its own texts if it keeps them (a search then sees
the corpus as it was at the last refresh), else by the corpus's reader of named paths. Where
neither is at hand, or the candidates are too many to narrow anything, the corpus is scanned, and
the planner's condition is put to the texts themselves. The lines found are the same.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from trawl.functions.paths import in_scopes, of_types, passes_globs
from trawl.functions.pattern import Pattern, compile_pattern
from trawl.operators import lines as L
from trawl.operators.index import CorpusIndex, candidates, one_of
from trawl.plans.trigrams import plan
from trawl.schemas import BINARY, SCAN_ALWAYS

#: Most paths that are given to a reader one by one.
MOST_PATHS = 20_000


@dataclass(frozen=True)
class Options:
    ignore_case: bool = False
    fixed: bool = False
    scopes: tuple[str, ...] = ()
    globs: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    not_types: tuple[str, ...] = ()
    max_count: int | None = None
    before: int = 0
    after: int = 0
    extra_types: dict = field(default_factory=dict)

    def accepts(self, path: Column) -> Column:
        from trawl.functions.paths import TYPES

        return in_scopes(path, list(self.scopes)) & passes_globs(path, list(self.globs)) & of_types(path, list(self.types), list(self.not_types), TYPES | self.extra_types)


class Search:
    """One compiled search; its results are DataFrames."""

    def __init__(self, corpus: DataFrame, pattern: str, options: Options | None = None, index: CorpusIndex | None = None, read: Callable[[list[str]], DataFrame] | None = None):
        """read gives the rows of named paths; without it, an index that keeps no texts narrows nothing."""
        self.options = options or Options()
        self.pattern: Pattern = compile_pattern(pattern, self.options.ignore_case, self.options.fixed)
        self.query = plan(self.pattern)
        self.index, self.read = index, read
        self.corpus = corpus

    def explain(self) -> str:
        return str(self.query)

    def candidates(self) -> DataFrame:
        """Paths that the index lets through, those always scanned among them."""
        files = self.index.files().where((F.col("flags").bitwiseAND(BINARY) == 0) & self.options.accepts(F.col("path")))
        if self.query.kind == "all":
            return files.select("path")
        always = F.col("flags").bitwiseAND(SCAN_ALWAYS) != 0
        hits = files.where(~always).join(candidates(self.index.postings(), self.query), "file_id", "left_semi")
        return hits.select("path").unionByName(files.where(always).select("path"))

    def _lookup(self) -> list[int] | None:
        """What the index leaves of the corpus, where that is less."""
        return self.index.lookup(self.query) if self.index is not None and (self.index.keep_texts or self.read) else None

    def _narrowed(self) -> DataFrame:
        """The corpus, or what the index leaves of it."""
        return self._texts(self._lookup())

    def _texts(self, ids: list[int] | None) -> DataFrame:
        if self.index is not None and self.index.keep_texts:
            return self.index.all_texts() if ids is None else self.index.texts_of(ids)
        if ids is None:
            return self.corpus
        files = self.index.files().where(one_of(F.col("file_id"), ids) | (F.col("flags") == SCAN_ALWAYS))
        wanted = [r.path for r in files.where(self.options.accepts(F.col("path"))).select("path").limit(MOST_PATHS + 1).collect()]
        return self.read(wanted) if len(wanted) <= MOST_PATHS else self.corpus

    def targets(self) -> DataFrame:
        """The texts to scan, and what the planner's condition leaves of them."""
        return self._narrowed().where(self._condition())

    def _condition(self) -> Column:
        content = F.col("content")
        return self.options.accepts(F.col("path")) & L.may_match(content, self.query) & ~L.looks_binary(content)

    def _hits(self) -> DataFrame:
        return L.matching_lines(self.targets(), self.pattern, self.options.max_count)

    def lines(self) -> DataFrame:
        """path, line_number, line of the matching lines."""
        return self._hits().select("path", "line_number", "line")

    def spans(self) -> DataFrame:
        """The same with spans, an array of byte offsets."""
        return L.with_spans(self._hits(), self.pattern).select("path", "line_number", "line", "spans")

    def context(self) -> DataFrame:
        """Matching lines and their neighbours: path, line_number, line, is_match, group_id."""
        o = self.options
        out = L.with_context(self.targets(), self.pattern, o.before, o.after, o.max_count)
        return out.select("path", "line_number", "line", "is_match", "group_id")

    def files(self) -> DataFrame:
        """Paths with a match, whatever max_count is."""
        return L.files_with_matches(self.targets(), self.pattern)

    def counts(self) -> DataFrame:
        return L.match_counts(self.targets(), self.pattern, self.options.max_count)

    def totals(self) -> DataFrame:
        return L.totals(self.counts())

    def json(self) -> DataFrame:
        return L.json_lines(self.spans())

    def top(self, n: int) -> DataFrame:
        """The first n matching lines by path and number."""
        return self.lines().orderBy("path", "line_number").limit(max(1, n))

    def stats(self) -> DataFrame:
        """One row: plan, files in the index, candidates, matched files and lines."""
        files, found = self.index.files().agg(F.count("*").alias("files_in_index")), self.candidates().agg(F.count("*").alias("candidates"))
        return files.crossJoin(found).crossJoin(self.totals()).select(F.lit(str(self.query)).alias("plan"), "*")  # one row each


def numbered(searches: dict[str, Search]) -> DataFrame:
    """name, path, numbers: a row for each search and text with a match. Searches that an index doesn't narrow share one pass over their texts.

    Options' max_count is not looked at.
    """
    passes: dict[object, tuple[DataFrame, list]] = {}
    out = []
    for name, s in searches.items():
        ids = s._lookup()
        if s.pattern.in_python:
            lines = L.matching_lines(s._texts(ids).where(s._condition()), s.pattern)
            out.append(lines.select(F.lit(name).alias("name"), "path", F.array("line_number").alias("numbers")))
            continue
        key = name if ids is not None else (id(s.index), id(s.corpus))
        passes.setdefault(key, (s._texts(ids), []))[1].append((name, s.pattern, s._condition()))
    out += [L.line_numbers(texts, tests) for texts, tests in passes.values()]
    return reduce(DataFrame.unionByName, out)


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """name, path, line_number that only one of two results of numbered() has, as often as it has it more; texts that agree stay whole."""
    both = a.withColumn("n", F.lit(1)).unionByName(b.withColumn("n", F.lit(-1)))
    texts = both.groupBy("name", "path", "numbers").agg(F.sum("n").alias("n")).where("n <> 0")
    lines = texts.select("name", "path", F.explode("numbers").alias("line_number"), "n").groupBy("name", "path", "line_number").agg(F.sum("n").alias("n")).where("n <> 0")
    return lines.select("name", "path", "line_number", F.explode(F.sequence(F.lit(1), F.abs("n"))).alias("_")).drop("_")
