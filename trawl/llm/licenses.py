"""License scans: an exact set-similarity join of text blocks with license templates.

Blocks are lines, and windows of words as long as a template, whatever lines they lie in, so that
wrapped notices, and several in one line, are found. A block fits a template when it holds at least THRESHOLD of the template's
distinct words. Words are ordered by how rarely they occur in the whole corpus; a block is a
candidate only if it holds a word of the template's prefix (prefix filter), has enough words
(length filter) and enough of the ordered words remain after the first common one (positional
filter). Candidates are counted exactly, so the result is that of comparing all blocks with all
templates. A line is labelled after the fitting templates that it holds the largest share of; a
window after its template, unless more than half of the words it shares with it lie in windows
that fit others better. Beside these labels, fits names every template that any block fits. The templates are the bounded side: TEMPLATES, or what the caller passes.

Beside that stand the fixed phrases of PHRASES, whose words must follow one another.

Words are the matches of WORD after lower-casing A-Z. Null texts are empty; texts without words
have no places and no labels. Rows are independent: repeated rows, null doc_ids and extra columns
change nothing, and an empty table gives an empty result. Labels are distinct, sorted and joined by
commas, empty if there is none.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from trawl.llm.license_texts import TEMPLATES
from trawl.llm.shared import chunks, extended, pick, table

THRESHOLD = 0.8
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrase -> label.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# on UTF-8 with A-Z lower-cased: digits, a-z and every byte of other characters
_TOKENS = re.compile(rb"[0-9a-z\x80-\xff]+").findall


def tokens(text: str | None) -> list[bytes]:
    return _TOKENS(text.encode().lower()) if text else []


def phrase_places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    out, n = [], len(phrase)
    if phrase[-1] in words and phrase[0] in words:
        k = -1
        while True:
            try:
                k = words.index(phrase[0], k + 1)
            except ValueError:
                return out
            if words[k : k + n] == phrase:
                out.append(k)
    return out


class Templates:
    """The templates' words by rising frequency, their prefixes, and what each needs."""

    def __init__(self, templates: list[tuple[str, str]], counts: dict[bytes, int], threshold: float):
        self.order = {w: k for k, w in enumerate(sorted({w for _, t in templates for w in tokens(t)}, key=lambda w: (counts.get(w, 0), w)))}
        self.sets, self.lengths, self.index = [], [], {}
        for label, text in templates:
            if words := sorted(set(tokens(text)), key=self.order.__getitem__):
                need = math.ceil(threshold * len(words) - 1e-9)
                for i, w in enumerate(words[: len(words) - need + 1]):
                    self.index.setdefault(w, []).append((len(self.sets), i))
                self.sets.append((label, frozenset(words), len(words), need))
                self.lengths.append(len(tokens(text)))
        self.keys = frozenset(self.index)

    def fits(self, block: list[bytes]) -> list[tuple[str, float]]:
        """(label, containment) of the templates that the block's words fit."""
        every = set(block)
        have = sorted((w for w in every if w in self.order), key=self.order.__getitem__)
        tried, out = set(), []
        for j, w in enumerate(have):
            for k, i in self.index.get(w, ()):
                label, words, size, need = self.sets[k]
                if k in tried or len(every) < need or 1 + min(size - i - 1, len(have) - j - 1) < need:
                    continue
                tried.add(k)
                if (common := len(words.intersection(have))) >= need:
                    out.append((label, common / size))
        return out

    def windows(self, words: list[bytes]) -> tuple[list[tuple[str, float]], set[str]]:
        """(label, containment) of the templates that windows of their length fit, best fits first; and all labels that fit."""
        places: dict[bytes, list[int]] = {}
        for at, w in enumerate(words):
            if w in self.order:
                places.setdefault(w, []).append(at)
        tried = {k for w in self.keys.intersection(places) for k, _ in self.index[w]}
        found = []
        for k in sorted(tried):
            _, every, size, need = self.sets[k]
            if sum(w in places for w in every) < need:
                continue
            hits = sorted((at, w) for w in every for at in places.get(w, ()))
            held: dict[bytes, int] = {}
            first = 0
            for last, (at, w) in enumerate(hits):
                held[w] = held.get(w, 0) + 1
                while hits[first][0] <= at - self.lengths[k]:
                    out = hits[first][1]
                    held[out] -= 1
                    if not held[out]:
                        del held[out]
                    first += 1
                if len(held) >= need:
                    found.append((len(held) / size, k, [h[0] for h in hits[first : last + 1]]))
        found.sort(key=lambda f: -f[0])
        best: dict[int, float] = {}
        out = []
        for share, k, at in found:
            if 2 * sum(best.get(i, 0.0) > share for i in at) <= len(at):
                out.append((self.sets[k][0], share))
                for i in at:
                    best.setdefault(i, share)
        return out, {self.sets[k][0] for _, k, _ in found}


def template_counts(docs: DataFrame, templates: list[tuple[str, str]]) -> dict[bytes, int]:
    """How often each template word occurs in the corpus; as many rows as the templates have words."""
    vocabulary = frozenset(w for _, t in templates for w in tokens(t))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = dict.fromkeys(vocabulary, 0)
        for b in batches:
            for t in b.column("text").to_pylist():
                for w in filter(vocabulary.__contains__, tokens(t)):
                    counts[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array(counts, pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    return {bytes(r.word): r.n for r in pick(docs, "text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, fits.

    score is the highest containment of a fitting template, 1 where a phrase stands, 0 without labels.
    """
    known = Templates(templates, template_counts(docs, templates), threshold)
    sought = [(p.encode().split(), label) for p, label in phrases.items()]
    rows = pick(docs, "doc_id", "text")

    def scan(text: str | None) -> tuple:
        words = tokens(text)
        places, base, labels, every, score = [], set(), set(), set(), 0.0
        for phrase, label in sought:
            if found := phrase_places(words, phrase):
                places += found
                base.add(label)
                score = 1.0
        if not known.keys.isdisjoint(words):
            for line in text.split("\n"):
                block = tokens(line)
                if not known.keys.isdisjoint(block):
                    fits = known.fits(block)
                    every.update(label for label, _ in fits)
                    most = max((share for _, share in fits), default=0.0)
                    labels.update(label for label, share in fits if share == most)
                    score = max(score, most)
            best, more = known.windows(words)
            every |= more
            for label, share in best:
                labels.add(label)
                score = max(score, share)
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score, ",".join(sorted(every))

    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "fits"]
    kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            columns = zip(*map(scan, b.column("text").to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", *names])

    return rows.mapInArrow(run, extended(rows.select("doc_id").schema, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, fits string"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle_sql() -> str:
    """The same by comparing every line with every template; windows over lines are not in it."""
    words = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    phrases = ", ".join(f"({_sql_text(p)}, {_sql_text(x)}, {len(p.split())})" for p, x in PHRASES.items())
    templates = ", ".join(f"({_sql_text(label)}, {_sql_text(text)})" for label, text in TEMPLATES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {low.format("coalesce(text, '')")} AS t FROM documents),
w AS (SELECT r, doc_id, t, {words.format("t")} AS ws FROM d),
p(phrase, label, n) AS (VALUES {phrases}),
places AS (
  SELECT r, label, i - 1 AS place FROM (SELECT r, label, phrase, n, ws, unnest(range(1, len(ws) - n + 2)) AS i
    FROM w JOIN p ON contains(t, string_split(phrase, ' ')[1]) AND contains(t, string_split(phrase, ' ')[n]))
  WHERE array_to_string(ws[i:i + n - 1], ' ') = phrase),
base AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS ls FROM places GROUP BY r),
tp(label, words) AS (SELECT label, list_distinct({words.format(low.format("text"))}) FROM (VALUES {templates}) v(label, text)),
lines AS (SELECT r, row_number() OVER () AS l, list_distinct({words.format("line")}) AS b FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)),
fits AS (
  SELECT r, l, label, len(list_intersect(b, words)) / len(words) AS share FROM lines JOIN tp ON list_has_any(b, words)
  WHERE len(list_intersect(b, words)) >= ceil({THRESHOLD} * len(words) - 1e-9)),
best AS (SELECT * FROM fits QUALIFY share = max(share) OVER (PARTITION BY l)),
found AS (SELECT r, list(DISTINCT label) AS ls, max(share) AS score FROM best GROUP BY r),
every AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS fits FROM fits GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  array_to_string(list_sort(coalesce(base.ls, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.ls, []), coalesce(found.ls, [])))), ',') AS labels,
  CAST(CASE WHEN base.r IS NOT NULL THEN 1.0 ELSE coalesce(score, 0) END AS DOUBLE) AS score,
  coalesce(every.fits, '') AS fits
FROM w LEFT JOIN base USING (r) LEFT JOIN found USING (r) LEFT JOIN every USING (r)"""
