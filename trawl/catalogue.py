"""The search queries by name, and the same as DuckDB SQL. Every query runs over whole tables."""

from __future__ import annotations

import os
import tempfile
from functools import partial
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from trawl.operators.index import CorpusIndex, changes, classified, extract, text_trigrams
from trawl.operators.search import Options, Search, differing, numbered
from trawl.schemas import FILES
from trawl.sources.corpus import from_table, from_tree
from trawl.sources.scratch import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths are lang/source/doc_id."""
    return from_table(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.concat_ws("/", "lang", "source", "doc_id"), "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_table(spark.read.parquet(f"{sf_dir}/pages.parquet"), F.concat(F.lit("pages/"), F.col("page_id")), "html")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_table(spark.read.parquet(f"{sf_dir}/conversations.parquet"), F.concat_ws("/", F.lit("conversations"), "conv_id", "turn"), "text")


def built(spark: SparkSession, corpus: DataFrame, **options) -> CorpusIndex:
    index = CorpusIndex(spark, scratch(spark), keep_texts=True)
    index.build(corpus, **options)
    return index


_DOCS = "SELECT concat_ws('/', lang, source, doc_id) AS path, text FROM documents WHERE text IS NOT NULL"
_PAGES = "SELECT 'pages/' || page_id AS path, html AS text FROM pages WHERE html IS NOT NULL"
_TALKS = "SELECT concat_ws('/', 'conversations', conv_id, turn) AS path, text FROM conversations WHERE text IS NOT NULL"


def _lines(corpus: str = _DOCS) -> str:
    """corpus and lines, to go on from."""
    return f"""WITH corpus AS ({corpus}),
split AS (SELECT path, CASE WHEN text = '' THEN [] WHEN suffix(text, chr(10)) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS ls FROM corpus),
lines AS (SELECT path, CAST(unnest(range(1, len(ls) + 1)) AS BIGINT) AS line_number, unnest(ls) AS line FROM split)"""


def query(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _line_query(name: str, pattern: str, test: str, options: Options | None = None) -> None:
    QUERIES[name] = lambda spark, d: Search(documents(spark, d), pattern, options).lines()
    ORACLES[name] = f"{_lines()} SELECT path, line_number, line FROM lines WHERE {test}"


_line_query("lines_literal", "License", "contains(line, 'License')")
_line_query("lines_regex", "[0-9]{3}-[0-9]{4}", "regexp_matches(line, '[0-9]{3}-[0-9]{4}')")
_line_query("lines_ci", "license", "regexp_matches(line, '(?i)licen[sſ]e')", Options(ignore_case=True))
_line_query("lines_fixed", ". The ", "contains(line, '. The ')", Options(fixed=True))
_line_query("lines_anchored", "^The", "starts_with(line, 'The')")
_line_query("lines_end", r"ly\.$", r"regexp_matches(line, 'ly\.$')")
_line_query("lines_alternation", "License|rights reserved|example", "regexp_matches(line, 'License|rights reserved|example')")
_line_query("lines_class", "@[a-z]+", "regexp_matches(line, '@[a-z]+')")
_line_query("lines_repetition", "(?:er){3,}", "regexp_matches(line, '(er){3,}')")
_line_query("lines_word", r"\bthan\b", r"regexp_matches(line, '(^|[^\pL\pM\p{Nd}\p{Pc}])than($|[^\pL\pM\p{Nd}\p{Pc}])')")
_line_query("lines_unicode", r"^\p{Lu}\p{Ll}*é", r"regexp_matches(line, '^\p{Lu}\p{Ll}*é')")
_line_query("lines_no_match", "zzqqxx_does_not_exist", "false")


@query(f"{_lines()} SELECT DISTINCT path FROM lines WHERE contains(line, 'that')")
def files_with_matches(spark: SparkSession, d: str) -> DataFrame:
    return Search(documents(spark, d), "that").files()


@query(f"{_lines()} SELECT path, count(*) AS matches FROM lines WHERE contains(line, 'that') GROUP BY path")
def match_counts(spark: SparkSession, d: str) -> DataFrame:
    return Search(documents(spark, d), "that").counts()


@query(f"{_lines()} SELECT path, line_number, line FROM lines WHERE contains(line, 'the') QUALIFY row_number() OVER (PARTITION BY path ORDER BY line_number) <= 2")
def max_count(spark: SparkSession, d: str) -> DataFrame:
    return Search(documents(spark, d), "the", Options(max_count=2)).lines()


def _context_sql(before: int, after: int, cap: int | None = None) -> str:
    hit = "contains(line, 'that')"
    capped = hit if cap is None else f"({hit} AND sum(CAST({hit} AS INT)) OVER (PARTITION BY path ORDER BY line_number) <= {cap})"
    return f"""{_lines()},
hits AS (SELECT *, {capped} AS is_match FROM lines),
near AS (SELECT *, max(is_match) OVER (PARTITION BY path ORDER BY line_number ROWS BETWEEN {after} PRECEDING AND {before} FOLLOWING) AS near FROM hits),
gaps AS (SELECT *, coalesce(line_number - lag(line_number) OVER (PARTITION BY path ORDER BY line_number) > 1, false) AS gap FROM near WHERE near)
SELECT path, line_number, line, is_match, CAST(sum(CAST(gap AS INT)) OVER (PARTITION BY path ORDER BY line_number) AS BIGINT) AS group_id FROM gaps"""


@query(_context_sql(0, 2))
def context_after(spark: SparkSession, d: str) -> DataFrame:
    return Search(documents(spark, d), "that", Options(after=2)).context()


@query(_context_sql(2, 0))
def context_before(spark: SparkSession, d: str) -> DataFrame:
    return Search(documents(spark, d), "that", Options(before=2)).context()


@query(_context_sql(1, 3))
def context_both(spark: SparkSession, d: str) -> DataFrame:
    return Search(documents(spark, d), "that", Options(before=1, after=3)).context()


@query(_context_sql(1, 1, 2))
def context_capped(spark: SparkSession, d: str) -> DataFrame:
    return Search(documents(spark, d), "that", Options(before=1, after=1, max_count=2)).context()


@query(f"SELECT path, group_id, min(line_number) AS first_line, max(line_number) AS last_line FROM ({_context_sql(1, 1)}) GROUP BY ALL")
def context_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = Search(documents(spark, d), "that", Options(before=1, after=1)).context()
    return rows.groupBy("path", "group_id").agg(F.min("line_number").alias("first_line"), F.max("line_number").alias("last_line"))


_SPANS = f"""{_lines()},
cut AS (SELECT path, line_number, line, string_split(line, 'that') AS gaps FROM lines WHERE contains(line, 'that')),
spans AS (SELECT path, line_number, line, k AS span, CAST(list_sum(list_transform(gaps[:k], lambda g: strlen(g))) + 4 * (k - 1) AS INT) AS "start"
  FROM (SELECT *, unnest(range(1, len(gaps))) AS k FROM cut))"""


@query(f'{_SPANS} SELECT path, line_number, CAST(span AS INT) AS span, "start", CAST("start" + 4 AS INT) AS "end" FROM spans')
def match_spans(spark: SparkSession, d: str) -> DataFrame:
    rows = Search(documents(spark, d), "that").spans()
    return rows.select("path", "line_number", F.posexplode("spans").alias("at", "s")).select("path", "line_number", (F.col("at") + 1).alias("span"), "s.start", "s.end")


@query(f"""{_SPANS},
per_line AS (SELECT path, line_number, any_value(line) AS line, list(["start", "start" + 4] ORDER BY "start") AS spans FROM spans GROUP BY ALL)
SELECT path, line_number, CAST(to_json({{path: path, line: line_number, text: line, spans: spans}}) AS VARCHAR) AS json FROM per_line""")
def json_lines(spark: SparkSession, d: str) -> DataFrame:
    return Search(documents(spark, d), "that").json()


@query(f"{_lines()} SELECT path, line_number, line FROM lines WHERE contains(line, 'the') ORDER BY path, line_number LIMIT 200")
def top_results(spark: SparkSession, d: str) -> DataFrame:
    """The limit is the feature: the first 200 matches."""
    return Search(documents(spark, d), "the").top(200)


@query(f"{_lines()} SELECT count(*) AS matched_lines, count(DISTINCT path) AS matched_files FROM lines WHERE contains(line, 'the')")
def search_totals(spark: SparkSession, d: str) -> DataFrame:
    return Search(documents(spark, d), "the").totals()


@query(f"""{_lines()}, hits AS (SELECT * FROM lines WHERE regexp_matches(line, 'that.*tion'))
SELECT '"hat" "ion" "tha" "tio"' AS plan, (SELECT count(*) FROM corpus) AS files_in_index,
  (SELECT count(*) FROM corpus WHERE contains(text, 'hat') AND contains(text, 'ion') AND contains(text, 'tha') AND contains(text, 'tio')) AS candidates,
  (SELECT count(*) FROM hits) AS matched_lines, (SELECT count(DISTINCT path) FROM hits) AS matched_files""")
def search_stats(spark: SparkSession, d: str) -> DataFrame:
    corpus = documents(spark, d)
    return Search(corpus, "that.*tion", index=built(spark, corpus)).stats()


_TRIGRAMS = f"""WITH corpus AS ({_DOCS}), h AS (SELECT path, hex(encode(text)) AS x FROM corpus),
tris AS (SELECT DISTINCT path, CAST(('0x' || substr(x, 2 * i - 1, 6)) AS INT) AS tri FROM (SELECT path, x, unnest(range(1, CAST(len(x) / 2 AS BIGINT) - 1)) AS i FROM h))"""


@query(f"{_TRIGRAMS} SELECT path, tri FROM tris")
def trigram_extract(spark: SparkSession, d: str) -> DataFrame:
    return text_trigrams(documents(spark, d))


@query(f"{_TRIGRAMS} SELECT count(*) AS postings, count(DISTINCT tri) AS trigrams FROM tris")
def postings_count(spark: SparkSession, d: str) -> DataFrame:
    return extract(classified(documents(spark, d))).agg(F.count("*").alias("postings"), F.count_distinct("tri").alias("trigrams"))


@query(f"{_TRIGRAMS} SELECT tri, count(*) AS files FROM tris GROUP BY tri")
def trigram_df(spark: SparkSession, d: str) -> DataFrame:
    return extract(classified(documents(spark, d))).groupBy("tri").agg(F.count("*").alias("files"))


def _candidate_query(name: str, pattern: str, test: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        corpus = documents(spark, d)
        return Search(corpus, pattern, index=built(spark, corpus)).candidates()

    QUERIES[name] = run
    ORACLES[name] = f"WITH corpus AS ({_DOCS}) SELECT path FROM corpus WHERE {test}"


_candidate_query("candidates_and", "that", "contains(text, 'tha') AND contains(text, 'hat')")
_candidate_query("candidates_or", "the|and", "contains(text, 'the') OR contains(text, 'and')")
_candidate_query("candidates_nested", "that|with (?:the|est)", "(contains(text, 'tha') AND contains(text, 'hat')) OR (contains(text, 'wit') AND contains(text, 'ith') AND contains(text, 'th ') AND ((contains(text, 'h t') AND contains(text, ' th') AND contains(text, 'the')) OR (contains(text, 'h e') AND contains(text, ' es') AND contains(text, 'est'))))")
_candidate_query("candidates_all", "..", "true")
_candidate_query("candidates_none", r"[a&&b]", "false")


@query(f"{_lines()} SELECT path, line_number, line FROM lines WHERE regexp_matches(line, 'that.*License|[0-9]{{3}}-[0-9]{{4}}|reserved')")
def indexed_search(spark: SparkSession, d: str) -> DataFrame:
    corpus = documents(spark, d)
    return Search(corpus, "that.*License|[0-9]{3}-[0-9]{4}|reserved", index=built(spark, corpus)).lines()


@query("SELECT CAST(NULL AS VARCHAR) AS pattern, CAST(NULL AS VARCHAR) AS path, CAST(NULL AS BIGINT) AS line_number WHERE false")
def indexed_equals_scan(spark: SparkSession, d: str) -> DataFrame:
    """Lines that only one of indexed search and full scan finds, over several patterns."""
    corpus = documents(spark, d)
    index = built(spark, corpus)
    patterns = ("License", "(?i)license", "th.t", "that|with", "^The", r"\bou\b", "[éè]re", "tion.*ing", "zzz_no_match_zzz", "abc|abcd|that", "[a-f][a-f]tion", r"\bthat\b.*$", "(?:The|An?) ")
    indexed, scanned = (numbered({p: Search(corpus, p, index=i) for p in patterns}) for i in (index, None))
    return differing(indexed, scanned).withColumnRenamed("name", "pattern")


@query(f"{_lines()} SELECT path, line_number, line FROM lines WHERE contains(line, 'on') AND (starts_with(path, 'de/') OR starts_with(path, 'fr/src1/'))")
def scope_filter(spark: SparkSession, d: str) -> DataFrame:
    return Search(documents(spark, d), "on", Options(scopes=("de", "fr/src1"))).lines()


@query(f"{_lines()} SELECT path, line_number, line FROM lines WHERE contains(line, 'on') AND regexp_matches(path, '^en/[^/]*/[^/]*$') AND NOT regexp_matches(path, '^en/src1[^/]*/')")
def glob_filter(spark: SparkSession, d: str) -> DataFrame:
    return Search(documents(spark, d), "on", Options(globs=("en/*/*", "!en/src1*/**"))).lines()


@query(f"{_lines()} SELECT path, line_number, line FROM lines WHERE contains(line, 'on') AND regexp_matches(path, '0$') AND NOT regexp_matches(path, '00$')")
def type_filter(spark: SparkSession, d: str) -> DataFrame:
    """Types of the caller's own: names that end in 0, but not in 00."""
    own = {"tens": ["*0"], "hundreds": ["*00"]}
    return Search(documents(spark, d), "on", Options(types=("tens",), not_types=("hundreds",), extra_types=own)).lines()


@query(f"{_lines()}, c AS (SELECT path FROM corpus WHERE strlen(text) > 4000 OR (contains(text, 'tha') AND contains(text, 'hat'))) SELECT path FROM c")
def flag_filter(spark: SparkSession, d: str) -> DataFrame:
    """Texts over the cap are always scanned."""
    corpus = documents(spark, d)
    return Search(corpus, "that", index=built(spark, corpus, max_file_size=4000)).candidates()


@query("SELECT * FROM (VALUES ('early', 2), ('edge', 2), ('late', 0), ('plain', 0)) v(path, flags)")
def binary_classify(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql("SELECT * FROM VALUES ('early', concat('a', char(0), 'b')), ('edge', concat(repeat('x', 8191), char(0))), ('late', concat(repeat('x', 8192), char(0))), ('plain', 'text') v(path, text)")
    return classified(from_table(rows, F.col("path"), "text")).select("path", "flags")


@query(f"WITH corpus AS ({_DOCS}) SELECT path, CAST(strlen(text) AS BIGINT) AS size, CASE WHEN strlen(text) > 4000 THEN 1 ELSE 0 END AS flags FROM corpus")
def size_classify(spark: SparkSession, d: str) -> DataFrame:
    return classified(documents(spark, d), 4000).select("path", "size", "flags")


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents and pages; then documents, those of some sources touched, and conversations."""
    docs = documents(spark, d)
    touched = docs.withColumn("mtime", F.when(F.col("path").rlike("/src1[0-9]*/"), F.lit(1)).otherwise(F.col("mtime")))
    return docs.unionByName(pages(spark, d)), touched.unionByName(conversations(spark, d))


@query(f"""WITH old AS ({_DOCS} UNION ALL {_PAGES}), new AS ({_DOCS} UNION ALL {_TALKS})
SELECT coalesce(new.path, old.path) AS path, CASE WHEN new.path IS NULL THEN 'gone' WHEN old.path IS NULL OR regexp_matches(new.path, '/src1[0-9]*/')
  THEN CASE WHEN strlen(new.text) > 9000 THEN 'large' ELSE 'extract' END ELSE 'reuse' END AS action FROM old FULL JOIN new ON old.path = new.path""")
def change_detection(spark: SparkSession, d: str) -> DataFrame:
    old, new = _snapshots(spark, d)
    return changes(new, classified(old, 9000).select(*FILES.names), 9000).select("path", "action")


@query(f"WITH new AS ({_DOCS} UNION ALL {_TALKS}), h AS (SELECT path, hex(encode(text)) AS x FROM new WHERE strlen(text) <= 9000) SELECT path, count(DISTINCT substr(x, 2 * i - 1, 6)) AS trigrams FROM (SELECT path, x, unnest(range(1, CAST(len(x) / 2 AS BIGINT) - 1)) AS i FROM h) GROUP BY path")
def incremental_postings(spark: SparkSession, d: str) -> DataFrame:
    """A refreshed index has the postings of a new one."""
    old, new = _snapshots(spark, d)
    index = built(spark, old, max_file_size=9000)
    index.refresh(new, 9000)
    per_file = index.postings().groupBy("file_id").agg(F.count("*").alias("trigrams"))
    return index.files().join(per_file, "file_id").select("path", "trigrams")


@query(f"{_TRIGRAMS} SELECT (SELECT count(*) FROM corpus) AS files, count(DISTINCT tri) AS trigrams, count(*) AS postings FROM tris")
def index_status(spark: SparkSession, d: str) -> DataFrame:
    return built(spark, documents(spark, d)).status().drop("age_s")


@query(f"WITH new AS ({_DOCS} UNION ALL {_TALKS}) SELECT count(*) AS files_total, count(*) FILTER (strlen(text) <= 9000) AS indexed, count(*) FILTER (strlen(text) > 9000) AS scan_always, CAST(0 AS BIGINT) AS \"binary\", (SELECT count(*) FROM ({_DOCS}) WHERE NOT regexp_matches(path, '/src1[0-9]*/')) AS reused FROM new")
def build_stats(spark: SparkSession, d: str) -> DataFrame:
    old, new = _snapshots(spark, d)
    meta = built(spark, old, max_file_size=9000)
    stats = meta.refresh(new, 9000)
    names = ["files_total", "indexed", "scan_always", "binary", "reused"]
    return spark.createDataFrame([tuple(stats[n] for n in names)], ", ".join(f"{n} long" for n in names))


@query(f"{_lines(_PAGES)} SELECT path, line_number, line FROM lines WHERE regexp_matches(line, '<title>[^<]*')")
def pages_search(spark: SparkSession, d: str) -> DataFrame:
    return Search(pages(spark, d), "<title>[^<]*").lines()


@query(f"{_lines(_TALKS)} SELECT path, line_number, line FROM lines WHERE contains(line, 'the ')")
def conversations_search(spark: SparkSession, d: str) -> DataFrame:
    return Search(conversations(spark, d), "the ").lines()


@query(f"{_lines(_DOCS + ' UNION ALL ' + _PAGES + ' UNION ALL ' + _TALKS)} SELECT path, count(*) AS matches FROM lines WHERE contains(line, 'tion') GROUP BY path")
def multi_corpus_union(spark: SparkSession, d: str) -> DataFrame:
    return Search(documents(spark, d).unionByName(pages(spark, d)).unionByName(conversations(spark, d)), "tion").counts()


@query("SELECT * FROM (VALUES ('abc', '\"abc\"'), ('ab', 'ALL'), ('abc.*def', '\"abc\" \"def\"'), ('abc|def', '(\"abc\"|\"def\")'), ('[ab]cde', '(\"acd\" \"cde\"|\"bcd\" \"cde\")'), ('(abcd)+', '\"abc\" \"bcd\"'), ('[a&&b]', 'NONE'), ('abc|abcd', '\"abc\"'), ('(abcd|xabcdy)+', '\"abc\" \"bcd\"'), ('^abc$', '\"abc\"'), ('\\babcd\\b', '\"abc\" \"bcd\"'), ('[a-z]abcd', '\"abc\" \"bcd\"'), ('(abc)?def', '\"def\"')) v(pattern, plan)")
def explain_plans(spark: SparkSession, d: str) -> DataFrame:
    from trawl.functions.pattern import compile_pattern
    from trawl.plans.trigrams import plan

    patterns = ["abc", "ab", "abc.*def", "abc|def", "[ab]cde", "(abcd)+", "[a&&b]", "abc|abcd", "(abcd|xabcdy)+", "^abc$", r"\babcd\b", "[a-z]abcd", "(abc)?def"]
    return spark.createDataFrame([(p, str(plan(compile_pattern(p)))) for p in patterns], "pattern string, plan string")


_EDITED = f"SELECT path, CASE WHEN regexp_matches(path, '/src1[0-9]*/') THEN translate(text, 'a', 'o') ELSE text END AS text FROM ({_DOCS})"


@query(f"{_lines(_EDITED)} SELECT path, line_number, line FROM lines WHERE contains(line, 'thot')")
def refresh_same_size(spark: SparkSession, d: str) -> DataFrame:
    """Edits that leave the size alone are found after a refresh."""
    docs = documents(spark, d)
    index = built(spark, docs)
    text = F.when(F.col("path").rlike("/src1[0-9]*/"), F.translate(F.col("content").cast("string"), "a", "o")).otherwise(F.col("content").cast("string"))
    edited = from_table(docs.select("path", text.alias("text")), F.col("path"), "text")
    index.refresh(edited)
    return Search(edited, "thot", index=index).lines()


#: A small tree: path -> content.
_TREE = {
    "app/run.py": "start = 1\nstop = 2\n", "app/util/deep.py": "def stop():\n    start\n", "build/out.txt": "start of what is ignored\n", "notes.md": "how to start\r\nand stop\n", "data.bin": "start\0",
    ".ignore": "build/\n*.tmp\n!keep.tmp\n", "old.tmp": "start\n", "keep.tmp": "start again\n", ".hidden/x": "start\n",
}
_TREE_FILES = "(VALUES ('app/run.py', 1, 'start = 1'), ('app/util/deep.py', 2, '    start'), ('keep.tmp', 1, 'start again'), ('notes.md', 1, 'how to start' || chr(13))) v(path, line_number, line)"


def _tree(spark: SparkSession) -> str:
    """The tree, written where the driver can list it."""
    top = scratch(spark)
    top = top.removeprefix("file://").removeprefix("file:") if top.startswith(("file:", "/")) else tempfile.mkdtemp(prefix="trawl-")
    for name, content in _TREE.items():
        at = os.path.join(top, name)
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "w", newline="") as f:
            f.write(content)
    return top


@query("SELECT * FROM (VALUES ('app/run.py', CAST(19 AS BIGINT)), ('app/util/deep.py', 22), ('data.bin', 6), ('keep.tmp', 12), ('notes.md', 23)) v(path, size)")
def tree_walk(spark: SparkSession, d: str) -> DataFrame:
    return from_tree(spark, _tree(spark)).select("path", "size")


@query(f"SELECT path, CAST(line_number AS BIGINT) AS line_number, line FROM {_TREE_FILES}")
def tree_search(spark: SparkSession, d: str) -> DataFrame:
    """Indexed search of a tree: only candidates are opened, binary and ignored files are no hits."""
    top = _tree(spark)
    corpus, index = from_tree(spark, top), CorpusIndex(spark, scratch(spark))
    index.build(corpus)
    return Search(corpus, "start", index=index, read=partial(from_tree, spark, top)).lines()


@query(f"SELECT path, CAST(line_number AS BIGINT) AS line_number, line FROM {_TREE_FILES} WHERE path <> 'keep.tmp'")
def vanished_file(spark: SparkSession, d: str) -> DataFrame:
    """A file that is gone once its turn comes is left out."""
    top = _tree(spark)
    corpus, index = from_tree(spark, top), CorpusIndex(spark, scratch(spark))
    index.build(corpus)
    os.remove(os.path.join(top, "keep.tmp"))
    return Search(corpus, "start", index=index, read=partial(from_tree, spark, top)).lines()


@query("SELECT '' AS none, 'app/new.py:1:start = 9|app/run.py:1:start = 1||2 matches in 2 files' AS reply")
def stale_index_search(spark: SparkSession, d: str) -> DataFrame:
    """The service answers for the tree as it is, not as it was when the index was built."""
    from trawl.rpc import Service

    top = _tree(spark)
    index = CorpusIndex(spark, scratch(spark))
    index.build(from_tree(spark, top))
    with open(os.path.join(top, "app/new.py"), "w") as f:
        f.write("start = 9\n")
    reply = Service(spark, top, index).tool("code_search", {"pattern": "^start = "})
    return spark.createDataFrame([("", reply.replace("\n", "|"))], "none string, reply string")


#: text, pattern, ignore case, whether it matches.
_DIALECT = [
    ("foo bar", r"\bbar\b", False, True), ("foobar", r"\bbar", False, False), ("abc", "(?P<x>b)", False, True), ("aa", "a++a", False, True), ("x1", r"^\w\d$", False, True), ("ABC", "abc", True, True), ("ABC", "abc", False, False),
    ("5", "^[0-9--4]$", False, True), ("4", "^[0-9--4]$", False, False), ("c", "[a-c~~b]", False, True), ("b", "^[a-c~~b]$", False, False), ("ab", r"[\w&&[^a]]b", False, False), (":", "[[:alpha:]]", False, False), ("tab\there", r"\x{9}", False, True),
    ("a b", "(?x) a [ ] b # note", False, True), ("aab", "^(?U)a+", False, True), ("a" * 1200, "^a{1100,}$", False, True), ("a" * 1000, "^a{1100,}$", False, False),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {str(e).lower()})" for i, (*_, e) in enumerate(_DIALECT)) + ") v(i, matches)")
def regex_dialect(spark: SparkSession, d: str) -> DataFrame:
    from trawl.functions.pattern import compile_pattern
    from trawl.operators.lines import line_matches

    tests = [F.struct(F.lit(i).alias("i"), line_matches(compile_pattern(p, c), F.lit(text)).alias("matches")) for i, (text, p, c, _) in enumerate(_DIALECT)]
    return spark.range(1).select(F.explode(F.array(*tests)).alias("t")).select("t.i", "t.matches")


@query("SELECT strftime(time_bucket(INTERVAL '1 minute', ts), '%Y-%m-%d %H:%M') AS minute, count(*) AS matches FROM events WHERE regexp_matches(event_type, 'c.*k') GROUP BY 1")
def stream_scan(spark: SparkSession, d: str) -> DataFrame:
    """A pattern over a stream of events, counted by windows of event time."""
    from trawl.functions.pattern import compile_pattern
    from trawl.operators.lines import line_matches
    from trawl.streaming.watch import scan_stream

    schema, name = spark.read.parquet(f"{d}/events.parquet").schema, f"scan_{os.urandom(6).hex()}"
    rows = spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet").select("ts", F.col("event_type").alias("line"))
    out = scan_stream(rows, lambda line: line_matches(compile_pattern("c.*k"), line)).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("minute"), "matches")
    out.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)
