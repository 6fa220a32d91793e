"""The command line: search, index, watch, status, forget and serve over a directory tree."""

from __future__ import annotations

import argparse
import os
import sys
import time
from functools import partial

from pyspark.sql import SparkSession, functions as F

from trawl.functions.paths import BadFilter, human_bytes, scopes_of
from trawl.functions.pattern import BadPattern, compile_pattern
from trawl.operators.index import CorpusIndex, IndexFault
from trawl.operators.search import Options, Search
from trawl.plans.trigrams import plan
from trawl.render import grep_lines
from trawl.sources.corpus import from_tree
from trawl.sources.store import index_folder, find_root, is_watched

COMMANDS = ("index", "watch", "status", "forget", "serve")


def spark_session() -> SparkSession:
    spark = SparkSession.builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", str(os.cpu_count() or 8)).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="trawl", description=f"Search with an index. Commands instead of a pattern: {', '.join(COMMANDS)}.")
    p.add_argument("pattern")
    p.add_argument("paths", nargs="*")
    p.add_argument("-i", dest="ignore_case", action="store_true", help="case-insensitive")
    p.add_argument("-F", dest="fixed", action="store_true", help="the pattern is a literal string")
    p.add_argument("-l", dest="list_files", action="store_true", help="matching files only")
    p.add_argument("-c", dest="count", action="store_true", help="matching lines per file")
    p.add_argument("-m", dest="max_count", type=int, help="matching lines per file at most")
    p.add_argument("-A", dest="after", type=int, default=0, help="lines of context after each match")
    p.add_argument("-B", dest="before", type=int, default=0, help="lines of context before each match")
    p.add_argument("-C", dest="around", type=int, help="lines of context on both sides")
    p.add_argument("-g", dest="globs", action="append", default=[], help="files that fit the glob; ! excludes")
    p.add_argument("-t", dest="types", action="append", default=[], help="files of a type")
    p.add_argument("-T", dest="not_types", action="append", default=[], help="no files of a type")
    p.add_argument("--json", action="store_true", help="one JSON object per matching line")
    p.add_argument("--stats", action="store_true", help="plan and index statistics after the search")
    p.add_argument("--explain", action="store_true", help="only show the plan")
    p.add_argument("--no-index", action="store_true", help="scan without an index")
    p.add_argument("--no-auto-index", action="store_true", help="use the index as it is")
    p.add_argument("--no-heading", action="store_true", help="path:line:text")
    p.add_argument("--color", choices=("always", "never", "auto"), default="auto")
    return p


def run_search(args: argparse.Namespace, out=sys.stdout, err=sys.stderr) -> int:
    if args.explain:
        print(plan(compile_pattern(args.pattern, args.ignore_case, args.fixed)), file=out)
        return 0
    compile_pattern(args.pattern, args.ignore_case, args.fixed)
    spark = spark_session()
    root = None if args.no_index else find_root(".")
    top = root or os.path.realpath(".")
    corpus, index, folder = from_tree(spark, top), None, index_folder(top)
    if not args.no_index:
        index = CorpusIndex(spark, f"file://{folder}")
        if root is None and args.no_auto_index:
            raise IndexFault("no index here; run `index` first")
        if not args.no_auto_index and not is_watched(folder):
            index.refresh(corpus) if root else index.build(corpus)
    plainly = args.list_files or args.count or args.json
    around = args.around if args.around is not None else 0
    options = Options(
        args.ignore_case, args.fixed, tuple(scopes_of(args.paths, top)), tuple(args.globs), tuple(args.types), tuple(args.not_types), args.max_count,
        0 if plainly else max(around, args.before), 0 if plainly else max(around, args.after),
    )
    search = Search(corpus, args.pattern, options, index, partial(from_tree, spark, top))
    terminal = out.isatty()
    if args.list_files:
        rows = (r.path for r in search.files().orderBy("path").toLocalIterator())
    elif args.count:
        rows = (f"{r.path}:{r.matches}" for r in search.counts().orderBy("path").toLocalIterator())
    elif args.json:
        rows = (r.json for r in search.json().orderBy("path", "line_number").toLocalIterator())
    else:
        rows = grep_lines(search, terminal and not args.no_heading, args.color == "always" or args.color == "auto" and terminal)
    n = 0
    for n, row in enumerate(rows, 1):  # noqa: B007
        print(row, file=out)
    if args.stats and index is not None:
        s = search.stats().first()
        print(f"plan {s.plan}; {s.candidates:,} of {s.files_in_index:,} files are candidates ({100 * s.candidates / max(1, s.files_in_index):.1f} %); {s.matched_lines:,} lines in {s.matched_files:,} files", file=err)
    if not n and args.no_auto_index and not is_watched(folder):
        print("no match; the index may be stale (run `index`, or leave out --no-auto-index)", file=err)
    return 0 if n else 1


def run_command(name: str, path: str, out=sys.stdout, err=sys.stderr) -> int:
    root = os.path.realpath(path)
    spark, folder = spark_session(), index_folder(root)
    index = CorpusIndex(spark, f"file://{folder}")
    if name == "index":
        began = time.time()
        meta = index.refresh(from_tree(spark, root)) if index.exists() else index.build(from_tree(spark, root))
        changed = meta["files_total"] - meta["reused"]
        print(f"{meta['files_total']:,} files, {changed:,} new or changed, {meta['binary']:,} binary, {meta['scan_always']:,} always scanned, {time.time() - began:.1f} s", file=err)
    elif name == "status":
        s = index.status().first()
        size = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)
        print(f"root {root}\nindex {folder}\nfiles {s.files:,}\ntrigrams {s.trigrams:,}\nsize {human_bytes(size)}\nage {s.age_s:.0f} s\nwatched {'yes' if is_watched(folder) else 'no'}", file=out)
    elif name == "forget":
        if not index.exists():
            raise IndexFault(f"no index of {root}")
        index.forget()
    elif name == "watch":
        from trawl.streaming.watch import watch

        watch(spark, index, lambda: from_tree(spark, root), folder).awaitTermination()
    else:
        from trawl.rpc import Service
        from trawl.streaming.watch import watch

        # the watcher's first batch builds the index or brings it up to date
        watching = watch(spark, index, lambda: from_tree(spark, root), folder)
        try:
            Service(spark, root).run(sys.stdin, out)
        finally:
            watching.stop()
    return 0


def main(argv: list[str] | None = None, out=None, err=None) -> int:
    """0: matches, 1: none, 2: an error."""
    out, err = out or sys.stdout, err or sys.stderr
    args = parser().parse_intermixed_args(argv)
    try:
        if args.pattern in COMMANDS:
            return run_command(args.pattern, args.paths[0] if args.paths else ".", out, err)
        return run_search(args, out, err)
    except (BadPattern, BadFilter, IndexFault, OSError) as e:
        print(f"trawl: {e}", file=err)
        return 2


if __name__ == "__main__":
    sys.exit(main())
