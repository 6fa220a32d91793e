"""A code-search service for agents: JSON-RPC 2.0 over lines of text, with two tools."""

from __future__ import annotations

import json
from functools import partial
from typing import TextIO

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from pyspark.sql import DataFrame, SparkSession

from trawl.functions.paths import BadFilter, scope_of
from trawl.functions.pattern import BadPattern
from trawl.operators.index import CorpusIndex, IndexFault
from trawl.operators.search import Options, Search
from trawl.render import files_reply, matches_reply
from trawl.sources.corpus import from_tree
from trawl.sources.store import index_folder, is_watched
from trawl.streaming.watch import refresh_if_changed

#: Versions of the protocol, the latest first.
PROTOCOLS = ("2025-06-18", "2025-03-26", "2024-11-05")
_SHARED = {
    "pattern": {"type": "string", "description": "the regular expression"},
    "path": {"type": "string", "description": "a file or folder to stay in"},
    "glob": {"type": "string", "description": "a glob that files must fit; ! excludes"},
    "type": {"type": "string", "description": "a file type, such as py"},
    "ignore_case": {"type": "boolean"},
    "fixed": {"type": "boolean", "description": "the pattern is a literal string"},
}
_MORE = {"context": {"type": "integer", "description": "lines around each match"}, "max_results": {"type": "integer", "description": "matching lines at most, 200 if not given"}}
TOOLS = [
    {"name": "code_search", "description": "Exact search for a regular expression; one path:line:text for each match.", "inputSchema": {"type": "object", "properties": _SHARED | _MORE, "required": ["pattern"]}},
    {"name": "list_matching_files", "description": "Only the paths of the files that match.", "inputSchema": {"type": "object", "properties": _SHARED, "required": ["pattern"]}},
]


class Service:
    """Searches of one tree. The index is brought up to date before each, unless a watcher does; without one all is scanned."""

    def __init__(self, spark: SparkSession, root: str, index: CorpusIndex | None = None):
        self.spark, self.root = spark, root
        self.index = index or CorpusIndex(spark, f"file://{index_folder(root)}")

    def corpus(self) -> DataFrame:
        return from_tree(self.spark, self.root)

    def fresh_index(self, corpus: DataFrame) -> CorpusIndex | None:
        """The index as the tree is now, or None where it can't be brought there: a full scan finds the same."""
        try:
            if not is_watched(index_folder(self.root)):
                refresh_if_changed(self.index, corpus)
            self.index.validate()
        except (IndexFault, OSError, PySparkException, Py4JJavaError):
            return None
        return self.index

    def tool(self, name: str, args: dict) -> str:
        pattern = args.get("pattern")
        if not isinstance(pattern, str) or not pattern:
            raise BadPattern("a pattern is needed")
        scope = scope_of(args["path"], self.root) if args.get("path") else None
        around = max(0, int(args.get("context") or 0)) if name == "code_search" else 0
        given = lambda k: (args[k],) if args.get(k) else ()
        options = Options(bool(args.get("ignore_case")), bool(args.get("fixed")), (scope,) if scope else (), given("glob"), given("type"), before=around, after=around)
        corpus = self.corpus()
        search = Search(corpus, pattern, options, self.fresh_index(corpus), partial(from_tree, self.spark, self.root))
        return files_reply(search) if name == "list_matching_files" else matches_reply(search, int(args.get("max_results") or 200))

    def handle(self, request: dict) -> dict:
        """result or error of one request."""
        method, params = request.get("method"), request.get("params")
        if method == "initialize":
            asked = (params or {}).get("protocolVersion")
            return {"result": {"protocolVersion": asked if asked in PROTOCOLS else PROTOCOLS[0], "capabilities": {"tools": {}}, "serverInfo": {"name": "trawl", "version": "0.1.0"}}}
        if method == "ping":
            return {"result": {}}
        if method == "tools/list":
            return {"result": {"tools": TOOLS}}
        if method != "tools/call":
            return {"error": {"code": -32601, "message": f"unknown method {method}"}}
        if not isinstance(params, dict) or params.get("name") not in [t["name"] for t in TOOLS]:
            return {"error": {"code": -32602, "message": "unknown tool" if isinstance(params, dict) else "missing params"}}
        try:
            text, failed = self.tool(params["name"], params.get("arguments") or {}), False
        except (BadPattern, BadFilter, ValueError, TypeError) as e:
            text, failed = str(e), True
        return {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}

    def run(self, source: TextIO, sink: TextIO) -> None:
        """Until the input ends; lines that aren't JSON objects, and requests without an id, get no reply."""
        for line in source:
            try:
                request = json.loads(line)
            except ValueError:
                continue
            if isinstance(request, dict) and "id" in request:
                print(json.dumps({"jsonrpc": "2.0", "id": request["id"], **self.handle(request)}, ensure_ascii=False), file=sink, flush=True)
