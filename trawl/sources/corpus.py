"""What can be searched: any table with a key and a text, or a directory tree."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trawl.functions.paths import glob_regex
from trawl.schemas import CORPUS


def from_table(df: DataFrame, key: Column, text: Column | str, mtime: Column | None = None) -> DataFrame:
    """A corpus of a table; null keys and null texts are left out, as files that can't be read are.

    The key names one text. mtime is its version; where none is given, the hash of the text, so that every edit is seen.
    """
    content = (F.col(text) if isinstance(text, str) else text).cast("binary")
    version = mtime if mtime is not None else F.xxhash64(content)
    rows = df.select(key.cast("string").alias("path"), content.alias("content"), version.cast("long").alias("mtime"))
    return rows.where(F.col("path").isNotNull() & F.col("content").isNotNull()).select("path", "content", F.octet_length("content").cast("long").alias("size"), "mtime")


class Ignore:
    """The patterns of one ignore file, which hold below its folder; above the root, by the root's path from there."""

    def __init__(self, folder: str, text: str, above: str = ""):
        self.folder, self.above, self.rules = folder, above, []
        for line in text.splitlines():
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            out = line.startswith("!")
            body = line[1:] if out else line
            only_folders, body = body.endswith("/"), body.rstrip("/")
            self.rules.append((re.compile(f"(?:{glob_regex(body)})\\Z", re.S), only_folders, out))

    def verdict(self, path: str, is_folder: bool) -> bool | None:
        """True: ignored, False: asked for, None: no word; the last fitting rule decides."""
        below = path[len(self.folder) + 1 :] if self.folder else self.above + path
        for rule, only_folders, out in reversed(self.rules):
            if (is_folder or not only_folders) and rule.match(below):
                return not out
        return None


def _read(path: str) -> str | None:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return f.read()
    except OSError:
        return None


def _global_excludes() -> str | None:
    """The file of excludes that hold for all repositories of the user: core.excludesFile, or its default."""
    home = os.path.expanduser("~")
    config = os.environ.get("XDG_CONFIG_HOME") or os.path.join(home, ".config")
    for at in (os.path.join(home, ".gitconfig"), os.path.join(config, "git", "config")):
        if named := re.search(r"(?im)^\s*excludesfile\s*=\s*\"?([^\"\n#;]+)", _read(at) or ""):
            return _read(os.path.expanduser(named[1].strip()))
    return _read(os.path.join(config, "git", "ignore"))


def outer_ignores(root: str) -> tuple[list[Ignore], bool]:
    """What is ignored from outside of root, least binding first: global and repository excludes, ignore files of the folders above; and whether root is in a repository."""
    top = os.path.realpath(root)
    parents, at = [], top
    while (up := os.path.dirname(at)) != at:
        parents.append(up)
        at = up
    repository = next((p for p in [top, *parents] if os.path.exists(os.path.join(p, ".git"))), None)
    prefix = lambda p: "" if p == top else os.path.relpath(top, p).replace(os.sep, "/") + "/"
    out = []
    if repository:
        for text in (_global_excludes(), _read(os.path.join(repository, ".git", "info", "exclude"))):
            if text:
                out.append(Ignore("", text, prefix(repository)))
    for p in reversed(parents):
        inside = repository and (p == repository or p.startswith(repository.rstrip("/") + "/"))
        for name in ([".gitignore"] if inside else []) + [".ignore"]:
            if text := _read(os.path.join(p, name)):
                out.append(Ignore("", text, prefix(p)))
    return out, repository is not None


def walk(root: str) -> list[tuple[str, int, int]]:
    """(path, size, mtime in ns) of the regular files below root, by path; hidden ones and ignored ones are left out.

    .ignore holds everywhere, .gitignore and excludes inside a repository. Links aren't followed.
    """
    out: list[tuple[str, int, int]] = []

    def ignored(path: str, is_folder: bool, ignores: list[Ignore]) -> bool:
        for i in reversed(ignores):
            if (v := i.verdict(path, is_folder)) is not None:
                return v
        return False

    def visit(folder: str, ignores: list[Ignore], in_git: bool) -> None:
        try:
            entries = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name)
        except OSError:
            return
        names = {e.name for e in entries}
        in_git = in_git or ".git" in names
        more = list(ignores)
        for name in ([".gitignore"] if in_git else []) + [".ignore"]:
            if name in names and (text := _read(os.path.join(root, folder, name))):
                more.append(Ignore(folder, text))
        for e in entries:
            path = f"{folder}/{e.name}" if folder else e.name
            if e.name.startswith(".") or e.is_symlink() or ignored(path, e.is_dir(follow_symlinks=False), more):
                continue
            if e.is_dir(follow_symlinks=False):
                visit(path, more, in_git)
            elif e.is_file(follow_symlinks=False):
                try:
                    s = e.stat(follow_symlinks=False)
                except OSError:
                    continue
                out.append((path.encode("utf-8", "surrogateescape").decode("utf-8", "replace"), s.st_size, s.st_mtime_ns))

    visit("", *outer_ignores(root))
    return sorted(out, key=lambda r: r[0].encode())


def from_tree(spark: SparkSession, root: str, only: list[str] | None = None) -> DataFrame:
    """A corpus of a directory tree that driver and executors share; only the files listed, or of these only some, are opened.

    Files that are gone, or can't be read, when their turn comes are left out.
    """
    top = os.path.realpath(root)
    listed = walk(root)
    if only is not None:
        wanted = set(only)
        listed = [r for r in listed if r[0] in wanted]
    table = spark.createDataFrame(listed, "path string, size long, mtime long")
    if only is not None and not listed:
        return table.select("path", F.lit(b"").alias("content"), "size", "mtime")
    places = [top] if only is None else [re.sub(r"([\\*?\[\]{}])", r"\\\1", f"{top.rstrip('/')}/{p}") for p, _, _ in listed]
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True).load(places)
    # a content column that is not asked for is not read; nor is that of a file that a test of its size leaves out
    below = F.substring(F.regexp_replace("path", "^file:/+", "/"), len(top.rstrip("/")) + 2, 1 << 30)
    return read.select(below.alias("path"), "content", F.col("length").alias("size")).join(table.select("path", "mtime"), "path").select(*CORPUS.names)
