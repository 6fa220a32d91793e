"""Path filters: scopes, globs and file types, compiled on the driver to predicates on a path column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


class BadFilter(ValueError):
    """A glob, a type or a scope that means nothing."""


#: Widespread file types, by endings; callers can pass their own globs.
_ENDINGS = {
    "ada": "adb ads", "asm": "asm s S", "asciidoc": "adoc asciidoc", "awk": "awk", "bat": "bat cmd", "bazel": "bazel bzl", "bib": "bib", "c": "c h", "clojure": "clj cljc cljs", "cmake": "cmake",
    "coffee": "coffee", "config": "cfg conf config ini", "cpp": "cpp cc cxx hpp hh hxx h inl", "crystal": "cr", "cs": "cs", "css": "css scss sass", "csv": "csv", "cuda": "cu cuh", "cython": "pyx pxd pxi", "d": "d",
    "dart": "dart", "diff": "diff patch", "elixir": "ex exs eex", "elm": "elm", "erlang": "erl hrl", "fortran": "f f77 f90 f95 F", "fsharp": "fs fsi fsx", "glsl": "glsl vert frag", "go": "go", "gradle": "gradle",
    "graphql": "graphql gql", "groovy": "groovy", "haskell": "hs lhs", "html": "html htm xhtml", "idl": "idl", "java": "java jsp", "js": "js jsx mjs cjs vue", "json": "json jsonl", "julia": "jl", "jupyter": "ipynb",
    "kotlin": "kt kts", "less": "less", "lisp": "el lisp lsp", "log": "log", "lua": "lua", "markdown": "md markdown mdown mdx", "matlab": "m", "md": "md markdown mdown mdx", "nim": "nim nims", "nix": "nix",
    "objc": "m h", "ocaml": "ml mli", "org": "org", "pascal": "pas dpr inc", "pdf": "pdf", "perl": "pl pm t", "php": "php phtml", "po": "po", "prolog": "pl pro", "protobuf": "proto",
    "ps": "ps1 psm1 psd1", "puppet": "pp epp", "py": "py pyi", "python": "py pyi", "r": "r R Rmd", "readme": "", "rst": "rst", "ruby": "rb gemspec", "rust": "rs", "scala": "scala sbt",
    "scheme": "scm ss rkt", "sh": "sh bash zsh ksh", "sol": "sol", "sql": "sql psql", "svelte": "svelte", "svg": "svg", "swift": "swift", "tcl": "tcl", "tex": "tex sty cls bib", "tf": "tf tfvars",
    "thrift": "thrift", "toml": "toml", "ts": "ts tsx mts cts", "txt": "txt", "vb": "vb", "verilog": "v vh sv svh", "vhdl": "vhd vhdl", "vim": "vim", "vue": "vue", "wgsl": "wgsl",
    "xml": "xml xsd xsl xslt", "yaml": "yaml yml", "zig": "zig",
}
#: Whole names that belong to a type as well.
_NAMES = {
    "cmake": ["CMakeLists.txt"], "docker": ["*Dockerfile*"], "license": ["*LICENSE*", "*LICENCE*", "COPYING*"], "lock": ["*.lock", "package-lock.json"], "make": ["[Mm]akefile", "GNUmakefile", "*.mk"],
    "python": [], "readme": ["README*"], "ruby": ["Rakefile", "Gemfile"], "sh": [".bashrc", ".profile", ".zshrc"],
}
TYPES = {t: [f"*.{e}" for e in _ENDINGS.get(t, "").split()] + _NAMES.get(t, []) for t in sorted({*_ENDINGS, *_NAMES})}


def in_scopes(path: Column, scopes: list[str]) -> Column:
    """Equal to a scope or below it; no scopes: everything."""
    tests = [(path == s) | path.startswith(f"{s}/") for s in (x.strip("/") for x in scopes)]
    return reduce(lambda a, b: a | b, tests, F.lit(False)) if tests else F.lit(True)


def glob_regex(glob: str) -> str:
    """A regular expression (Java and Python alike) for whole paths, by gitignore rules."""
    body, out, i = glob.lstrip("/"), "", 0
    rooted = "/" in glob.rstrip("/")
    depth = 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i) and (i == 0 or body[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if body.startswith("**", i) and (i == 0 or body[i - 1] == "/") and i + 2 == len(body):
            out, i = out + ".+", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            end = body.find("]", i + 2)
            if end < 0:
                raise BadFilter(f"unclosed class in glob {glob!r}")
            inner = body[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&").replace("~", "\\~")
            out += "[" + ("^/" + inner[1:] if inner[0] in "!^" else inner) + "]"
            i = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "\\" and i + 1 < len(body):
            i += 1
            out += "\\" + body[i] if not body[i].isalnum() else body[i]
        else:
            out += c if c.isalnum() or c in "/_" else "\\" + c
        i += 1
    if depth:
        raise BadFilter(f"unclosed braces in glob {glob!r}")
    return ("" if rooted else "(?:.*/)?") + out


def passes_globs(path: Column, globs: list[str]) -> Column:
    """The last fitting glob decides; ! excludes; with any including glob, what fits none is out. `dir/` fits no file."""
    verdict = F.lit(not any(not g.startswith("!") for g in globs))
    for g in globs:
        out = g.startswith("!")
        body = g[1:] if out else g
        if not body.endswith("/"):
            verdict = F.when(path.rlike(f"(?s)\\A(?:{glob_regex(body)})\\z"), F.lit(not out)).otherwise(verdict)
    return verdict


def of_types(path: Column, select: list[str], negate: list[str], types: dict[str, list[str]] = TYPES) -> Column:
    def fits(names: list[str]) -> Column:
        for n in names:
            if n not in types:
                raise BadFilter(f"unknown file type {n!r}")
        tests = [path.rlike(f"(?s)\\A(?:{glob_regex(g)})\\z") for n in names for g in types[n]]
        return reduce(lambda a, b: a | b, tests, F.lit(False))

    return (fits(select) if select else F.lit(True)) & (~fits(negate) if negate else F.lit(True))


def scope_of(path: str, root: str) -> str | None:
    """A scope below root for a path; None for root itself; BadFilter outside of it."""
    import os.path

    whole, top = os.path.realpath(os.path.join(root, path)), os.path.realpath(root)
    if whole == top:
        return None
    if not whole.startswith(top.rstrip("/") + "/"):
        raise BadFilter(f"{path!r} is outside of {root!r}")
    return whole[len(top.rstrip("/")) + 1 :].replace(os.sep, "/")


def scopes_of(paths: list[str], root: str) -> list[str]:
    """Scopes of several paths; with the root among them the whole tree."""
    scopes = [scope_of(p, root) for p in paths]
    return [] if None in scopes else scopes


def human_bytes(n: int) -> str:
    value, units = float(n), ["B", "KiB", "MiB", "GiB", "TiB"]
    while value >= 1024 and len(units) > 1:
        value, units = value / 1024, units[1:]
    return f"{n} B" if units[0] == "B" else f"{value:.1f} {units[0]}"
