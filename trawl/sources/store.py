"""Where the index of a directory tree lies, and whether a watcher keeps it fresh."""

from __future__ import annotations

import hashlib
import json
import os
import time

#: A heartbeat is written at least this often, and trusted this long.
BEAT_S, LIVE_S = 5, 30


def data_dir() -> str:
    env = os.environ
    if env.get("TRAWL_DATA_DIR"):
        return env["TRAWL_DATA_DIR"]
    top = env.get("LOCALAPPDATA") or env.get("XDG_CACHE_HOME") or os.path.join(env.get("HOME") or env.get("USERPROFILE") or ".", ".cache")
    return os.path.join(top, "trawl")


def index_folder(root: str) -> str:
    key = os.path.realpath(root).replace(os.sep, "/")
    return os.path.join(data_dir(), hashlib.blake2b(key.encode("utf-8", "surrogateescape"), digest_size=8).hexdigest())


def find_root(start: str) -> str | None:
    """The nearest folder from start upwards that has an index."""
    at = os.path.realpath(start)
    while True:
        if os.path.exists(os.path.join(index_folder(at), "CURRENT")):
            return at
        if (up := os.path.dirname(at)) == at:
            return None
        at = up


def beat(folder: str) -> None:
    os.makedirs(folder, exist_ok=True)
    aside = os.path.join(folder, f"WATCH.{os.getpid()}")
    with open(aside, "w") as f:
        json.dump({"pid": os.getpid(), "time": time.time()}, f)
    os.replace(aside, os.path.join(folder, "WATCH"))


def is_watched(folder: str) -> bool:
    """A heartbeat of the last LIVE_S seconds; one from the future doesn't count."""
    try:
        with open(os.path.join(folder, "WATCH")) as f:
            age = time.time() - json.load(f)["time"]
    except (OSError, ValueError, KeyError, TypeError):
        return False
    return 0 <= age < LIVE_S
