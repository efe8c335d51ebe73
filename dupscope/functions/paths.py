"""Path expressions: pure columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """Directory of a path; of a child of the root, the root."""
    up = F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)
    return F.when(up == "", F.lit("/")).otherwise(up)


def directory(path: Column) -> Column:
    """Directory with its closing slash."""
    return F.regexp_extract(path, r"(?s)^(.*/)?[^/]*$", 1)


def extension(path: Column) -> Column:
    """Lower-cased text after the last dot of the name; empty where there is none or the dot leads."""
    return F.lower(F.regexp_extract(name(path), r"(?s)^.+\.([^.]*)$", 1))


def normal_extension(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(text), r"^\.+", ""))


def extension_list(text: Column) -> Column:
    """The normal extensions in a text with commas between them, in order; empty ones are dropped."""
    return F.filter(F.transform(F.split(text, ","), normal_extension), lambda x: x != "")


def below(path: Column, directory_: str) -> Column:
    """Strictly below a directory, as a half-open range that file statistics can prune."""
    low, high = ("/", "0") if directory_ == "/" else (f"{directory_}/", f"{directory_}0")
    return (path >= low) & (path < high)


def under_root(path: Column, root: str) -> Column:
    """The root itself or below it, by components."""
    return path.startswith("/") if root == "/" else (path == root) | path.startswith(f"{root}/")


def overlaps(root: Column, at: str) -> Column:
    """One is the other, or above it."""
    inner = F.when(root == "/", F.lit(True)).otherwise(F.lit(at).startswith(F.concat(root, F.lit("/"))))
    return (root == at) | inner | under_root(root, at)


def ancestors(path: Column) -> Column:
    """All directories above a path, the root first."""
    return F.transform(F.sequence(F.lit(1), levels(path)), lambda n: ancestor(path, n))


def levels(path: Column) -> Column:
    """How many directories are above a path."""
    return F.size(F.split(path, "/")) - 1


def ancestor(path: Column, n: Column) -> Column:
    """The n-th directory above a path, the root being the first."""
    return F.when(n == 1, F.lit("/")).otherwise(F.call_function("substring_index", path, F.lit("/"), n))


def relative(path: Column, directory_: Column) -> Column:
    return F.when(directory_ == "/", F.substr(path, F.lit(2))).otherwise(F.substr(path, F.length(directory_) + 2))


def glob_regex(glob: str) -> str:
    """A glob over whole paths: ``**`` any depth, ``*`` and ``?`` within a component, ``[...]`` classes."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            body = glob[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[:1] == "!" else body) + "]", end + 1
            continue
        out += "[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)
        i += 1
    return f"^{out}$"


def excluded(path: Column, globs: list[str]) -> Column:
    hit = F.lit(False)
    for g in globs:
        hit = hit | path.rlike(glob_regex(g))
    return hit


#: Trees that aren't on a disk.
PSEUDO = ("/proc", "/sys", "/dev", "/run")


def pseudo(path: Column) -> Column:
    """Whether a path is in a tree that isn't on a disk."""
    out = F.lit(False)
    for root in PSEUDO:
        out = out | under_root(path, root)
    return out
