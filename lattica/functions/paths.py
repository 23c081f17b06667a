"""Predicates on dotted label paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_subtree(path: Column, root: str) -> Column:
    """Whether ``path`` is ``root`` or lies below it. Both forms reach a Parquet scan as pushed filters."""
    return (path == root) | path.startswith(root + ".")


def depth(path: Column) -> Column:
    return F.size(F.split(path, r"\."))


def label(text: str) -> str:
    """A label for ``text``: other characters than letters, digits and ``_`` become ``_``; never empty."""
    return re.sub(r"[^A-Za-z0-9_]", "_", text) or "_"


def _level(part: str) -> str:
    """The pattern of one level: alternatives of labels with ``*`` at the end as a prefix mark, ``!`` negates."""
    negated, part = part.startswith("!"), part.removeprefix("!")
    options = []
    for option in part.split("|"):
        star = option.endswith("*")
        nocase = "@" in option
        word = re.escape(option.rstrip("*@%"))
        options.append(("(?i:" + word + ")" if nocase else word) + (r"[^.]*" if star else ""))
    any_of = "(?:" + "|".join(options) + ")"
    return rf"(?!{any_of}(?:\.|$))[^.]+" if negated else any_of


def lquery_pattern(query: str) -> str:
    """A regular expression for a label-wise pattern: ``*`` any levels, ``*{n}`` ``*{n,m}`` so many, ``a|b``, ``!a``.

    It is for a path with a dot before every label, the first too.
    """
    out = ""
    for part in re.split(r"\.(?![^{]*\})", query):
        if not part.startswith("*"):
            out += r"\." + _level(part)
            continue
        low, comma, high = part[1:].strip("{}").partition(",")
        count = f"{{{low or 0},{high}}}" if comma or not low else f"{{{low}}}"
        out += r"(?:\.[^.]+)" + count
    return f"^{out}$"


def matches_lquery(path: Column, query: str) -> Column:
    return F.concat(F.lit("."), path).rlike(lquery_pattern(query))


def matches(path: Column, pattern: str) -> Column:
    """A label-wise pattern if it has a wildcard, else the subtree of a path."""
    return matches_lquery(path, pattern) if any(c in pattern for c in "*|!") else in_subtree(path, pattern)
