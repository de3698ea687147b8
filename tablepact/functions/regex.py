"""Regular expressions in the dialect of the contracts, as Java patterns.

The dialect is that of a linear-time engine: ``$`` is the end of the text only, ``.`` is everything but
a line end, classes such as ``\\d`` are Unicode, and there are no look-arounds or back-references.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


class PatternError(ValueError):
    """A pattern that can't be evaluated."""


def to_java(pattern: str) -> str:
    """The Java pattern of the same meaning; raises PatternError for look-arounds and back-references."""
    out, i, depth = [], 0, 0
    multiline = bool(re.match(r"\(\?[a-z]*m", pattern))
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            if not depth and (nxt in "123456789" or nxt == "k"):
                raise PatternError(f"back-reference in pattern {pattern!r}")
            out.append(r"\z" if nxt == "z" else "\\" + nxt)
            i += 2
            continue
        if c == "[":
            # In Java a bracket within a class opens another; a first bracket is a literal one here.
            if depth and not pattern.startswith("[:", i):
                out.append("\\")
            elif depth:
                name = re.match(r"\[:(\^?)(\w+):\]", pattern[i:])
                if name:
                    out.append((r"\P" if name[1] else r"\p") + "{" + {"alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "upper": "Upper", "lower": "Lower", "space": "Space", "punct": "Punct"}.get(name[2], name[2].capitalize()) + "}")
                    i += len(name[0])
                    continue
            else:
                depth = 1
                out.append("[")
                i += 1
                if pattern.startswith("^", i):
                    out.append("^")
                    i += 1
                if pattern.startswith("]", i):
                    out.append(r"\]")
                    i += 1
                continue
        elif c == "]" and depth:
            depth = 0
        elif c == "&" and depth and pattern.startswith("&&", i):
            out.append("&&")
            i += 2
            continue
        elif c == "(" and not depth and re.match(r"\(\?(=|!|<=|<!)", pattern[i:]):
            raise PatternError(f"look-around in pattern {pattern!r}")
        elif c == "(" and not depth and pattern.startswith("(?P<", i):
            out.append("(?<")
            i += 4
            continue
        elif c == "$" and not depth and not multiline:
            out.append(r"\z")
            i += 1
            continue
        out.append(c)
        i += 1
    return "(?dU)" + "".join(out)


def to_python(pattern: str) -> str:
    """The pattern for ``re``, where ``$`` is the end of the text as well."""
    out, i, depth = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append(r"\Z" if pattern[i + 1] == "z" else pattern[i : i + 2])
            i += 2
            continue
        if c == "[":
            depth = True
        elif c == "]":
            depth = False
        out.append(r"\Z" if c == "$" and not depth and not re.match(r"\(\?[a-z]*m", pattern) else c)
        i += 1
    return "".join(out)


def checked(pattern: str) -> str:
    """``to_java``, compiled once on the driver, so that a bad pattern fails here and not in a task."""
    java = to_java(pattern)
    spark = SparkSession.getActiveSession()
    if spark is not None and hasattr(spark, "_jvm") and spark._jvm is not None:
        try:
            spark._jvm.java.util.regex.Pattern.compile(java)
        except Exception as e:
            raise PatternError(f"invalid pattern {pattern!r}") from e
    else:
        try:
            re.compile(to_python(pattern))
        except re.error as e:
            raise PatternError(f"invalid pattern {pattern!r}: {e}") from e
    return java


def replacement(value: str) -> str:
    """``$1`` and ``${name}`` stand for groups and ``$$`` for a dollar; a backslash is itself."""
    return re.sub(r"\\|\$\$", lambda m: r"\\" if m[0] == "\\" else r"\$", value)
