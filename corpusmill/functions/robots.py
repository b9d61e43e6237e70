"""robots.txt rules as a table of patterns, and the verdict on a URL: the longest pattern that matches decides, allowing ones on ties.

A file's rules are those of the groups that name the agent, else of the groups for `*`; `*` in a pattern stands for any characters, `$` at its end for
the end. Patterns are held against the URL from its path on, query included, as they are written. Files are
parsed once a host; the verdict on a URL is an expression over its host's rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.urls import host

#: A rule: whether it allows, its pattern as a regular expression of Python and the JVM alike, and the length that it decides by.
RULE = T.StructType([T.StructField("pattern", T.StringType()), T.StructField("size", T.IntegerType()), T.StructField("allow", T.BooleanType())])


def _lines(text: str) -> Iterator[tuple[str, str]]:
    for line in text.removeprefix("﻿").splitlines():
        name, colon, value = line.partition("#")[0].partition(":")
        if colon:
            yield name.strip().lower(), value.strip()


def _groups(text: str) -> list[tuple[set[str], list[tuple[bool, str]]]]:
    """(agents in lower case, rules as (allow, path)) of every group: agents' lines in a row and the rules after them."""
    out: list[tuple[set[str], list[tuple[bool, str]]]] = []
    open_for_agents = False
    for name, value in _lines(text):
        if name == "user-agent":
            if not open_for_agents:
                out.append((set(), []))
            out[-1][0].add(value.lower())
            open_for_agents = True
        elif name in ("allow", "disallow"):
            open_for_agents = False
            if out and value:  # an empty path forbids nothing
                out[-1][1].append((name == "allow", value))
    return out


def pattern_of(path: str) -> str:
    end = path.endswith("$")
    body = ".*".join(re.escape(piece) for piece in path.removesuffix("$").split("*"))
    return "(?s)^" + body + ("$" if end else "")


def rules_of(text: str | None, agent: str) -> list[dict]:
    """The rules of a file that hold for an agent (its product name; a version after `/` does not count)."""
    groups = _groups(text or "")
    name = agent.partition("/")[0].strip().lower()
    own = [rules for agents, rules in groups if name in agents] or [rules for agents, rules in groups if "*" in agents]
    return [{"pattern": pattern_of(path), "size": len(path), "allow": allow} for rules in own for allow, path in rules]


def allowed_one(url: str | None, rules: str | None, agent: str) -> bool:
    """True without rules, for the file itself, and for what is no URL."""
    found = re.match(r"(?s)[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", url or "")
    if not found:
        return True
    target = found[1] if found[1].startswith("/") else "/" + found[1]
    fits = [(r["size"], r["allow"]) for r in rules_of(rules, agent) if re.match(r["pattern"], target)]
    return target == "/robots.txt" or max(fits, default=(0, True))[1]


def rules_column(rules: Column, agent: str = "corpusmill") -> Column:
    """Rules of a file for an agent, as an array of RULE."""

    @F.arrow_udf(T.ArrayType(RULE))
    def run(files: pa.Array) -> pa.Array:
        kind = pa.struct([("pattern", pa.string()), ("size", pa.int32()), ("allow", pa.bool_())])
        return pa.array([rules_of(f, agent) for f in files.to_pylist()], pa.list_(kind))

    return run(rules)


def verdict(url: Column, rules: Column) -> Column:
    """Whether an array of RULE allows a URL."""
    rest = F.regexp_extract(url, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    target = F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))
    fits = F.filter(rules, lambda r: F.regexp_like(target, r["pattern"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["size"].alias("size"), r["allow"].alias("allow"))))
    return F.coalesce((target == "/robots.txt") | best["allow"], F.lit(True))


def with_verdict(urls: DataFrame, robots: DataFrame, url_col: str = "url", agent: str = "corpusmill") -> DataFrame:
    """Add `allowed`. robots: (host, rules, ok), one row a host; files that were not served (ok false) forbid nothing."""
    good = robots.where("ok").select(F.col("host").alias("__host"), rules_column(F.col("rules"), agent).alias("__rules"))
    joined = urls.withColumn("__h", host(F.col(url_col))).join(good, F.col("__h") == F.col("__host"), "left")
    return joined.withColumn("allowed", verdict(F.col(url_col), F.col("__rules"))).drop("__h", "__host", "__rules")
