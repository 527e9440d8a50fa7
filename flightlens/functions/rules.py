"""First-match rule lists over a file's extension, name and first characters, as one column expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """What a file gets if its extension is one of `exts` and, where given, a pattern is found in head, name or path."""

    result: str
    exts: tuple[str, ...] = ()
    head: str = ""
    name: str = ""
    also: str = ""


def extension(path: Column) -> Column:
    """The last suffix in lower case, with its dot; without one empty."""
    return F.lower(F.regexp_extract(path, r"[^/\\]+(\.[^./\\]+)$", 1))


def file_name(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"([^/\\]*)$", 1))


def first_match(rules: tuple[Rule, ...], path: Column, head: Column, default: str | None = None) -> Column:
    """The result of the first rule that holds; `also` is a second result after a bar, see split_pair."""
    ext, name = extension(path), file_name(path)
    found = None
    for rule in rules:
        holds = F.lit(True)
        if rule.exts:
            holds = holds & ext.isin(*rule.exts)
        if rule.head:
            holds = holds & F.coalesce(head.rlike(rule.head), F.lit(False))
        if rule.name:
            holds = holds & name.rlike(rule.name)
        value = F.lit(f"{rule.result}|{rule.also}" if rule.also else rule.result)
        found = F.when(holds, value) if found is None else found.when(holds, value)
    return found.otherwise(F.lit(default).cast("string"))


def split_pair(value: Column, first: str, second: str) -> Column:
    """A result and its companion as a struct."""
    parts = F.split(value, r"\|")
    return F.struct(parts[0].alias(first), F.get(parts, F.lit(1)).alias(second))
