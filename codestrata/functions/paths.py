"""Path, name and classification functions as column expressions (Catalyst only)."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

from codestrata import rules


def segments(path: Column) -> Column:
    return F.split(path, "/")


def basename(path: Column) -> Column:
    return F.element_at(segments(path), -1)


def dirname(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def extension(path: Column) -> Column:
    """`.gz` of a.tar.gz; nothing for dotfiles."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1)


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def file_type(path: Column) -> Column:
    cargo = (path == ".cargo/config.toml") | F.endswith(path, F.lit("/.cargo/config.toml"))
    return F.coalesce(_lookup(basename(path), rules.NAME_TYPES), F.when(cargo, F.lit("cargoconfig")), _lookup(extension(path), rules.EXTENSION_TYPES), F.lit("unknown"))


def is_parseable(kind: Column) -> Column:
    return ~kind.isin(*rules.UNPARSED)


def is_pruned(path: Column) -> Column:
    return F.arrays_overlap(segments(path), F.array(*[F.lit(x) for x in rules.IGNORED]))


def expand_home(path: Column) -> Column:
    return F.when(F.startswith(path, F.lit("~")), F.concat(F.lit(os.path.expanduser("~")), F.substring(path, F.lit(2), F.length(path)))).otherwise(path)


def is_sensitive(path: Column) -> Column:
    p = expand_home(path)
    hit = F.lit(False)
    for s in rules.SENSITIVE:
        hit = hit | (p == s) | F.startswith(p, F.lit(s + "/"))
    return hit


# Forms of remote addresses, and what a repository's name keeps.
SCHEMES = r"(?i)^(https?://|git://|ssh://)"
SCP = r"(?i)^[\w.-]+@[\w.-]+:[\w./-]+(?:\.git)?$"
NOT_NAME = "[^a-zA-Z0-9-_]"


def is_remote(url: Column) -> Column:
    return F.rlike(url, F.lit(SCHEMES)) | F.rlike(url, F.lit(SCP))


def is_local(url: Column) -> Column:
    """By form alone: relative or absolute paths, drive letters, anything with a slash that is no scp form."""
    yes = url.isin(".", "..") | F.rlike(url, F.lit(r"^(\.\.?/|/|[a-zA-Z]:[\\/])"))
    return F.when(yes, True).when(F.rlike(url, F.lit(r"^[\w.-]+@[\w.-]+:")), False).otherwise(F.rlike(url, F.lit(r"[/\\]")))


def is_valid_input(url: Column) -> Column:
    """Not blank, and remote or local by its form."""
    t = F.trim(F.coalesce(url, F.lit("")))
    return (t != "") & (is_remote(t) | is_local(t))


def input_kind(url: Column) -> Column:
    return F.when(F.endswith(url, F.lit(".zip")), "zip").when(is_remote(url), "remote").otherwise("local")


def repo_name(url: Column) -> Column:
    last = F.element_at(F.filter(F.split(F.regexp_replace(url, "/+$", ""), "[/:]"), lambda s: s != ""), -1)
    return F.regexp_replace(F.regexp_replace(F.coalesce(last, F.lit("repository")), r"(?i)\.git$", ""), NOT_NAME, "-")


def project_name(path: Column) -> Column:
    base = basename(path)
    parent = F.coalesce(F.try_element_at(segments(path), F.lit(-2)), F.lit(""))
    return F.when((base != "") & (base != "repository"), base).when(parent != "", parent).otherwise("project")


def file_purpose(kind: Column, path: Column) -> Column:
    name = F.lower(basename(path))
    out = F.coalesce(_lookup(kind, rules.TYPE_TITLES), kind)
    for t, table in rules.PURPOSES.items():
        case = None
        for parts, title in table:
            hit = F.rlike(name, F.lit("|".join(parts))) if parts != ("",) else F.lit(True)
            case = F.when(hit, title) if case is None else case.when(hit, title)
        out = F.when(kind == t, F.coalesce(case, _lookup(kind, rules.TYPE_TITLES))).otherwise(out)
    return out


def module_words(types: Column, short: bool) -> Column:
    """The description of a set of types: short form ('-' if none), or the parts of the long one (null if none)."""
    parts = F.filter(
        F.array(*[F.when(F.arrays_overlap(types, F.array(*[F.lit(t) for t in ts])), F.lit(s if short else long)) for ts, long, s in rules.MODULE_WORDS]),
        lambda x: x.isNotNull(),
    )
    if short:
        return F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise("-")
    return F.when(F.size(parts) > 0, F.array_join(parts, " and "))


def sql_dialect(content: Column) -> Column:
    case = None
    for pattern, any_case, name in rules.DIALECTS:
        hit = F.rlike(content, F.lit(("(?i)" if any_case else "") + pattern))
        case = F.when(hit, name) if case is None else case.when(hit, name)
    return case.otherwise("mysql")


def go_batches(sql: Column) -> Column:
    parts = F.transform(F.split(sql, r"(?im)^\s*GO\s*;?\s*$", -1), lambda b: F.trim(b, F.lit(" \t\r\n\f")))
    return F.filter(parts, lambda b: (b != "") & ~F.rlike(b, F.lit(r"(?i)^\s*PRINT\b")))


def pad(value: Column, width: int) -> Column:
    """Pads, never truncates."""
    return F.rpad(value, F.greatest(F.length(value), F.lit(width)), F.lit(" "))
