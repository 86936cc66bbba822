"""Addresses in a nested schema: slash paths, globs and names for export."""

from __future__ import annotations

import warnings
from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parts(path: str) -> tuple[str, ...]:
    return tuple(p for p in path.split("/") if p)


def walk(schema: T.StructType, prefix: tuple[str, ...] = ()):
    """Every field of a schema with its path, parents first."""
    for f in schema.fields:
        if "/" in f.name:
            raise ValueError(f"a name can't hold a slash: {f.name!r}")
        here = (*prefix, f.name)
        yield here, f.dataType
        if isinstance(f.dataType, T.StructType):
            yield from walk(f.dataType, here)


def leaves(schema: T.StructType) -> list[tuple[str, ...]]:
    return [p for p, kind in walk(schema) if not isinstance(kind, T.StructType)]


def matches(pattern: tuple[str, ...], path: tuple[str, ...]) -> bool:
    """Segment by segment: `*` and other globs stand within one segment, `**` for any number of them."""
    if not pattern:
        return not path
    if pattern[0] == "**":
        return any(matches(pattern[1:], path[i:]) for i in range(len(path) + 1))
    return bool(path) and fnmatchcase(path[0], pattern[0]) and matches(pattern[1:], path[1:])


def select_paths(schema: T.StructType, pattern: str = "**") -> list[tuple[str, ...]]:
    return [p for p in leaves(schema) if matches(parts(pattern), p)]


def column(path: tuple[str, ...]) -> Column:
    out = F.col(f"`{path[0]}`")
    for p in path[1:]:
        out = out.getField(p)
    return out


def get(df: DataFrame, path: str, key: float | None = None) -> Column:
    """The column at a path; with `key`, a value of a map column. Unknown paths list what comes next."""
    p, schema = parts(path), df.schema
    for i, name in enumerate(p):
        if not isinstance(schema, T.StructType) or name not in schema.fieldNames():
            known = schema.fieldNames() if isinstance(schema, T.StructType) else []
            raise KeyError(f"nothing at {'/'.join(p[: i + 1])!r}; next could be {known}")
        schema = schema[name].dataType
    out = column(p)
    return out if key is None else F.try_element_at(out, F.lit(float(key)))


def render(path: tuple[str, ...], style: str = "path") -> str:
    seps = {"path": "/", "flat": "_", "pretty": " - "}
    if style not in seps:
        raise ValueError(f"styles are {sorted(seps)}")
    return seps[style].join(path)


def render_all(paths: list[tuple[str, ...]], style: str = "flat") -> dict[tuple[str, ...], str]:
    """Distinct names; of paths that collide the first keeps the name and later ones are numbered."""
    groups: dict[str, list] = {}
    for p in paths:
        groups.setdefault(render(p, style), []).append(p)
    out = {}
    for name, members in groups.items():
        if len(members) > 1:
            warnings.warn(f"{len(members)} paths share the name {name!r}", stacklevel=2)
        for i, p in enumerate(sorted(members)):
            out[p] = name if i == 0 else f"{name}_{i + 1}"
    return out


def flatten(df: DataFrame, include: str = "**", style: str = "flat") -> DataFrame:
    """All leaves that match as plain columns."""
    names = render_all(select_paths(df.schema, include), style)
    return df.select(*(column(p).alias(n) for p, n in names.items()))


def tree(schema: T.StructType) -> str:
    return "\n".join("  " * (len(p) - 1) + p[-1] + ("" if isinstance(k, T.StructType) else f": {k.simpleString()}") for p, k in walk(schema))
