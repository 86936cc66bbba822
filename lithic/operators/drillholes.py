"""Collars, surveys and any number of interval tables of the same holes, with the roles of their columns."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from lithic.operators.intervals import ROLES, validate

KEYS = ("hole", "f", "t")


@dataclass(frozen=True)
class IntervalTable:
    """Intervals (hole, f, t and values) and each value column's role."""

    rows: DataFrame
    roles: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        for column, role in self.roles.items():
            self._check(column, role)

    def _check(self, column: str, role: str) -> None:
        if role not in ROLES:
            raise ValueError(f"roles are {ROLES}, not {role!r}")
        if column in KEYS or column not in self.rows.columns:
            raise ValueError(f"{column!r} is not a value column")

    def with_role(self, role: str) -> list[str]:
        if role not in ROLES:
            raise ValueError(f"roles are {ROLES}, not {role!r}")
        return [c for c in self.rows.columns if self.roles.get(c) == role]

    def set_role(self, column: str, role: str) -> IntervalTable:
        self._check(column, role)
        return replace(self, roles=self.roles | {column: role})

    def rename(self, names: dict[str, str]) -> IntervalTable:
        """Value columns by other names, their roles with them. Swaps are allowed, clashes are not."""
        if any(c not in self.rows.columns or c in KEYS for c in names) or any(c in KEYS for c in names.values()):
            raise ValueError("only value columns that are there can be renamed, and not to a key")
        after = [names.get(c, c) for c in self.rows.columns]
        if len(set(after)) < len(after):
            raise ValueError(f"several columns would have one name: {after}")
        return IntervalTable(self.rows.toDF(*after), {names.get(c, c): r for c, r in self.roles.items()})


@dataclass(frozen=True)
class Drillholes:
    """Collars, surveys and interval tables by name, in the order in which they came."""

    collar: DataFrame
    survey: DataFrame | None = None
    tables: dict[str, IntervalTable] = field(default_factory=dict)

    def add_intervals(self, name: str, rows: DataFrame, roles: dict[str, str] | None = None, on_error: str = "warn") -> tuple[Drillholes, DataFrame]:
        """With one table more, and the problems found in it. on_error: "warn" gives them back, "raise" refuses
        a table with errors, "ignore" does not look (no problems are given back)."""
        if on_error not in ("warn", "raise", "ignore"):
            raise ValueError(f"on_error is warn, raise or ignore, not {on_error!r}")
        if name in self.tables:
            raise ValueError(f"there is a table {name!r} already")
        found = validate(rows, self.collar)
        if on_error == "raise" and not found.where("severity = 'error'").isEmpty():
            raise ValueError(f"table {name!r} has errors: {[r.issue for r in found.select('issue').distinct().collect()]}")
        table = IntervalTable(rows, dict(roles or {}))
        return replace(self, tables=self.tables | {name: table}), found.where("false") if on_error == "ignore" else found

    def __getitem__(self, name: str) -> IntervalTable:
        return self.tables[name]

    def _named(self, name: str) -> None:
        if name not in self.tables:
            raise KeyError(f"no table {name!r}; there are {list(self.tables)}")

    def rename(self, table: str, names: dict[str, str]) -> Drillholes:
        self._named(table)
        return replace(self, tables=self.tables | {table: self.tables[table].rename(names)})

    def rename_table(self, name: str, to: str) -> Drillholes:
        """The table by another name, in its old place."""
        self._named(name)
        if to != name and to in self.tables:
            raise ValueError(f"there is a table {to!r} already")
        return replace(self, tables={to if k == name else k: v for k, v in self.tables.items()})

    def drop_table(self, name: str) -> Drillholes:
        self._named(name)
        return replace(self, tables={k: v for k, v in self.tables.items() if k != name})
