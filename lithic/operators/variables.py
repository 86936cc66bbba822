"""A DataFrame of locations with a catalog of what its columns mean: variables, their labels and cut-offs, and metadata."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of variables.
KINDS = ("continuous", "vector", "categorical", "rock_type", "ordered_rock_type", "binary", "anomaly", "compositional", "metadata")


@dataclass(frozen=True)
class Variable:
    """What some columns hold. `columns` are the measurements; a rock type has two, the labels on either side."""

    name: str
    kind: str
    columns: tuple[str, ...]
    labels: tuple[str, ...] = ()
    cutoffs: tuple[float, ...] = ()
    responsibilities: str | None = None


def encoded(column: Column, labels: list[str] | tuple[str, ...]) -> Column:
    """Place of a text among the labels, -1 for any other and for null."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, labels)), column).cast("int") - 1, F.lit(-1))


@dataclass(frozen=True)
class Located:
    """Rows of locations and the variables on them. Every change gives a new one; rows are only planned, never gathered."""

    rows: DataFrame
    variables: dict[str, Variable] = field(default_factory=dict)

    def _with(self, variable: Variable) -> Located:
        if variable.name in self.variables:
            raise ValueError(f"there is a variable {variable.name!r} already")
        missing = [c for c in variable.columns if c not in self.rows.columns]
        if missing:
            raise ValueError(f"no columns {missing}")
        return replace(self, variables=self.variables | {variable.name: variable})

    def _labels(self, columns: tuple[str, ...], labels) -> tuple[str, ...]:
        """The labels given, or the distinct texts of the columns in order; that is one row per label on the driver."""
        if labels is not None:
            return tuple(labels)
        texts = self.rows.select(F.explode(F.array(*columns)).alias("t")).where("t IS NOT NULL").distinct().orderBy("t")
        return tuple(r.t for r in texts.collect())

    def add_continuous(self, name: str, column: str | None = None, cutoffs: list[float] = ()) -> Located:
        return self._with(Variable(name, "continuous", (column or name,), cutoffs=tuple(map(float, cutoffs))))

    def add_vector(self, name: str, columns: list[str]) -> Located:
        return self._with(Variable(name, "vector", tuple(columns), tuple(columns)))

    def add_compositional(self, name: str, columns: list[str]) -> Located:
        return self._with(Variable(name, "compositional", tuple(columns), tuple(columns)))

    def add_categorical(self, name: str, column: str | None = None, labels: list[str] | None = None) -> Located:
        columns = (column or name,)
        return self._with(Variable(name, "categorical", columns, self._labels(columns, labels)))

    def add_binary(self, name: str, column: str | None = None, labels: list[str] | None = None) -> Located:
        columns = (column or name,)
        found = self._labels(columns, labels)
        if len(found) != 2:
            raise ValueError(f"a binary variable has two labels, not {found}")
        return self._with(Variable(name, "binary", columns, found))

    def add_anomaly(self, name: str, label: str, column: str | None = None) -> Located:
        """One label against everything else."""
        return self._with(Variable(name, "anomaly", (column or name,), (label,)))

    def add_rock_type(self, name: str, first: str, second: str | None = None, labels: list[str] | None = None, ordered: bool = False) -> Located:
        """Labels on either side of a location; where they differ it lies on a contact."""
        columns = (first, second or first)
        return self._with(Variable(name, "ordered_rock_type" if ordered else "rock_type", columns, self._labels(columns, labels)))

    def add_metadata(self, name: str, values: Column | str, labels: list[str] | None = None) -> Located:
        """A column that models never see; with labels it is kept as their codes."""
        value = F.col(values) if isinstance(values, str) else values
        rows = self.rows.withColumn(name, encoded(value, labels) if labels is not None else value)
        return replace(self, rows=rows)._with(Variable(name, "metadata", (name,), tuple(labels or ())))

    def metadata(self, name: str) -> Column:
        """The metadata as it was given: texts again where codes are kept."""
        v = self._known(name, "metadata")
        return F.get(F.array(*map(F.lit, v.labels)), F.when(F.col(name) >= 0, F.col(name))) if v.labels else F.col(name)

    def _known(self, name: str, *kinds: str) -> Variable:
        if name not in self.variables or (kinds and self.variables[name].kind not in kinds):
            raise KeyError(f"no {' or '.join(kinds) or 'variable'} {name!r}")
        return self.variables[name]

    def drop(self, name: str) -> Located:
        """Without the variable, and without its columns unless another one has them."""
        gone = self._known(name)
        rest = {k: v for k, v in self.variables.items() if k != name}
        held = {c for v in rest.values() for c in v.columns}
        return replace(self, rows=self.rows.drop(*(c for c in gone.columns if c not in held)), variables=rest)

    def set_cutoffs(self, name: str, cutoffs: list[float]) -> Located:
        v = self._known(name, "continuous")
        return replace(self, variables=self.variables | {name: replace(v, cutoffs=tuple(sorted(map(float, cutoffs))))})

    def set_responsibilities(self, name: str, column: str) -> Located:
        """An array column with each location's membership of the noise components."""
        return replace(self, variables=self.variables | {name: replace(self._known(name), responsibilities=column)})

    def copy_to(self, name: str, other: Located) -> Located:
        """The variable's definition on another set of locations, where nothing is measured yet."""
        v = self._known(name)
        rows = other.rows.withColumns({c: F.lit(None).cast(self.rows.schema[c].dataType) for c in v.columns if c not in other.rows.columns})
        return replace(other, rows=rows)._with(v)

    def carry_to(self, more: DataFrame, keep: Column | None = None) -> Located:
        """All variables on a longer set of locations: the rows kept, then new ones without measurements."""
        kept = self.rows if keep is None else self.rows.where(keep)
        return replace(self, rows=kept.unionByName(more, allowMissingColumns=True).select(*self.rows.columns))

    def containing(self, column: str) -> str | None:
        """The variable that a column is a part of."""
        return next((v.name for v in self.variables.values() if column in v.columns), None)

    def codes(self, name: str) -> list[Column]:
        """The variable's measurements as numbers: codes of labels, 1 or 0 of an anomaly, values of all others."""
        v = self._known(name)
        if v.kind == "anomaly":
            return [(F.col(v.columns[0]) == v.labels[0]).cast("int").alias(v.name)]
        if v.kind in ("categorical", "binary", "rock_type", "ordered_rock_type"):
            return [encoded(F.col(c), v.labels).alias(f"{v.name}_{i}") for i, c in enumerate(v.columns)]
        return [F.col(c) for c in v.columns]

    def on_contact(self, name: str) -> Column:
        """Whether the labels on either side differ."""
        a, b = self._known(name, "rock_type", "ordered_rock_type").columns
        return ~F.col(a).eqNullSafe(F.col(b))
