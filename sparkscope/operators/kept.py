"""What was computed of tables' columns, kept while a person drops and renames columns, so that only what is new is computed.

Everything kept is known by the column of the table as it was given, whatever its name is now: facts and distinct values a
column, counts a pair of columns. A renamed column takes its own with it, a dropped one leaves it unused, and a table that
is replaced loses it. Rows are written once in the shared folder; a session that lost executors reads them again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .overlap import fuzzy_pairs, pair_overlaps
from .profile import distinct_values, scalar_columns
from .sketches import column_facts

COLUMN, PAIR = ["table", "column"], ["table1", "column1", "table2", "column2"]


class KeptColumns:
    """Tables under their columns' present names, with what is known of the columns.

    dropped, renamed and replaced give the tables after a change and leave this one as it is; all of them share what is kept. A
    DataFrame is taken to give the same rows for as long as it is not replaced. scanned tells what was read from the tables.
    """

    def __init__(self, tables: dict[str, DataFrame], names: dict[str, dict[str, str]] | None = None, store: dict[str, dict] | None = None):
        self._tables = dict(tables)
        self._names = names or {t: {c: c for c in scalar_columns(df)} for t, df in tables.items()}
        self._store: dict[str, dict] = store if store is not None else {}
        self.scanned: list[tuple[str, str]] = []

    @property
    def columns(self) -> dict[str, list[str]]:
        return {t: list(names) for t, names in self._names.items()}

    @property
    def tables(self) -> dict[str, DataFrame]:
        """The tables with the columns that are left, of scalar types, under their present names."""
        return {t: df.select(*[F.col(f"`{self._names[t][c]}`").alias(c) for c in self._names[t]]) for t, df in self._tables.items()}

    def dropped(self, table: str, *columns: str) -> KeptColumns:
        names = self._names[table]
        if unknown := [c for c in columns if c not in names]:
            raise KeyError(f"{table} has no {', '.join(unknown)}")
        return KeptColumns(self._tables, self._names | {table: {c: o for c, o in names.items() if c not in columns}}, self._store)

    def renamed(self, table: str, to: dict[str, str]) -> KeptColumns:
        names = self._names[table]
        if unknown := [c for c in to if c not in names]:
            raise KeyError(f"{table} has no {', '.join(unknown)}")
        found = [to.get(c, c) for c in names]
        if len({*found}) < len(found):
            raise ValueError(f"two columns of {table} would have one name")
        return KeptColumns(self._tables, self._names | {table: dict(zip(found, names.values()))}, self._store)

    def replaced(self, table: str, df: DataFrame) -> KeptColumns:
        """The table with other rows and columns; what is kept of the other tables stays."""
        of_it = lambda key: table in key[::2]
        store = {kind: {k: v for k, v in made.items() if not of_it(k)} for kind, made in self._store.items()}
        return KeptColumns(self._tables | {table: df}, self._names | {table: {c: c for c in scalar_columns(df)}}, store)

    def _origin(self, present: tuple) -> tuple:
        return tuple(x for t, c in zip(present[::2], present[1::2]) for x in (t, self._names[t][c]))

    def _by_table(self, keys: Iterable[tuple]) -> dict[str, list[str]]:
        found: dict[str, list[str]] = {}
        for key in sorted({k[i : i + 2] for k in keys for i in range(0, len(k), 2)}):
            found.setdefault(key[0], []).append(key[1])
        return found

    def _read(self, kind: str, wanted: Iterable[tuple], on: list[str]) -> DataFrame:
        """Rows kept of the wanted columns, or pairs of them, under their present names."""
        frames: dict[int, tuple[DataFrame, list[tuple]]] = {}
        for present in sorted({*wanted}):
            frame = self._store[kind][self._origin(present)]
            frames.setdefault(id(frame), (frame, []))[1].append(present)
        parts, new = [], [f"new_{c}" for c in on]
        for frame, some in frames.values():
            keys = [self._origin(p) for p in some]
            if keys == some and len(keys) == sum(f is frame for f in self._store[kind].values()):
                parts.append(frame)  # all of it, under the names it has
                continue
            # These reach the scan and skip row groups, as rows were written in this order; the join with a row a key does the rest.
            within = reduce(lambda x, y: x & y, [F.col(c).isin(sorted({k[i] for k in keys})) for i, c in enumerate(on)])
            names = frame.sparkSession.createDataFrame([(*k, *p) for k, p in zip(keys, some)], ", ".join(f"{c} string" for c in (*on, *new)))
            parts.append(frame.where(within).join(F.broadcast(names), on).drop(*on).withColumnsRenamed(dict(zip(new, on))).select(*frame.columns))
        return reduce(DataFrame.unionByName, parts)

    def _make(self, kind: str, wanted: Iterable[tuple], make: Callable[[list[tuple]], DataFrame]) -> None:
        """Computes what is not kept yet; make gets it by origin."""
        made = self._store.setdefault(kind, {})
        missing = sorted({self._origin(p) for p in wanted} - {*made})
        if missing:
            frame = written(make(missing), kind)
            made |= {k: frame for k in missing}

    def facts(self, wanted: set[tuple], forms: Callable, formed: set[tuple]) -> DataFrame:
        """column_facts of the wanted columns; those in formed with sketches of their forms."""
        of_forms = {self._origin(p) for p in formed}
        known = self._store.setdefault("facts", {})
        with_forms = self._store.setdefault("formed", {})
        for key in of_forms - {*with_forms}:
            known.pop(key, None)  # the texts are known, their forms are not

        def make(missing: list[tuple]) -> DataFrame:
            self.scanned += missing
            with_forms.update({k: True for k in missing if k in of_forms})
            return column_facts(self._tables, self._by_table(missing), forms, {*missing} & of_forms)

        self._make("facts", wanted, make)
        return self._read("facts", wanted, COLUMN)

    def values(self, wanted: Iterable[tuple]) -> DataFrame:
        """(table, column, value, n) of the distinct values, nulls left out."""
        wanted = [*wanted]

        def make(missing: list[tuple]) -> DataFrame:
            self.scanned += missing
            return distinct_values(self._tables, self._by_table(missing)).where("value is not null").sortWithinPartitions("table", "column")

        self._make("values", wanted, make)
        return self._read("values", wanted, COLUMN)

    def _of_pairs(self, kind: str, pairs: Iterable[tuple], make: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        """Rows of the pairs of columns; make gets the values and the pairs, both by origin, of those that are not kept yet."""
        pairs = {p[:4] for p in pairs}
        self.values({p[i : i + 2] for p in pairs for i in (0, 2)})
        as_given = KeptColumns(self._tables, None, self._store)

        def of(missing: list[tuple]) -> DataFrame:
            values = as_given.values({k[i : i + 2] for k in missing for i in (0, 2)})
            wanted = values.sparkSession.createDataFrame(missing, ", ".join(f"{c} string" for c in PAIR))
            return make(values, wanted).join(F.broadcast(wanted), PAIR, "left_semi")

        self._make(kind, pairs, of)
        return self._read(kind, pairs, PAIR)

    def overlaps(self, pairs: Iterable[tuple]) -> DataFrame:
        """pair_overlaps of the pairs."""
        return self._of_pairs("overlaps", pairs, lambda values, _: pair_overlaps(values))

    def fuzzy(self, pairs: Iterable[tuple]) -> DataFrame:
        """fuzzy_pairs of the pairs."""
        return self._of_pairs("fuzzy", pairs, fuzzy_pairs)

    def formats(self, pairs: Iterable[tuple], make: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        """What make gives of values and pairs, for the pairs."""
        return self._of_pairs("formats", pairs, make)

    def sizes(self, wanted: Iterable[tuple]) -> dict[tuple, int]:
        """Distinct values of each column that has some."""
        wanted, known = [*wanted], self._store.setdefault("sizes", {})
        if missing := [p for p in wanted if self._origin(p) not in known]:
            known |= {self._origin(p): 0 for p in missing}
            for r in self.values(missing).groupBy(*COLUMN).agg(F.count("*").alias("n")).collect():  # a row a column
                known[self._origin((r["table"], r["column"]))] = r["n"]
        return {p: n for p in wanted if (n := known[self._origin(p)])}
