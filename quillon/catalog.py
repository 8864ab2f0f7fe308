"""Tables, columns and indexes described in JSON.

Types are numbers, as in the files: 1 a 64-bit integer, 2 a string of at most 32 bytes.
Indexes are descriptions only: Spark has none, the cost model asks for them.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.sql import types as T

from .errors import DuplicateObjectError, NoSuchObjectError

INT, STRING = 1, 2
SPARK_TYPES = {INT: T.LongType(), STRING: T.StringType()}
STRING_BYTES = 32


@dataclass(frozen=True)
class Column:
    name: str
    type: int


@dataclass(frozen=True)
class Index:
    oid: int
    table_oid: int
    name: str
    kind: str
    key: tuple[str, ...]


@dataclass
class Table:
    oid: int
    name: str
    columns: list[Column]
    indexes: list[Index] = field(default_factory=list)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, SPARK_TYPES[c.type]) for c in self.columns])

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise NoSuchObjectError(f"{self.name} has no column {name}")


class Catalog:
    def __init__(self, path: str | None = None):
        self.path, self.next_oid, self.tables = path, 1, {}

    @classmethod
    def load(cls, path: str) -> Catalog:
        with open(path) as file:
            told = json.load(file)
        out = cls(path)
        for t in told["tables"]:
            indexes = [Index(i["oid"], i["table_oid"], i["name"], i["type"], tuple(i["key_schema"])) for i in t.get("indexes") or []]
            out.tables[t["name"]] = Table(t["oid"], t["name"], [Column(c["name"], c["type"]) for c in t["columns"]], indexes)
        out.next_oid = told["next_id"]
        return out

    def save(self, path: str | None = None) -> None:
        """Writes a file beside the target and puts it in its place at once."""
        target = path or self.path
        told = {"next_id": self.next_oid, "tables": [
            {"oid": t.oid, "name": t.name, "columns": [{"name": c.name, "type": c.type} for c in t.columns],
             "indexes": [{"oid": i.oid, "table_oid": i.table_oid, "name": i.name, "type": i.kind, "key_schema": list(i.key)} for i in t.indexes]}
            for t in self.tables.values()
        ]}
        with open(f"{target}.tmp", "w") as file:
            json.dump(told, file, indent=2)
        os.replace(f"{target}.tmp", target)

    def _oid(self) -> int:
        self.next_oid += 1
        return self.next_oid - 1

    def add_table(self, name: str, columns: list[Column]) -> Table:
        if name in self.tables:
            raise DuplicateObjectError(f"table {name}")
        if len({c.name.lower() for c in columns}) < len(columns):
            raise DuplicateObjectError(f"table {name} names a column twice")
        self.tables[name] = Table(self._oid(), name, list(columns))
        return self.tables[name]

    def add_index(self, name: str, table: str, kind: str, key: list[str]) -> Index:
        owner = self.table(table)
        if kind not in ("hash", "btree"):
            raise ValueError(f"{kind} is neither hash nor btree")
        if any(i.name == name for t in self.tables.values() for i in t.indexes):
            raise DuplicateObjectError(f"index {name}")
        index = Index(self._oid(), owner.oid, name, kind, tuple(owner.column(c).name for c in key))
        owner.indexes.append(index)
        return index

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise NoSuchObjectError(f"table {name}")
        return self.tables[name]

    def table_by_oid(self, oid: int) -> Table:
        for t in self.tables.values():
            if t.oid == oid:
                return t
        raise NoSuchObjectError(f"table {oid}")

    def index_by_oid(self, oid: int) -> Index:
        for t in self.tables.values():
            for i in t.indexes:
                if i.oid == oid:
                    return i
        raise NoSuchObjectError(f"index {oid}")

    def tables_with_column(self, name: str) -> list[Table]:
        return [t for t in self.tables.values() if any(c.name.lower() == name.lower() for c in t.columns)]
