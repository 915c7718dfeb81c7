"""Type ids and names of records, for unions and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomwire.functions import wire
from fathomwire.plans.types import union

FIRST = 128  # ids below are reserved


class Registry:
    """Records by type id and by name.  A registry is an ordinary value on the driver; what a query needs of it goes into its plan."""

    def __init__(self) -> None:
        self.by_id: dict[int, tuple[str, T.StructType]] = {}
        self.by_name: dict[str, int] = {}

    def register(self, name: str, record: T.StructType, type_id: int | None = None) -> int:
        """The record's new id: ``type_id``, or the first free one from 128 on.  A name or id that is taken is an error, and changes nothing."""
        if name in self.by_name:
            raise ValueError(f"{name} is registered already")
        if type_id is None:
            type_id = max([FIRST - 1, *self.by_id]) + 1
        elif type_id < 1:
            raise ValueError(f"type id {type_id} must be positive")
        if type_id in self.by_id:
            raise ValueError(f"type id {type_id} belongs to {self.by_id[type_id][0]}")
        self.by_id[type_id], self.by_name[name] = (name, record), type_id
        return type_id

    def register_or_get(self, name: str, record: T.StructType, type_id: int | None = None) -> int:
        """The id that ``name`` has, or its new one; the same name with another record is an error."""
        if name not in self.by_name:
            return self.register(name, record, type_id)
        have = self.by_name[name]
        if self.by_id[have][1] != record:
            raise ValueError(f"{name} is registered with other fields")
        return have

    def lookup(self, key: int | str) -> tuple[int, str, T.StructType] | None:
        """(id, name, record) by either."""
        type_id = self.by_name.get(key) if isinstance(key, str) else key
        return (type_id, *self.by_id[type_id]) if type_id in self.by_id else None

    def interface(self, *names: str) -> T.StructType:
        """The union of the named records, or of all."""
        return union({n: (self.by_name[n], self.by_id[self.by_name[n]][1]) for n in names or sorted(self.by_name)})

    def listing(self, spark: SparkSession) -> DataFrame:
        """(type_id, name, type_class, fields) of all."""
        rows = [(i, name, len(record.fields)) for i, (name, record) in sorted(self.by_id.items())]
        return spark.createDataFrame(rows, "type_id int, name string, fields int").select("type_id", "name", wire.type_id_class(F.col("type_id")).alias("type_class"), "fields")

    def clear(self) -> None:
        self.by_id.clear()
        self.by_name.clear()

    def __len__(self) -> int:
        return len(self.by_id)
