"""The ERP tables as a lazy mapping, and readers for stored ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

from shopfloor.schemas import ERP_SCHEMAS


class ErpTables(Mapping[str, DataFrame]):
    """Table name -> DataFrame; a table is built when it is first asked for."""

    def __init__(self, builders: Mapping[str, Callable[[], DataFrame]]):
        self._builders = dict(builders)
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


def erp_from_parquet(spark: SparkSession, directory: str) -> ErpTables:
    """ERP tables stored as ``<directory>/<table>`` parquet; the schema is declared, not inferred."""

    def reader(name: str) -> Callable[[], DataFrame]:
        return lambda: spark.read.schema(ERP_SCHEMAS[name]).parquet(f"{directory}/{name}")

    return ErpTables({name: reader(name) for name in ERP_SCHEMAS})


def erp_from_catalog(spark: SparkSession, database: str = "Erp") -> ErpTables:
    """ERP tables registered in the session catalog under ``database``."""

    def reader(name: str) -> Callable[[], DataFrame]:
        return lambda: spark.table(f"{database}.{name}")

    return ErpTables({name: reader(name) for name in ERP_SCHEMAS})
