"""A run's tables as SQL views: names made safe, stored views, schema browser, parameters."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.sinks import exists, read_text, write_text


def safe_name(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9_]", "_", name).lower()


class Run:
    """Named tables of one run; they are views of this session only."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]):
        self.spark = spark
        self.tables = {safe_name(k): v for k, v in tables.items()}
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)

    def sql(self, text: str, args: list | None = None) -> DataFrame:
        return self.spark.sql(text, args=args) if args else self.spark.sql(text)

    def view(self, name: str, text: str) -> DataFrame:
        self.tables[safe_name(name)] = df = self.spark.sql(text)
        df.createOrReplaceTempView(safe_name(name))
        return df

    def columns(self) -> DataFrame:
        """table_name, column_name, data_type, ordinal."""
        rows = [(t, f.name, f.dataType.simpleString(), i) for t, df in sorted(self.tables.items()) for i, f in enumerate(df.schema)]
        return self.spark.createDataFrame(rows, "table_name string, column_name string, data_type string, ordinal int")

    def save(self, path: str) -> None:
        """Each table as Parquet below path."""
        for name, df in self.tables.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, names: list[str]) -> Run:
        return cls(spark, {n: spark.read.parquet(f"{path}/{safe_name(n)}") for n in names})


class Store:
    """Tables and views that last: Parquet versions below a path, registered in a database, with a list to register them anew.

    A table's new version is written beside the old one and counts once the list
    names it.  Another session of the application sees the database at once; another
    application opens the same path.
    """

    def __init__(self, spark: SparkSession, path: str, database: str):
        self.spark, self.path, self.database = spark, path, safe_name(database)
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.database}")
        self.listed: list[dict] = json.loads(read_text(spark, f"{path}/catalog.json")) if exists(spark, f"{path}/catalog.json") else []
        for x in self.listed:
            self._register(x)

    def _register(self, x: dict) -> None:
        """A table is a view of its version, as sessions remember what a table's name stood for, but not what a view's did."""
        sql = x.get("sql")
        if sql is None:
            version = f"{self.database}.{x['folder'].replace('/', '__')}"
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {version} USING parquet LOCATION '{self.path}/{x['folder']}'")
            sql = f"SELECT * FROM {version}"
        before = self.spark.catalog.currentDatabase()
        self.spark.catalog.setCurrentDatabase(self.database)
        try:
            self.spark.sql(f"CREATE OR REPLACE VIEW {self.database}.{x['name']} AS {sql}")
        finally:
            self.spark.catalog.setCurrentDatabase(before)

    def _list(self, x: dict) -> None:
        """A name keeps its place in the list when it is stored again, so views come after what they read."""
        at = next((i for i, y in enumerate(self.listed) if y["name"] == x["name"]), len(self.listed))
        self.listed[at : at + 1] = [x]
        write_text(self.spark, f"{self.path}/catalog.json", json.dumps(self.listed, ensure_ascii=False))

    def table(self, name: str, df: DataFrame) -> DataFrame:
        x = {"name": safe_name(name), "folder": f"{safe_name(name)}/{uuid.uuid4().hex}"}
        df.write.parquet(f"{self.path}/{x['folder']}")
        self._register(x)
        self._list(x)
        return self.spark.table(f"{self.database}.{x['name']}")

    def view(self, name: str, sql: str) -> DataFrame:
        """sql names tables of this database without it."""
        x = {"name": safe_name(name), "sql": sql}
        self._register(x)
        self._list(x)
        return self.spark.table(f"{self.database}.{x['name']}")

    def drop(self) -> None:
        """The database goes; the files stay and can be opened again."""
        self.spark.sql(f"DROP DATABASE IF EXISTS {self.database} CASCADE")
