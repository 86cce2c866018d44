"""Document stores: Parquet, and any database that Spark's JDBC source reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators.ingest import upsert


class ParquetStore:
    """Documents in versions of a Parquet folder; a version is complete before it becomes the current one."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _versions(self) -> list[int]:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        done = [x.getPath() for x in fs.listStatus(root) if x.isDirectory() and fs.exists(jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName()[1:]) for p in done)

    def scan(self) -> DataFrame | None:
        versions = self._versions()
        return self.spark.read.parquet(f"{self.path}/v{versions[-1]}") if versions else None

    def save(self, batch: DataFrame) -> None:
        """Upserts by id."""
        versions, old = self._versions(), self.scan()
        rows = batch if old is None else upsert(old, batch)
        rows.write.mode("overwrite").parquet(f"{self.path}/v{(versions[-1] if versions else 0) + 1}")

    def get(self, doc_id: str) -> DataFrame | None:
        rows = self.scan()
        return rows if rows is None else rows.where(F.col("id") == doc_id)


LISTS = ("terms", "links", "headings")


def from_jdbc(spark: SparkSession, url: str, table: str = "documents", **options: str) -> DataFrame:
    """Documents of a SQL table whose lists are JSON text; filters on plain columns reach the database.

    Options set the pool: ``partitionColumn``, ``lowerBound``, ``upperBound``
    and ``numPartitions`` read in parallel, ``queryTimeout`` bounds a statement.
    A row whose lists are no JSON is left out.
    """
    rows = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    rows = rows.toDF(*[c.lower() for c in rows.columns])
    lists = {c: F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.array().cast("array<string>")).otherwise(F.from_json(F.col(c).cast("string"), "array<string>")) for c in LISTS if c in rows.columns}
    rows = rows.withColumns(lists)
    fine = F.lit(True)
    for c in lists:
        fine = fine & F.col(c).isNotNull()
    return rows.where(fine)


def upsert_statement(url: str, table: str, staged: str, columns: list[str], key: str = "id") -> str:
    """The statement that puts the rows of a staging table into ``table``, the new ones replacing those of the same key."""
    quoted = {c: f'"{c}"' for c in columns}
    names = ", ".join(quoted.values())
    others, key = [quoted[c] for c in columns if c != key], quoted[key]
    if url.startswith(("jdbc:postgresql:", "jdbc:sqlite:")):
        return f"INSERT INTO {table} ({names}) SELECT {names} FROM {staged} WHERE TRUE ON CONFLICT ({key}) DO UPDATE SET {', '.join(f'{c} = EXCLUDED.{c}' for c in others)}"
    updates, values = ", ".join(f"t.{c} = s.{c}" for c in others), ", ".join(f"s.{c}" for c in quoted.values())
    return f"MERGE INTO {table} t USING {staged} s ON t.{key} = s.{key} WHEN MATCHED THEN UPDATE SET {updates} WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({values})"


def execute(spark: SparkSession, url: str, *statements: str, properties: dict[str, str] | None = None) -> None:
    """Runs statements on one connection of the driver, all or none."""
    jvm = spark._jvm
    settings = jvm.java.util.Properties()
    for k, v in (properties or {}).items():
        settings.setProperty(k, v)
    if "driver" in (properties or {}):
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(properties["driver"])
    connection = jvm.java.sql.DriverManager.getConnection(url, settings)
    try:
        connection.setAutoCommit(False)
        for s in statements:
            statement = connection.createStatement()
            statement.executeUpdate(s)
            statement.close()
        connection.commit()
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()


class JdbcStore:
    """Documents in a SQL table ``table`` with a unique ``id``, whose lists are JSON text.

    ``save`` writes a batch to a staging table in parallel, and one statement
    moves it over; a batch that is repeated has the same effect.
    """

    def __init__(self, spark: SparkSession, url: str, table: str = "documents", **properties: str) -> None:
        self.spark, self.url, self.table, self.properties = spark, url, table, properties

    def scan(self) -> DataFrame:
        return from_jdbc(self.spark, self.url, self.table, **self.properties)

    def get(self, doc_id: str) -> DataFrame:
        return self.scan().where(F.col("id") == doc_id)

    def by_fingerprint(self, fingerprint: str) -> DataFrame:
        """The latest document with a fingerprint; the filter and the order reach the database."""
        return self.scan().where(F.col("content_fingerprint") == fingerprint).orderBy(F.desc("crawled_at")).limit(1)

    def latest(self, limit: int) -> DataFrame:
        return self.scan().orderBy(F.desc("crawled_at"), "id").limit(limit)

    def save(self, batch: DataFrame) -> None:
        """Upserts by id."""
        staged = f"{self.table}_staged"
        rows = batch.withColumns({c: F.to_json(c) for c in LISTS if c in batch.columns})
        rows.write.option("createTableColumnTypes", "id VARCHAR(255)").jdbc(self.url, staged, "overwrite", self.properties)
        execute(self.spark, self.url, upsert_statement(self.url, self.table, staged, rows.columns), f"DROP TABLE {staged}", properties=self.properties)


def open_store(spark: SparkSession, config: Config) -> ParquetStore | JdbcStore:
    """The store that the settings name; a database that does not answer gives way to the Parquet one."""
    if config.store == "jdbc" and config.database_url:
        store = JdbcStore(spark, config.database_url)
        try:
            execute(spark, config.database_url)
            return store
        except Exception:  # the service starts without its database
            pass
    return ParquetStore(spark, config.store_path)
