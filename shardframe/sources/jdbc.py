"""Shards in SQL databases, read and written through Spark's JDBC source (the driver's jar has to be on the class path)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: URL and driver class of each kind of server.
SERVERS = {
    "mysql": ("jdbc:mysql://{host}:{port}/{database}", "com.mysql.cj.jdbc.Driver"),
    "mariadb": ("jdbc:mariadb://{host}:{port}/{database}", "org.mariadb.jdbc.Driver"),
    "pgsql": ("jdbc:postgresql://{host}:{port}/{database}", "org.postgresql.Driver"),
    "sqlsrv": ("jdbc:sqlserver://{host}:{port};databaseName={database}", "com.microsoft.sqlserver.jdbc.SQLServerDriver"),
    "sqlite": ("jdbc:sqlite:{database}", "org.sqlite.JDBC"),
    "derby": ("jdbc:derby:{database};create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"),
}


def jdbc_options(connection: dict[str, str], table: str) -> dict[str, str]:
    url, driver = SERVERS[connection.get("driver", "mysql")]
    return {"url": url.format(**connection), "driver": driver, "dbtable": table, "user": connection.get("username", ""), "password": connection.get("password", "")}


def read_shards(spark: SparkSession, connections: dict[str, dict[str, str]], table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8) -> DataFrame:
    """The table on all shards with ``_shard``. A filter on ``_shard`` leaves only the shards that it names, and filters
    and columns go to the servers. With bounds, each shard is read in parts by key."""
    found = []
    for name, connection in connections.items():
        reader = spark.read.format("jdbc").options(**jdbc_options(connection, table))
        if key and bounds:
            reader = reader.options(partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
        found.append(reader.load().withColumn("_shard", F.lit(name)))
    return reduce(DataFrame.unionByName, found)


def write_shards(df: DataFrame, connections: dict[str, dict[str, str]], table: str) -> None:
    """Appends each shard's rows to its database. df is read once for each shard: pass a stored one."""
    for name, connection in connections.items():
        df.where(F.col("_shard") == name).drop("_shard").write.format("jdbc").options(**jdbc_options(connection, table)).mode("append").save()
