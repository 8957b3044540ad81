"""Reading files, databases and topics as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


class SourceError(ValueError):
    """A source that cannot be read as declared."""


def read_parquet(spark: SparkSession, *paths: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(*paths)
    return df if columns is None else df.select(*columns)


def read_csv(
    spark: SparkSession, *paths: str, schema: T.StructType | str | None = None, sep: str = ",", header: bool = True, **options
) -> DataFrame:
    """A declared schema is read as declared; only without one are types inferred (one more pass)."""
    reader = spark.read.options(header=header, sep=sep, **options)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(list(paths))


def read_json_lines(spark: SparkSession, *paths: str, schema: T.StructType, exact: bool = False) -> DataFrame:
    """One object a line; blank lines are skipped, and a broken line lands in ``_corrupt_record``.

    The exact reader refuses binary floats: numbers are declared as integers or decimals.
    """
    if exact:
        floats = [f.name for f in schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
        if floats:
            raise SourceError(f"{floats}: a binary float is not exact; declare a decimal")
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return spark.read.schema(full).option("columnNameOfCorruptRecord", CORRUPT).json(list(paths))


def read_orc(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.orc(list(paths))


def read_avro(spark: SparkSession, *paths: str) -> DataFrame:
    """Needs the external spark-avro package on the classpath."""
    return spark.read.format("avro").load(list(paths))


# What a URI scheme stands for.
DATABASES = {
    "postgres": ("postgresql", "org.postgresql.Driver"),
    "postgresql": ("postgresql", "org.postgresql.Driver"),
    "mysql": ("mysql", "com.mysql.cj.jdbc.Driver"),
    "snowflake": ("snowflake", "net.snowflake.client.jdbc.SnowflakeDriver"),
    "redshift": ("redshift", "com.amazon.redshift.jdbc42.Driver"),
    "sqlserver": ("sqlserver", "com.microsoft.sqlserver.jdbc.SQLServerDriver"),
}


def jdbc_options(uri: str, table: str, columns: Sequence[str]) -> dict[str, str]:
    """Reader options for a database table: the URI's scheme picks the kind, only named columns are read."""
    parts = urlsplit(uri)
    if parts.scheme not in DATABASES:
        raise SourceError(f"no database kind for {parts.scheme!r}")
    if not columns:
        raise SourceError("name the columns to read")
    kind, driver = DATABASES[parts.scheme]
    host = parts.netloc.rsplit("@", 1)[-1]
    listed = ", ".join('"' + c.replace('"', '""') + '"' for c in columns)
    options = {"url": f"jdbc:{kind}://{host}{parts.path}", "driver": driver, "dbtable": f"(SELECT {listed} FROM {table}) AS source"}
    if parts.username:
        options["user"] = parts.username
    if parts.password:
        options["password"] = parts.password
    return options


def jdbc_predicates(column: str, low: int, high: int, partitions: int) -> list[str]:
    """Predicates that split a key range over connections: disjoint, and together the whole table."""
    step = max((high - low + partitions) // partitions, 1)
    edges = [low + step * i for i in range(1, partitions) if low + step * i <= high]
    if not edges:
        return ["1 = 1"]
    first = f"{column} < {edges[0]} OR {column} IS NULL"
    middle = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(edges, edges[1:])]
    return [first, *middle, f"{column} >= {edges[-1]}"]


def read_jdbc(spark: SparkSession, uri: str, table: str, columns: Sequence[str], *, predicates: Sequence[str] = ("1 = 1",)) -> DataFrame:
    options = jdbc_options(uri, table, columns)
    url, dbtable = options.pop("url"), options.pop("dbtable")
    return spark.read.jdbc(url, dbtable, predicates=list(predicates), properties=options)


def kafka_options(servers: str, topic: str, *, starting: str = "earliest", per_trigger: int | None = None) -> dict[str, str]:
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting,
        "failOnDataLoss": "true",
        "includeHeaders": "true",
    }
    if per_trigger:
        options["maxOffsetsPerTrigger"] = str(per_trigger)
    return options


def read_kafka(spark: SparkSession, servers: str, topic: str, **kw) -> DataFrame:
    """A topic as a stream. Needs the external Kafka connector package."""
    return spark.readStream.format("kafka").options(**kafka_options(servers, topic, **kw)).load()


def decode_json(records: DataFrame, value: T.StructType, key: T.StructType | None = None) -> DataFrame:
    """Kafka records with ``value`` and ``key`` decoded, the raw bytes beside them.

    A value that is not JSON of the declared fields keeps its text in ``value._corrupt_record``.
    """

    def decoded(c: str, schema: T.StructType) -> Column:
        # Broken text has to come back beside the other fields, so all of them may be absent.
        fields = [T.StructField(f.name, f.dataType, True) for f in schema.fields]
        full = T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])
        return F.from_json(F.col(c).cast("string"), full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})

    out = records.withColumn("raw_value", F.col("value")).withColumn("value", decoded("value", value))
    if key is not None:
        return out.withColumn("raw_key", F.col("key")).withColumn("key", decoded("key", key))
    return out.withColumn("key", F.col("key").cast("string"))


def decode_avro(records: DataFrame, value_schema: str) -> DataFrame:
    """As :func:`decode_json` for Avro values. Needs the external spark-avro package."""
    from pyspark.sql.avro.functions import from_avro

    return records.withColumn("raw_value", F.col("value")).withColumn(
        "value", from_avro("value", value_schema, {"mode": "PERMISSIVE"})
    )


def rows_and_schema(df: DataFrame, table: str) -> DataFrame:
    """A table's columns, their types and its row count."""
    fields = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("type"))
            for i, f in enumerate(df.schema.fields, 1)
        ]
    )
    return df.agg(F.count("*").alias("rows")).select(F.lit(table).alias("table_name"), F.explode(fields).alias("f"), "rows").select(
        "table_name", "f.*", "rows"
    )


def wire_timestamp(c: Column) -> Column:
    """RFC 3339 in UTC: milliseconds when they hold every digit, else microseconds."""
    exact = F.date_format(c, "SSSSSS").endswith("000")
    return F.when(exact, F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).otherwise(
        F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    )


def wire_form(df: DataFrame) -> DataFrame:
    """The values as a file would hold them: dates as midnight UTC, decimals as text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd'T00:00:00.000Z'")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = wire_timestamp(c)
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def sample_rows(df: DataFrame, columns: Sequence[str], key: Sequence[str], n: int) -> DataFrame:
    """The declared columns of ``n`` rows, the same ones every time."""
    return df.select(*columns).orderBy(*key).limit(n)
