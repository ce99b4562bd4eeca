"""Tables and derived tables that several queries use, in DataFrame and in SQL form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Registry:
    """Queries by name with their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None):
        def keep(f):
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return keep


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(spark, sf_dir).filter("role = 'user'")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order requests that name a part."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_retailprice")
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.withColumn("text", F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" "), "p_name", F.lit(" alabilir miyim")))


UTT = "select l_orderkey, l_linenumber, l_partkey, l_quantity, p_name, p_type, p_retailprice, concat(cast(cast(l_quantity as int) as varchar), ' ', p_name, ' alabilir miyim') as text from lineitem join part on l_partkey = p_partkey"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dimension of part names: (name, category, price, position)."""
    parts = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_type").alias("category"), F.min("p_retailprice").alias("price"), F.min("p_partkey").alias("position"))
    return parts.withColumn("item_id", F.col("name"))


ITEMS = "select p_name as name, min(p_type) as category, min(p_retailprice) as price, min(p_partkey) as position from part group by p_name"


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order operations from events: (session, item, op, qty, ts, event_id)."""
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type").isin("click", "view"), "add").when(F.col("event_type") == "purchase", "update").when(F.col("event_type") == "error", "remove").otherwise("clear")
    return e.select(F.col("user_id").alias("session"), (F.col("event_id") % 5).alias("item"), op.alias("op"), (F.col("event_id") % 4).cast("int").alias("qty"), "ts", "event_id")


OPS = "select user_id as session, event_id % 5 as item, case when event_type in ('click','view') then 'add' when event_type = 'purchase' then 'update' when event_type = 'error' then 'remove' else 'clear' end as op, cast(event_id % 4 as int) as qty, ts, event_id from events"

#: White space in DuckDB's patterns as the DataFrame form has it.
WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def norm(c: str) -> str:
    return f"trim(regexp_replace({c}, '{WS}', ' ', 'g'))"


def folded(c: str) -> str:
    return f"replace(lower(strip_accents({c})), 'ß', 'ss')"
