"""Sources and sinks: JSON lines, nested dialogues, small dimensions, CSV, split and tagged tables."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftwork.functions.text import clean_text, first_truthy, norm_label
from weftwork.sources.json_array import array_records


def parse_lines(lines: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """Non-blank lines with parsed fields and problem: null, bad_json or not_an_object."""
    text = lines.filter(F.trim(F.col(value)) != "")
    parsed = F.from_json(value, f"{schema}, __bad string", {"columnNameOfCorruptRecord": "__bad", "mode": "PERMISSIVE"})
    out = text.withColumn("__p", parsed)
    problem = F.when(~F.trim(F.col(value)).startswith("{"), F.when(F.get_json_object(value, "$").isNull(), "bad_json").otherwise("not_an_object")).when(F.col("__p.__bad").isNotNull(), "bad_json")
    names = T.StructType.fromDDL(schema).names
    return out.select(*lines.columns, *[F.col(f"__p.{n}").alias(n) for n in names], problem.alias("problem"))


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block, place): lines with their file, the start of their byte range, and their place in the order of reading."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))


def numbered(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """``rows`` of :func:`placed_lines` with their line number in the file, from 1.

    Lines are counted by byte range, and the counts before a range are added to the place inside it; only the rows
    asked for are joined with these counts.
    """
    ranges = lines.groupBy("file", "block").agg(F.count("*").alias("__n"), F.min("place").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = ranges.select("file", "block", "__first", before.alias("__before"))
    return rows.join(at, ["file", "block"]).withColumn("line", F.col("place") - F.col("__first") + F.col("__before") + 1).drop("__first", "__before")


def read_jsonl(spark: SparkSession, path: str, schema: str, mode: str = "strict") -> DataFrame | tuple[DataFrame, DataFrame]:
    """JSON lines. strict: a bad line is an error that names file and line; quarantine: (good rows, bad lines with file, line and problem)."""
    lines = placed_lines(spark, path)
    rows = parse_lines(lines, schema)
    good = rows.filter("problem is null").drop("value", "problem", "file", "block", "place")
    bad = numbered(rows.filter("problem is not null").select("value", "file", "block", "place", "problem"), lines).select("file", "line", "value", "problem")
    if mode == "quarantine":
        return good, bad
    if first := bad.orderBy("file", "line").limit(1).collect():
        raise ValueError(f"{first[0].file}, line {first[0].line}: {first[0].problem}: {first[0]['value'][:200]}")
    return good


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    df.select(*columns).write.option("header", True).csv(path)


def write_splits(df: DataFrame, split: str, path: str, names: Sequence[str]) -> dict[str, int]:
    """One folder a split in one write, with a manifest of the rows of each; returns the rows written.

    Only the splits written are replaced, so a second run leaves no double rows. The rows are counted by the write
    itself; the manifest follows it, so :func:`read_splits` sees a write that did not end. ``names``: all splits there
    may be; a row of another is an error.
    """
    spark = df.sparkSession
    watch = Observation(f"splits-{uuid.uuid4().hex}")
    counts = [F.count_if(F.col(split) == n).alias(f"n{i}") for i, n in enumerate(names)]
    known = F.when(F.col(split).isin(*names), F.col(split)).otherwise(F.raise_error(F.concat(F.lit("no such split: "), F.coalesce(F.col(split).cast("string"), F.lit("null")))).cast("string"))
    checked = df.withColumn(split, known)
    checked.observe(watch, *counts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(split).parquet(f"{path}/data")
    found = {n: watch.get[f"n{i}"] for i, n in enumerate(names)}
    kept = {r.split: r.rows for r in _manifest(spark, path).collect()} if _exists(spark, f"{path}/manifest") else {}
    spark.createDataFrame(sorted((kept | {n: c for n, c in found.items() if c}).items()), "split string, rows long").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return found


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("split string, rows long").json(f"{path}/manifest")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_splits(spark: SparkSession, path: str, split: str) -> DataFrame:
    """What :func:`write_splits` wrote; an error where a split does not hold the rows of the manifest."""
    rows = spark.read.parquet(f"{path}/data").withColumn(split, F.col(split).cast("string"))
    held = rows.groupBy(F.col(split).alias("split")).agg(F.count("*").alias("held"))
    if odd := _manifest(spark, path).join(held, "split", "full").filter("not (rows <=> held)").orderBy("split").limit(5).collect():
        raise ValueError(f"{path}: {[(r.split, r.rows, r.held) for r in odd]} (split, rows of the manifest, rows there)")
    return rows


DIALOGUE = "conversation_id string, id string, dialogue_id string, utterances array<struct<index:bigint,speaker:string,role:string,participant:string,author:string,text:string,utterance:string,transcript:string,content:string,segments:array<struct<annotations:array<struct<name:string>>>>>>"


def read_dialogues(spark: SparkSession, path: str) -> DataFrame:
    """Files that hold an array of dialogues each; a large file is read by several tasks."""
    return array_records(spark, path).select(F.from_json("record", DIALOGUE, {"mode": "FAILFAST"}).alias("d")).select("d.*")


def extract_turns(dialogues: DataFrame, labels: Sequence[str] = ("USER", "CUSTOMER")) -> DataFrame:
    """(conversation_id, turn_index, original_text) of user turns with text; the speaker is the first alias that matches."""
    turns = dialogues.select(first_truthy(F.col("conversation_id"), F.col("id"), F.col("dialogue_id")).alias("conversation_id"), F.posexplode("utterances").alias("at", "u"))
    aliases = F.array(*[norm_label(F.col(f"u.{a}")) for a in ("speaker", "role", "participant", "author")])
    is_user = F.exists(aliases, lambda a: reduce(lambda x, y: x | y, [a.startswith(p) for p in labels]))
    text = clean_text(F.coalesce("u.text", "u.utterance", "u.transcript", "u.content"))
    return turns.filter(F.coalesce(is_user, F.lit(False))).select("conversation_id", F.coalesce("u.index", F.col("at").cast("long")).alias("turn_index"), text.alias("original_text")).filter("original_text is not null")


def dim_from_records(spark: SparkSession, rows: Sequence[Mapping], schema: T.StructType, defaults: Mapping | None = None) -> DataFrame:
    """A small dimension from records (such as a parsed YAML list): defaults for missing keys, numbers as the schema has them."""
    floats = {f.name for f in schema if isinstance(f.dataType, T.DoubleType)}
    value = lambda r, n: (float(v) if n in floats and v is not None else v) if (v := r.get(n, (defaults or {}).get(n))) is not None else None
    return spark.createDataFrame([tuple(value(r, f.name) for f in schema) for r in rows], schema)


#: A menu entry: absent fields take these values; texts, lists and numbers are coerced.
MENU = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "name", "category", "description")] + [T.StructField("price", T.DoubleType()), T.StructField("availability", T.BooleanType())] + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("allergens", "tags", "aliases")])
MENU_DEFAULTS = {"id": "", "name": "", "category": "", "description": "", "price": 0.0, "availability": False, "allergens": (), "tags": (), "aliases": ()}
#: A dimension file is parsed on the driver, up to so many characters.
MOST_YAML = 16_000_000


def coerced(value, kind: T.DataType, default):
    """A parsed value in the type of its field: an absent one is the default, a null list is empty, anything is a text."""
    if isinstance(kind, T.ArrayType):
        return [str(x) for x in (value or default or ())]
    if value is None:
        return default
    return {T.DoubleType: float, T.BooleanType: bool, T.LongType: int}.get(type(kind), str)(value)


def dim_from_yaml(spark: SparkSession, path: str, key: str = "menu", schema: T.StructType = MENU, defaults: Mapping = MENU_DEFAULTS) -> DataFrame:
    """A small dimension from the list under ``key`` of a YAML file, with its place in the list as ``position``.

    An empty file, or one without the key, has no rows; an entry that is no mapping is an error. A file of more than
    ``MOST_YAML`` characters is an error: it is no small dimension.
    """
    import yaml  # not needed by anything else

    texts = spark.read.text(path, wholetext=True).select(F.length("value").alias("n"), F.when(F.length("value") <= MOST_YAML, F.col("value")).alias("value")).limit(2).collect()
    if len(texts) > 1 or any(t.n > MOST_YAML for t in texts):
        raise ValueError(f"{path}: one file of at most {MOST_YAML} characters is needed")
    entries = (yaml.safe_load(texts[0]["value"]) or {}).get(key) or [] if texts else []
    if any(not isinstance(e, Mapping) for e in entries):
        raise ValueError(f"{path}: an entry of {key} is no mapping")
    rows = [(*[coerced(e.get(f.name), f.dataType, defaults.get(f.name)) for f in schema], i) for i, e in enumerate(entries)]
    return spark.createDataFrame(rows, T.StructType([*schema, T.StructField("position", T.IntegerType())]))


def tag_and_union(frames: Mapping[str, DataFrame], tag: str = "source_domain") -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [df.withColumn(tag, F.lit(name)) for name, df in frames.items()])


def to_worksheet(df: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """``df`` with review columns at their defaults."""
    return df.select("*", *[c.alias(n) for n, c in defaults.items()])
