"""Licence scans with Spark SQL functions alone.

Every sentence of a text (a header has one or several) and the whole text (a licence file) are compared with licence
templates by the cosine of sparse TF-IDF vectors; the file's licence is that of the best of them. A file without one
inherits from the licence file in the nearest ancestor directory of its path: distinct directories are exploded to
their ancestors, joined with the directories that hold a licence file, and the deepest match is joined back.

Document frequencies count all files. A term outside the templates weighs as one that was never seen. What is compared
follows from the limit: without any of a template's leading terms (its heaviest ones, until the rest has a norm below
the limit) a cosine stays below it, by Cauchy and Schwarz, so texts without any leading term need no comparison.
Broadcast are the templates' terms with their weights, which a fixed list bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored
from .license_templates import TEMPLATES

SENTENCE = r"\n|(?<=[.!?])[ \t]+(?=[A-Z])"
TERM = r"[a-z]+(?:-[a-z]+)*|[0-9]+(?:\.[0-9]+)*"
#: Names of licence files.
NAMED = r"(?i)(?:^|/)(?:(?:un)?licen[cs]e|copying|notice)[^/]*$"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _templates(spark: SparkSession, templates) -> DataFrame:
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, license string, text string")
    return rows.select("template", "license", F.explode(terms(F.col("text"))).alias("term")).groupBy("template", "license", "term").agg(F.count("*").alias("tf"))


def _weights(rows: DataFrame, templates, least: float) -> tuple[DataFrame, DataFrame, float, list[str]]:
    """(idf of the templates' terms, unit template vectors, idf of an unseen term, leading terms)."""
    model = stored(_templates(rows.sparkSession, templates), "templates")
    vocabulary = model.select("term").distinct()
    own = rows.select(F.explode(F.array_distinct(terms(F.col("t")))).alias("term"))
    df = own.join(F.broadcast(vocabulary), "term").groupBy("term").agg(F.count("*").alias("df"))
    total = rows.count()
    idf = vocabulary.join(df, "term", "left").select("term", (F.log(F.lit(total + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0)) + 1.0).alias("idf"))
    idf = stored(idf, "idf")
    vector = model.join(F.broadcast(idf), "term").withColumn("v", (1.0 + F.log("tf")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("template")))
    vector = stored(vector.select("template", "license", "term", (F.col("v") / norm).alias("v")), "vectors")
    rest = F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("template").orderBy(F.desc("v"), "term").rowsBetween(0, Window.unboundedFollowing))
    leading = vector.withColumn("rest", rest).filter(F.col("rest") >= (least - 1e-6) ** 2).select("term").distinct()
    most = rows.sparkSession.range(1).select((F.log(F.lit(total + 1.0)) + 1.0)).first()[0]
    return idf, vector, most, sorted(r["term"] for r in leading.collect())  # at most the templates' terms


def license_scan(files: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", least: float = 0.6, templates=TEMPLATES) -> DataFrame:
    """(doc_id, path, license, how, similarity, license_path) for each row of ``files``.

    how is own (a sentence or the whole of its text), inherited (from the licence file of the nearest ancestor
    directory), unknown or none. A licence file is a text whose whole has a licence, or one with the name of a licence
    file; of several in a directory the smallest path with a licence counts. One so named without a licence that the
    templates know is unknown, and so is what it stands nearest to: neither takes the licence of a neighbour. Of equal similarities the first template counts,
    then the whole text, then the first sentence. Null texts are empty; a null path has no ancestors; repeated rows are
    each returned; an empty table gives no rows.
    """
    rows = files.select(F.col(id_col).cast("long").alias("doc_id"), path.alias("path"), F.col(text_col).alias("t"))
    idf, vector, most, leading = _weights(rows, templates, least)
    marks = F.array(*[F.lit(t) for t in leading])
    held = stored(rows.filter(F.arrays_overlap(terms(F.col("t")), marks)), "speaking")
    units = held.select("doc_id", "path", F.posexplode(F.concat(F.array("t"), F.split("t", SENTENCE))).alias("n", "unit"))
    units = units.filter(F.arrays_overlap(terms(F.col("unit")), marks)).withColumn("key", F.sha2("unit", 256))
    # Equal units are compared once; the first of two counts of a text's terms is within its row.
    words = units.select("key", "unit").dropDuplicates(["key"]).select("key", F.explode(terms(F.col("unit"))).alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"))
    w = words.join(F.broadcast(idf), "term", "left").select("key", "term", ((1.0 + F.log("tf")) * F.coalesce("idf", F.lit(most))).alias("w"))
    norm = w.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    cosine = w.join(F.broadcast(vector), "term").groupBy("key", "template", "license").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    cosine = cosine.join(norm, "key").select("key", "template", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("similarity"))
    best = cosine.groupBy("key").agg(F.max(F.struct("similarity", -F.col("template"), "license")).alias("b")).filter(F.col("b.similarity") >= least)
    own = units.join(best, "key").groupBy("doc_id", "path").agg(
        F.max(F.struct(F.col("b.similarity").alias("similarity"), F.col("b.col2").alias("template"), (-F.col("n")).alias("n"), F.col("b.license").alias("license"))).alias("o"),
        F.max((F.col("n") == 0) | F.coalesce(F.col("path").rlike(NAMED), F.lit(False))).alias("whole"),
    )
    own = stored(own.select("doc_id", "path", "whole", "o.license", "o.similarity"), "own")
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.when(F.col("path").isNotNull(), F.lit("")))
    named = F.coalesce(F.col("path").rlike(NAMED), F.lit(False))
    other = rows.filter(named).select("path").distinct().join(own.select("path"), "path", "left_anti").select("path", F.lit(None).cast("string").alias("license"))
    texts = own.filter("whole").select("path", "license").unionByName(other).withColumn("up", folder)
    files_of = texts.groupBy("up").agg(F.min(F.struct(F.col("license").isNull().alias("unknown"), "path", "license")).alias("f"))
    parts = F.split("dir", "/")
    dirs = rows.select(folder.alias("dir")).filter("dir is not null").distinct()
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.when(k > 0, F.array_join(F.slice(parts, F.lit(1), k), "/")).otherwise(F.lit("")).alias("up")))).alias("a"))
    above = above.select("dir", "a.depth", F.col("a.up").alias("up")).filter("depth = 0 or up <> ''")
    heir = above.join(files_of, "up").groupBy("dir").agg(F.max(F.struct("depth", F.struct("f.license", "f.path"))).alias("h")).select("dir", F.col("h.col2").alias("h"))
    heir = stored(heir, "heirs")  # its size is then known: broadcast when small, else a join whose hot directory Spark can split
    mine = own.select(F.col("doc_id").alias("i"), F.col("path").alias("p"), F.struct("license", "similarity").alias("o"))
    out = rows.select("doc_id", "path", folder.alias("dir"))
    own_or_heir = F.when(F.col("o").isNotNull(), F.col("o.license")).when(~named, F.col("h.license"))
    joined = out.join(mine, F.col("doc_id").eqNullSafe(F.col("i")) & F.col("path").eqNullSafe(F.col("p")), "left").join(heir, "dir", "left")
    return joined.select(
        "doc_id", "path",
        own_or_heir.alias("license"),
        F.when(F.col("o").isNotNull(), "own").when(named | (F.col("h").isNotNull() & F.col("h.license").isNull()), "unknown").when(F.col("h").isNotNull(), "inherited").otherwise("none").alias("how"),
        F.col("o.similarity").alias("similarity"),
        F.when(F.col("o").isNotNull() | named, F.col("path")).otherwise(F.col("h.path")).alias("license_path"),
    )
