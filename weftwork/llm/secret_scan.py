"""Secret scans with Spark SQL functions alone.

Three base kinds come from patterns: ``assign`` (a keyword, a separator and a value of 8 or more characters),
``access`` (AKIA and capitals or digits, 16 or more characters) and ``hex`` (32 or more lower-case hex digits).
Matches are leftmost and non-overlapping per kind; failing ones are dropped after matching.

The method adds ``entropy`` spans: candidate strings are runs of 20 or more key characters. A window of 20 characters
slides over each; its Shannon entropy comes from character counts that change by one character in and one out. A
candidate is reported where a window reaches the threshold of its character class (hex, mixed-case base64, other),
unless the allow-list knows it: words without a digit, placeholders, and paths.

Only documents that a cheap pattern admits are taken apart, so plain texts cost one regular expression a kind.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.functions.text import once

ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A match of these two is never part of a longer run, so the shortest length can stand in the pattern itself: what it
# leaves out are whole runs that are too short. Runs are possessive and start at their first character, so each
# character is read a bounded number of times, however long a run is.
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
KINDS = ("assign", "access", "hex")
_KEY = r"[A-Za-z0-9+/_=-]"


@dataclass(frozen=True)
class Entropy:
    window: int = 20
    hex_bits: float = 3.0
    mixed_bits: float = 3.7
    other_bits: float = 3.9
    #: Spans that are known to be no secrets.
    allow: str = r"(?i)^(?:[a-z_/.=+-]+|.*(?:example|placeholder|dummy|sample|changeme|xxxx|0000|1234567).*|(?:https?|www)[:/.].*)$"


#: Spans are walked in chunks of so many: an array is copied at each step, so a walk over all of them would be quadratic.
CHUNK = 256


def _walked(items: Column, start: Column, kind: str, step) -> Column:
    """Array over ``items`` of what ``step`` (place, item) gives: (next place, array to add); linear in the items.

    Chunks are walked twice: once for the place at which each ends, then from these places for the arrays. ``kind`` is
    the type of the array.
    """
    chunks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(CHUNK)), lambda i: F.slice(items, i, CHUNK))
    ends = lambda c, at: F.aggregate(c, at, lambda acc, x: step(acc, x)[0])

    def from_places(c):
        zero = F.struct(start.alias("at"), F.array().cast("array<int>").alias("places"))
        places = F.aggregate(c, zero, lambda acc, chunk: F.struct(ends(chunk, acc["at"]).alias("at"), F.concat(acc["places"], F.array(acc["at"])).alias("places")), lambda acc: acc["places"])
        return F.flatten(F.zip_with(c, places, whole))

    def whole(chunk, place):
        def add(acc, x):
            at, new = step(acc["at"], x)
            return F.struct(at.alias("at"), F.concat(acc["found"], new).alias("found"))

        return F.aggregate(chunk, F.struct(place.alias("at"), F.array().cast(kind).alias("found")), add, lambda acc: acc["found"])

    return once(chunks, from_places)


def _spans(text: Column, pattern: str, keep, kind: str) -> Column:
    """Array of (start, rank, end, kind, hit) in code points of the matches that ``keep`` (match, first group) admits."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if pattern == ASSIGN else whole
    between = F.split(text, pattern, -1)
    rank = (*KINDS, "entropy").index(kind)
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,hit:string>>")

    def step(at, x):
        start = at + x["gap"]
        end = start + x["length"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x["hit"].alias("hit"))
        return end, F.when(x["kept"], F.array(span)).otherwise(none)

    pairs = F.arrays_zip(F.slice(between, F.lit(1), F.size(whole)).alias("gap"), whole.alias("hit"), group.alias("value"))
    items = F.transform(pairs, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("length"), x["hit"].alias("hit"), keep(x["hit"], x["value"]).alias("kept")))
    return once(items, lambda z: _walked(z, F.lit(0), "array<struct<start:int,rank:int,end:int,kind:string,hit:string>>", step))


def _peak_entropy(candidate: Column, window: int, enough: Column | None = None) -> Column:
    """The largest entropy (bits) of any window, by counts that move by one character in and one out.

    With ``enough``, windows after one that reaches it are not looked at.
    """
    plogp = lambda n: F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))
    chars = F.split(candidate, "")
    # Each character with the one that leaves the window when it comes in (null before the window is full).
    steps = F.arrays_zip(chars.alias("c"), F.concat(F.array_repeat(F.lit(None).cast("string"), window), chars).alias("out"))
    steps = F.slice(steps, F.lit(1), F.size(chars))
    none = F.create_map().cast("map<string,int>")
    limit = F.lit(None).cast("double") if enough is None else enough.cast("double")
    zero = F.struct(none.alias("n"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("peak"), F.lit(0).alias("i"), limit.alias("enough"))
    bits = float(window)

    def step(acc, x):
        c, out = x["c"], x["out"]
        n_in = F.coalesce(F.try_element_at(acc["n"], c), F.lit(0))
        n_out = F.coalesce(F.try_element_at(acc["n"], out), F.lit(0))
        change = plogp(n_in + 1) - plogp(n_in) + F.when(out.isNull(), 0.0).otherwise(plogp(n_out - 1) - plogp(n_out))
        moved = F.map_concat(
            F.map_filter(acc["n"], lambda k, v: (k != c) & (out.isNull() | (k != out))),
            F.create_map(c, n_in + 1),
            F.when(out.isNull() | (n_out <= 1), none).otherwise(F.create_map(F.coalesce(out, F.lit("")), n_out - 1)),
        )

        def after(counts, total):
            full = acc["i"] + 1 >= window
            peak = F.when(full, F.greatest(acc["peak"], F.log2(F.lit(bits)) - total / bits)).otherwise(acc["peak"])
            return F.struct(counts.alias("n"), total.alias("sum"), peak.alias("peak"), (acc["i"] + 1).alias("i"), acc["enough"].alias("enough"))

        # What comes in is often what goes out in runs of one character: nothing changes then.
        moving = F.when(out.eqNullSafe(c), after(acc["n"], acc["sum"])).otherwise(after(moved, acc["sum"] + change))
        return F.when(acc["peak"] >= acc["enough"], acc).otherwise(moving)

    return F.aggregate(steps, zero, step, lambda acc: acc["peak"])


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", entropy: Entropy | None = Entropy(), carry: bool = False) -> DataFrame:  # noqa: B008
    """``docs`` with columns __base and __extra: arrays of (start, rank, end, kind, hit), each in order.

    A null text is empty and has no spans. Rows and their ids are kept as they are, repeated and null ones included.
    With ``carry`` all input columns stay, as __c0, __c1, ...; otherwise only doc_id. The whole text is __text.
    """
    if carry:  # no name of theirs meets one of ours
        rows = docs.toDF(*[f"__c{i}" for i in range(len(docs.columns))])
        rows = rows.withColumn("__text", F.coalesce(F.col(f"__c{docs.columns.index(text_col)}"), F.lit("")))
    else:
        rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,hit:string>>")
    t = F.col("__text")
    every = lambda hit, value: F.lit(True)
    found = {"assign": _spans(t, ASSIGN, lambda hit, value: F.length(value) >= 8, "assign"), "access": _spans(t, ACCESS, every, "access"), "hex": _spans(t, HEX, every, "hex")}
    admit = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}
    rows = rows.withColumn("__base", F.array_sort(F.concat(*[F.when(t.rlike(admit[k]), found[k]).otherwise(none) for k in KINDS])))
    if entropy is None:
        return rows.withColumn("__extra", none)
    run = rf"(?<!{_KEY}){_KEY}{{{entropy.window},}}+"
    # The same with a digit in the run: without one the allow-list lets none pass.
    admits = t.rlike(rf"(?<!{_KEY})(?={_KEY}{{{entropy.window}}})[A-Za-z+/_=-]*+[0-9]")
    limit = lambda c: F.when(c.rlike(r"^[0-9a-fA-F]+$"), entropy.hex_bits).when(c.rlike("[a-z]") & c.rlike("[A-Z]") & c.rlike("[0-9]"), entropy.mixed_bits).otherwise(entropy.other_bits)
    candidates = _spans(t, run, lambda hit, value: hit.rlike("[0-9]") & ~hit.rlike(entropy.allow), "entropy")
    high = F.filter(candidates, lambda s: _peak_entropy(s["hit"], entropy.window, limit(s["hit"])) >= limit(s["hit"]))
    return rows.withColumn("__extra", F.when(admits, high).otherwise(none))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, the digest of the base spans, and all spans in order."""
    s = secret_spans(docs, id_col, text_col)
    n = lambda k: F.size(F.filter("__base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return s.select("doc_id", *[n(k) for k in KINDS], F.sha2(_written(F.col("__base")), 256).alias("base_sha256"), _written(F.array_sort(F.concat("__base", "__extra"))).alias("spans"))


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each stretch of secret spans (overlapping ones as one) replaced by ``mark``; all rows and columns stay.

    A text without spans, a null one included, is unchanged.
    """
    s = secret_spans(docs, text_col=text_col, carry=True).withColumn("__all", F.array_sort(F.concat("__base", "__extra")))
    t = F.col("__text")
    step = lambda at, x: (F.greatest(at, x["end"]), F.when(x["start"] >= at, F.array(F.struct(at.alias("from"), x["start"].alias("to")))).otherwise(F.array().cast("array<struct<from:int,to:int>>")))
    s = s.withColumn("__gaps", _walked(F.col("__all"), F.lit(0), "array<struct<from:int,to:int>>", step))
    # A place in a text is found by counting from its start, so each chunk of gaps cuts its part of the text first.
    last = F.aggregate("__all", F.lit(0), lambda acc, x: F.greatest(acc, x["end"]))
    chunks = F.transform(F.sequence(F.lit(1), F.greatest(F.size("__gaps"), F.lit(1)), F.lit(CHUNK)), lambda i: F.slice("__gaps", i, CHUNK))

    def written(c):
        first, end = F.get(c, F.lit(0))["from"], F.get(c, F.size(c) - 1)["to"]
        part = F.substring(t, first + 1, end - first)
        return once(part, lambda p: F.array_join(F.transform(c, lambda g: F.concat(F.substring(p, g["from"] - first + 1, g["to"] - g["from"]), F.lit(mark))), ""))

    done = F.concat(F.array_join(F.transform(chunks, written), ""), F.substring(t, last + 1, F.length(t) - last))
    at = docs.columns.index(text_col)
    changed = F.when(F.size("__all") > 0, done).otherwise(F.col(f"__c{at}"))
    return s.select(*[(changed if i == at else F.col(f"__c{i}")).alias(name) for i, name in enumerate(docs.columns)])
