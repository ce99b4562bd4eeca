"""Text functions: Column in, Column out, all inside the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_ws(c: Column) -> Column:
    """Every run of white space, no-break spaces included, as one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s ]+", " "))


def _fold_table() -> tuple[str, str, list[tuple[str, str]]]:
    single, target, several = "", "", []
    for code in range(0xC0, 0x250):
        ch = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", ch.casefold()) if not unicodedata.combining(x)).replace("ı", "i")
        if len(plain) == 1 and plain != ch:
            single, target = single + ch, target + plain
        elif len(plain) > 1:
            several.append((ch, plain))
    return single + "".join(chr(k) for k in range(0x300, 0x370)), target, several


_FROM, _TO, _SEVERAL = _fold_table()


def fold(c: Column) -> Column:
    """Lower case without accents: letters up to U+024F by table, combining marks dropped, one-to-many letters spelled out.

    UTF-8 text that was read as Latin-1 is repaired first.
    """
    plain = F.lower(c)
    full = F.lower(repair_mojibake(c))
    for ch, spelled in _SEVERAL:
        if ch.lower() == ch:
            full = F.replace(full, F.lit(ch), F.lit(spelled))
    return F.when(c.rlike(r"^[\x00-\x7F]*$"), plain).otherwise(F.translate(full, _FROM, _TO))


def once(c: Column, f) -> Column:
    """f(c) with c computed once a row, however often f uses it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def repair_mojibake(c: Column) -> Column:
    """UTF-8 text that was read as Latin-1, read again; anything else unchanged."""
    latin = F.when(c.rlike(r"^[\x00-\xFF]*$"), c)
    again = F.try_validate_utf8(F.encode(F.coalesce(latin, F.lit("")), "ISO-8859-1").cast("string"))
    return F.when(latin.isNotNull(), F.coalesce(again, c)).otherwise(c)


def replaced(c: Column, steps: Sequence[tuple[str, str]]) -> Column:
    """Regular-expression replacements, one after the other."""
    return reduce(lambda acc, s: F.regexp_replace(acc, s[0], s[1]), steps, c)


# The signs, fillers, openers and spellings that keys must agree on.
_CLEAN = r"[^a-z0-9\s]"
_ORDER_WORDS = ((r"\btake out\b", "takeout"), (r"\bpick up\b", "pickup"))
_PEOPLE = (r"\bfor\s+(?:one|two|three|\d+)\s+(?:person|people)\b", " for qty people ")
_TIDY = ((r"\s+", " "), (r"^ | $", ""))


def _spelled(c: Column, pairs: Mapping[str, str]) -> Column:
    return reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), pairs.items(), F.replace(F.lower(c), F.lit(" "), F.lit(" ")))


def norm_key(c: Column, variant: str = "v4") -> Column:
    """Keys for matching and for finding duplicates.

    v3 drops greetings, openers and head counts; v4 only spells out contractions; v4_dedup adds v3's drops; target
    keeps letters (the Turkish ones too), ``$``, ``'`` and ``-``.
    """
    fillers = r"\b(?:hi|hello|hey|assistant|please|yeah|oh|okay|ok%s)\b"
    openers = r"\b(?:i would like to|i want to|i need to|can you help me with|can you help me%s)\b"
    if variant == "v3":
        spelled = _spelled(c, {"i'd": "i would", "can't": "cannot"})
        return replaced(spelled, [(_CLEAN, " "), (fillers % "", " "), (openers % "", " "), *_ORDER_WORDS, _PEOPLE, *_TIDY])
    if variant in ("v4", "v4_dedup"):
        spelled = _spelled(c, {"i'd": "i would", "what's": "what is", "it's": "it is", "that's": "that is"})
        base = replaced(spelled, [(_CLEAN, " "), *_ORDER_WORDS, *_TIDY])
        if variant == "v4":
            return base
        return replaced(base, [(fillers % "|thanks|thank you", " "), (openers % "|i am looking to", " "), _PEOPLE, *_TIDY])
    if variant == "target":
        return replaced(F.lower(c), [(r"[^a-zçğıöşü$' -]", " "), *_TIDY])
    raise ValueError(f"no variant {variant}")


def word_count(c: Column, stop: Sequence[str] = ()) -> Column:
    words = F.filter(F.split(c, " "), lambda w: (w != "") & ~w.isin(*stop) if stop else w != "")
    return F.size(words)


def contains_any(c: Column, phrases: Sequence[str], mode: str = "substring") -> Column:
    """Whether any phrase occurs: anywhere in the text, between word borders (mode='word'), or from the start of a word on (mode='start'), so that endings may follow."""
    if mode == "word":
        return matches_any(c, [r"\b\Q" + p + r"\E\b" for p in phrases])
    if mode == "start":  # the pattern is tried on the few texts that hold the letters
        return reduce(lambda a, b: a | b, [c.contains(p) & matches_any(c, [r"\b\Q" + p + r"\E"]) for p in phrases], F.lit(False))
    return reduce(lambda a, b: a | b, [c.contains(p) for p in phrases], F.lit(False))


def matches_any(c: Column, patterns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.rlike("(?U)" + p) for p in patterns], F.lit(False))


def norm_label(c: Column) -> Column:
    """A speaker label: upper case, other signs as single underscores, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.upper(c), "[^A-Z0-9]+", "_"), "^_+|_+$", "")


def missing_terms(c: Column, terms: Column) -> Column:
    """The terms that the folded text lacks.

    Folding keeps ASCII text but for its case, so an ASCII term that the text holds as it is need not be folded.
    """
    as_is = lambda x, t: (F.octet_length(t) == F.length(t)) & x.contains(t)
    both = once(c, lambda x: F.struct(x.alias("c"), fold(x).alias("f")))
    return once(both, lambda x: F.filter(terms, lambda t: ~(as_is(x["c"], t) | x["f"].contains(fold(t)))))


def present_terms(c: Column, terms: Column) -> Column:
    return once(fold(c), lambda x: F.filter(terms, lambda t: x.contains(fold(t))))


def clean_output(c: Column, prefixes: Sequence[str] = ()) -> Column:
    """A model's reply in one line: no thinking blocks, code fences, bullets or lines that repeat an instruction."""
    text = F.regexp_replace(c, r"(?is)<think>.*?</think>", "")
    lines = F.transform(F.split(F.regexp_replace(text, "```[a-z]*", ""), "\n"), lambda s: F.trim(F.regexp_replace(s, r"^\s*(?:[-*•]|\d+[.)])\s+", "")))
    bad = lambda s: reduce(lambda a, b: a | b, [F.lower(s).startswith(p) for p in prefixes], s == "")
    return F.array_join(F.filter(lines, lambda s: ~bad(s)), " ")


def strip_markdown(c: Column, spelling: Mapping[str, str] | None = None) -> Column:
    text = replaced(c, [(r"(?m)^#{1,6}\s*", ""), (r"\*\*|__|`", ""), (r"(?m)^\s*[-*]\s+", ""), (r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]", "")])
    for wrong, right in (spelling or {}).items():
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return norm_ws(text)


def html_text(c: Column) -> Column:
    """The words of a page: no scripts, styles, comments or tags."""
    return norm_ws(replaced(c, [(r"(?is)<(script|style)[^>]*>.*?</\1>", " "), (r"(?s)<!--.*?-->", " "), (r"(?s)<[^>]*>", " ")]))


def ordered_distinct(arr: Column, folded: bool = False) -> Column:
    """First occurrences in order; folded: equal up to case."""
    if not folded:
        return F.array_distinct(arr)
    return F.aggregate(arr, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))


def name_list(arr: Column, joiner: str = " veya ") -> Column:
    """a; a veya b; a, b veya c."""
    n = F.size(arr)
    return F.when(n == 0, "").when(n == 1, F.try_element_at(arr, F.lit(1))).otherwise(F.concat(F.array_join(F.slice(arr, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(joiner), F.try_element_at(arr, F.lit(-1))))


def price_text(c: Column, unit: str = "TL") -> Column:
    return F.when(c.isNotNull() & ~F.isnan(c), F.format_string(f"%.2f {unit}", c))


def nonempty(c: Column, longer_than: int = 5) -> Column:
    return F.coalesce((F.length(F.trim(c)) > 0) & (F.length(c) > longer_than), F.lit(False))


def clean_text(c: Column) -> Column:
    """Trimmed text, null where it is blank or has no letter or digit."""
    t = norm_ws(c)
    return F.when(t.rlike(r"[\p{L}\p{N}]"), t)


def first_present(*pairs: tuple[Column, Column]) -> Column:
    """The value of the first key that is present, a present null included: pairs of (is present, value)."""
    return reduce(lambda rest, p: F.when(p[0], p[1]).otherwise(rest), reversed(pairs), F.lit(None))


def first_truthy(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in cols])


def render_transcript(messages: Column, labels: Mapping[str, str], cue: str = "") -> Column:
    """Label: content, one message a line."""
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    lines = F.transform(messages, lambda m: F.concat(F.coalesce(F.try_element_at(table, m["role"]), m["role"]), F.lit(": "), m["content"]))
    return F.concat(F.array_join(lines, "\n"), F.lit(cue))


def annotation_names(segments: Column) -> Column:
    """Names of all annotations of all segments, in order, without nulls."""
    return F.filter(F.flatten(F.transform(segments, lambda s: F.transform(F.coalesce(s["annotations"], F.array()), lambda a: a["name"]))), lambda n: n.isNotNull())
