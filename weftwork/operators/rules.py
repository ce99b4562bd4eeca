"""Rule tables compiled to one CASE expression: rules are data, first match wins."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftwork.functions.text import contains_any, matches_any


@dataclass(frozen=True)
class Rule:
    """A label and when it applies: any phrase or pattern, no ``unless`` phrase, and a needed condition of the row."""

    label: str
    phrases: Sequence[str] = ()
    patterns: Sequence[str] = ()
    unless: Sequence[str] = ()
    needs: Sequence[str] = ()  # phrases of which one must occur besides
    keep: bool | None = True
    reason: str = ""
    notes: str = ""

    def test(self, text: Column, mode: str = "substring") -> Column:
        hit = F.lit(False)
        if self.phrases:
            hit = hit | contains_any(text, self.phrases, mode)
        if self.patterns:
            hit = hit | matches_any(text, self.patterns)
        if self.needs:
            hit = hit & contains_any(text, self.needs, mode)
        return hit & ~contains_any(text, self.unless, mode) if self.unless else hit


def first_match(text: Column, rules: Sequence[Rule], default: str | None = "unclear", mode: str = "substring") -> Column:
    """The label of the first rule that applies; ``default`` None leaves null (the strict form)."""
    out = F.lit(default)
    for r in reversed(rules):
        out = F.when(r.test(text, mode), F.lit(r.label)).otherwise(out)
    return out


def classify(text: Column, rules: Sequence[Rule], default: Rule, keep_if: Column | None = None, mode: str = "substring") -> Column:
    """Struct of category, keep, reason, notes and eligible. ``keep_if``: rules with keep None keep where it holds."""
    held = F.coalesce(keep_if, F.lit(False)) if keep_if is not None else F.lit(True)

    def row(r: Rule) -> Column:
        keep = held if r.keep is None else F.lit(r.keep)
        return F.struct(F.lit(r.label).alias("category"), keep.alias("keep"), F.when(keep, F.lit("")).otherwise(F.lit(r.reason)).alias("reason"), F.lit(r.notes).alias("notes"), keep.alias("eligible"))

    out = row(default)
    for r in reversed(rules):
        out = F.when(r.test(text, mode), row(r)).otherwise(out)
    return out


def buckets(text: Column, rules: Sequence[Rule], everything: str | None = "all") -> Column:
    """All labels that apply, in rule order; ``everything`` closes the list."""
    found = [F.when(r.test(text), F.lit(r.label)) for r in rules]
    return F.array_compact(F.array(*found, *([F.lit(everything)] if everything else [])))


def strict_fragments(text: Column, trivial: Sequence[str], words: Column, strong: Sequence[Rule], least: int = 4) -> Column:
    """Not a trivial phrase, and long enough or a strong request."""
    hit = F.lit(False)
    for r in strong:
        hit = hit | r.test(text)
    return ~text.isin(*trivial) & ((words >= least) | hit)
