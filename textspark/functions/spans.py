"""Span algebra on ARRAY<STRUCT<start,end,text,label,confidence>>.

Offsets are 0-based code points, ``end`` is exclusive. All functions work inside
one row: no shuffle, and the text never leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import let, running_offsets

SPAN_DDL = "struct<start:int,end:int,text:string,label:string,confidence:double>"
SPANS_DDL = f"array<{SPAN_DDL}>"
MARK = "\x01"  # stands for a match while gaps are measured; texts that contain it are split by the pattern itself


def span(start: Column, end: Column, text: Column, label: Column, confidence: Column) -> Column:
    return F.struct(
        start.cast("int").alias("start"),
        end.cast("int").alias("end"),
        text.alias("text"),
        label.alias("label"),
        confidence.cast("double").alias("confidence"),
    )


def no_spans() -> Column:
    return F.array().cast(SPANS_DDL)


def piece(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] in 0-based, end-exclusive terms."""
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def match_many(text: Column, patterns: Sequence[tuple[str, str]], confidence: float = 1.0) -> Column:
    """For every (label, pattern) the array of all its matches with positions: an array of span arrays.

    Matches and the gaps between them alternate, so a running sum of their
    lengths yields the offsets. A pattern without a match costs one regex pass.
    """

    def located(p: Column) -> Column:
        found = p["found"]
        gaps_of = F.when(p["marked"].isNotNull(), F.split(p["marked"], MARK, -1)).otherwise(F.split(text, p["pattern"], -1))

        def walk(gaps: Column) -> Column:
            steps = F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))

            def place(before: Column) -> Column:
                def one(m, i):
                    return let(
                        F.get(before, i) + F.length(F.get(gaps, i)),
                        lambda start: span(start, start + F.length(m), m, p["label"], F.lit(confidence)),
                    )

                return F.transform(found, one)

            return let(running_offsets(steps), place)

        # a single match, the usual case, needs only the length of what is before its mark
        first = F.get(found, 0)
        at = F.length(F.substring_index(p["marked"], MARK, 1))
        alone = F.array(span(at, at + F.length(first), first, p["label"], F.lit(confidence)))
        return (
            F.when((F.size(found) == 1) & p["marked"].isNotNull(), alone)
            .when(F.size(found) > 0, let(gaps_of, walk))
            .otherwise(no_spans())
        )

    unmarked = ~F.contains(text, F.lit(MARK))

    def search(label: str, pattern: str) -> Column:
        # a literal pattern is compiled once, a split by one plain character needs none
        return let(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
            lambda found: F.struct(
                F.lit(label).alias("label"),
                F.lit(pattern).alias("pattern"),
                found.alias("found"),
                F.when((F.size(found) > 0) & unmarked, F.regexp_replace(text, pattern, MARK)).alias("marked"),
            ),
        )

    return F.transform(F.array(*[search(label, pattern) for label, pattern in patterns]), located)


def match_spans(text: Column, pattern: str, label: str, confidence: float = 1.0) -> Column:
    """Every match of one pattern."""
    return F.element_at(match_many(text, [(label, pattern)], confidence), 1)


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def inside(a: Column, b: Column) -> Column:
    return (b["start"] <= a["start"]) & (a["end"] <= b["end"])


def first_wins(sources: Column, clash: Callable[[Column, Column], Column] = overlaps) -> Column:
    """Union of an array of span arrays; a span that clashes with one of an earlier array is dropped."""

    def add(kept: Column, later: Column) -> Column:
        free = F.filter(later, lambda s: ~F.exists(kept, lambda e: clash(s, e)))
        return F.when(F.size(later) == 0, kept).otherwise(F.concat(kept, F.when(F.size(kept) == 0, later).otherwise(free)))

    return F.aggregate(sources, no_spans(), add)


def prefer_first(*sources: Column, clash: Callable[[Column, Column], Column] = overlaps) -> Column:
    return first_wins(F.array(*sources), clash)


def in_text_order(spans: Column) -> Column:
    """Sorted by start; spans with equal start keep their order."""
    keyed = F.transform(spans, lambda s, i: F.struct(s["start"].alias("at"), i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def non_overlapping(spans: Column) -> Column:
    """Left to right, keep a span when it starts at or after the end of the last kept one."""

    def step(acc, s):
        return F.when(
            s["start"] >= acc["last"],
            F.struct(s["end"].alias("last"), F.concat(acc["kept"], F.array(s)).alias("kept")),
        ).otherwise(acc)

    start = F.struct(F.lit(0).alias("last"), no_spans().alias("kept"))
    return let(
        spans, lambda s: F.when(F.size(s) < 2, s).otherwise(F.aggregate(in_text_order(s), start, step)["kept"])
    )


def merge_adjacent(text: Column, spans: Column, gap: int = 1) -> Column:
    """Same-label neighbours that overlap or lie at most ``gap`` apart become one span."""

    def step(acc, s):
        last = F.element_at(acc, -1)
        joined = span(
            last["start"],
            F.greatest(last["end"], s["end"]),
            piece(text, last["start"], F.greatest(last["end"], s["end"])),
            last["label"],
            F.greatest(last["confidence"], s["confidence"]),
        )
        touching = (F.size(acc) > 0) & (last["label"] == s["label"]) & (s["start"] <= last["end"] + gap)
        return F.when(touching, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(
            F.concat(acc, F.array(s))
        )

    # element_at on an empty array must not fail in ANSI mode, hence the non-empty guard below
    def walk(ordered):
        first = F.slice(ordered, 1, 1)
        rest = F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0)))
        return F.when(F.size(ordered) < 2, ordered).otherwise(F.aggregate(rest, first, step))

    return let(in_text_order(spans), walk)


def replace_spans(text: Column, spans: Column, replacement: Callable[[Column], Column]) -> Column:
    """Text with every span replaced; spans must not overlap."""

    def rebuild(ordered: Column) -> Column:
        def part(s, i):
            before = F.when(i == 0, F.lit(0)).otherwise(F.get(ordered, i - 1)["end"])
            return F.concat(piece(text, before, s["start"]), F.coalesce(replacement(s), F.lit("")))

        tail = F.substring(text, F.element_at(ordered, -1)["end"] + 1, F.length(text))
        return F.when(F.size(ordered) == 0, text).otherwise(
            F.concat(F.array_join(F.transform(ordered, part), ""), tail)
        )

    return let(F.array_sort(F.coalesce(spans, no_spans())), rebuild)


def keep_labels(spans: Column, allow: Sequence[str] | None = None, deny: Sequence[str] | None = None) -> Column:
    def wanted(s):
        ok = F.lit(True)
        if allow:
            ok = ok & s["label"].isin(*allow)
        if deny:
            ok = ok & ~s["label"].isin(*deny)
        return ok

    return F.filter(spans, wanted)


def min_confidence(spans: Column, threshold: float) -> Column:
    return F.filter(spans, lambda s: s["confidence"] >= F.lit(threshold))


def mapping_of(spans: Column, replacement: Callable[[Column], Column]) -> Column:
    """Original text, label, replacement and the offsets before and after replacing."""

    def build(ordered: Column) -> Column:
        def place(shift: Column) -> Column:
            def one(s, i):
                new = F.coalesce(replacement(s), F.lit(""))
                begin = s["start"] + F.get(shift, i)
                return F.struct(
                    s["start"].alias("start"),
                    s["end"].alias("end"),
                    s["text"].alias("text"),
                    s["label"].alias("label"),
                    new.alias("replacement"),
                    begin.cast("int").alias("new_start"),
                    (begin + F.length(new)).cast("int").alias("new_end"),
                )

            return F.transform(ordered, one)

        growth = F.transform(
            ordered, lambda s: F.length(F.coalesce(replacement(s), F.lit(""))) - (s["end"] - s["start"])
        )
        return let(running_offsets(growth), place)

    return let(F.array_sort(spans), build)


def restore(text: Column, mapping: Column) -> Column:
    """Inverse of replacing: put the original texts back by the mapping offsets."""
    back = F.transform(
        mapping,
        lambda m: span(m["new_start"], m["new_end"], m["text"], m["label"], F.lit(1.0)),
    )
    return replace_spans(text, back, lambda s: s["text"])


def replacements_map(spans: Column, replacement: Callable[[Column], Column]) -> Column:
    """Original text -> replacement; when a text occurs with several labels the leftmost span decides."""

    def build(ordered: Column) -> Column:
        first = F.filter(
            ordered,
            lambda s, i: ~F.exists(F.slice(ordered, 1, i), lambda e: e["text"] == s["text"]),
        )
        return F.map_from_entries(F.transform(first, lambda s: F.struct(s["text"], replacement(s))))

    return let(F.array_sort(spans), build)
