"""Reading blocks: ordered units of display intervals that show one piece of material.

A unit grows while the next interval follows closely, the unit stays short enough, and the interval shows a content
the unit has had (repeat) or a near version of its last body under one heading (modified). Intervals without content
that are short, blank or in transition wait for the next accepted one. The rule is a fold, but it never reaches over a
wide gap unless both sides lack content, so timelines are first cut there and pieces are folded apart. Bodies do not travel
with the intervals that show them: of each only the number of its lines and the hashes of those that another body has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .intervals import islands
from .states import ORDER


@dataclass(frozen=True)
class BlockRule:
    max_gap_us: int = 15_000_000
    max_duration_us: int = 900_000_000
    similarity: float = 0.60
    passing: tuple[str, ...] = ("short", "transition", "blank")


@dataclass(frozen=True)
class Lines:
    """Distinct lines of a body: how many, and which of them other bodies under the same heading have too."""

    n: int = 0
    shared: frozenset = frozenset()


@dataclass
class Shown:
    """An interval with what it shows; content is None if it has not been read."""

    occ: object
    start: int
    end: int
    kind: str
    content: object
    body: Lines
    context: tuple
    title: str


@dataclass
class Unit:
    members: list[tuple[Shown, str]]
    contents: set = field(default_factory=set)
    anchor: Lines = Lines()
    edited: bool = False


def body_lines(body: str) -> set[str]:
    return {x for x in map(str.strip, body.split("\n")) if x}


def similarity(a: Lines, b: Lines) -> float:
    """Of two different contents under one heading."""
    both = len(a.shared & b.shared)
    return both / (a.n + b.n - both) if a.n and b.n else 0.0


def verdict(unit: Unit, before: Shown, new: Shown, rule: BlockRule) -> str:
    """How the interval continues the unit: repeat, modified, waits, or '' if it does not."""
    first = unit.members[0][0]
    if new.start - before.end > rule.max_gap_us or new.end - first.start > rule.max_duration_us:
        return ""
    if new.content is None:
        return "waits" if new.kind in rule.passing else ""
    if new.content in unit.contents:
        return "repeat"
    alike = new.context == first.context and similarity(unit.anchor, new.body) >= rule.similarity
    return "modified" if alike else ""


def fold(timeline: list[Shown], rule: BlockRule) -> Iterator[tuple[str, list[tuple[Shown, str]]]]:
    """(kind, members with their label) of each block, in order."""
    at = 0
    while at < len(timeline):
        if timeline[at].content is None:
            run = at
            while run < len(timeline) and timeline[run].content is None:
                run += 1
            yield "unextracted", [(x, "unextracted") for x in timeline[at:run]]
            at = run
            continue
        first = timeline[at]
        unit, taken = Unit([(first, "first")], {first.content}, first.body), at + 1
        for look in range(at + 1, len(timeline)):
            new = timeline[look]
            label = verdict(unit, timeline[look - 1], new, rule)
            if not label:
                break
            if label == "waits":
                continue
            unit.members += [(x, "unextracted") for x in timeline[taken:look]] + [(new, label)]
            unit.contents.add(new.content)
            if label == "modified":
                unit.anchor, unit.edited = new.body, True
            taken = look + 1
        single = len(unit.members) == 1
        yield "single" if single else "unit_edited" if unit.edited else "unit", unit.members
        at = taken


MEMBERS = "media_id long, piece long, part int, kind string, title string, occ_id long, place int, label string, start_us long, end_us long, state_kind string"


def _hashed(batches):
    """content_id, n, keys: the distinct lines of a body, each with its screen kind and heading as a hash of 128 bits."""
    for batch in batches:
        sizes, keys = [], []
        for r in batch.select(["screen_kind", "heading", "body_text"]).to_pylist():
            lines, under = body_lines(r["body_text"] or ""), hashlib.blake2b(repr((r["screen_kind"], r["heading"])).encode(), digest_size=16).digest()
            sizes.append(len(lines))
            keys.append([hashlib.blake2b(x.encode(), digest_size=16, key=under).digest() for x in lines])
        yield pa.RecordBatch.from_arrays([batch.column("content_id"), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.binary()))], ["content_id", "n", "keys"])


def line_sets(contents: DataFrame) -> DataFrame:
    """content_id, n, shared: Lines of each body. A line that no other content has adds to nothing but n."""
    own = contents.select("content_id", "screen_kind", "heading", "body_text")
    kind = T.StructType([contents.schema["content_id"], *T.StructType.fromDDL("n int, keys array<binary>").fields])
    each = own.mapInArrow(_hashed, kind).select("content_id", "n", F.explode_outer("keys").alias("key"))
    common = each.filter("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("__k")).filter("__k > 1").select("key", F.lit(True).alias("__hit"))
    return each.join(common, "key", "left").groupBy("content_id").agg(F.max("n").alias("n"), F.collect_list(F.when(F.col("__hit"), F.col("key"))).alias("shared"))


def _folded(rule: BlockRule):
    names = [*[x.split()[0] for x in MEMBERS.split(", ")], "content_id"]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    types = [kinds[x.split()[1]] for x in MEMBERS.split(", ")]

    def emit(key: tuple, rows: list[Shown], out: list[tuple]) -> None:
        for part, (kind, members) in enumerate(fold(rows, rule)):
            title = "" if kind == "unextracted" else members[0][0].title or members[-1][0].title
            out += [(*key, part, kind, title, x.occ, place, label, x.start, x.end, x.kind, x.content) for place, (x, label) in enumerate(members)]

    def run(batches):
        key, held, each = None, [], types
        for batch in batches:
            each = [*types, batch.column("content_id").type]
            out: list[tuple] = []
            for r in batch.to_pylist():
                own = (r["media_id"], r["piece"])
                if own != key:
                    emit(key, held, out) if held else None
                    key, held = own, []
                held.append(Shown(r["occ_id"], r["start_us"], r["end_us"], r["state_kind"], r["content_id"], Lines(r["n"] or 0, frozenset(r["shared"] or ())), (r["screen_kind"], r["heading"]), r["title"] or ""))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(each)], names)
        if held:
            out = []
            emit(key, held, out)
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(each)], names)

    return run


def block_members(occurrences: DataFrame, contents: DataFrame, rule: BlockRule = BlockRule()) -> DataFrame:
    """media_id, block_index, kind, title, occ_id, place (in the block), label, start_us, end_us, state_kind, content_id of
    every interval.

    occurrences: content_id is the text hash. contents: content_id, screen_kind, heading, title, body_text."""
    w = Window.partitionBy("media_id").orderBy(*ORDER)
    lone = F.col("content_id").isNull() & F.lag("content_id").over(w).isNull() & F.lag("occ_id").over(w).isNotNull()
    wide = F.col("start_us") - F.lag("end_us").over(w) > rule.max_gap_us
    cut = islands(occurrences, ["media_id"], ORDER, wide & ~lone, "piece").select("media_id", "piece", "occ_id", "start_us", "end_us", "state_kind", "content_id")
    about = contents.select("content_id", "screen_kind", "heading", "title").join(line_sets(contents), "content_id", "left")
    told = cut.join(about, "content_id", "left")
    dealt = told.repartition("media_id", "piece").sortWithinPartitions("media_id", "piece", *ORDER)
    needed = dealt.select("media_id", "piece", "occ_id", "start_us", "end_us", "state_kind", "content_id", "screen_kind", "heading", "title", "n", "shared")
    parts = needed.mapInArrow(_folded(rule), T.StructType([*T.StructType.fromDDL(MEMBERS).fields, T.StructField("content_id", occurrences.schema["content_id"].dataType)]))
    index = F.dense_rank().over(Window.partitionBy("media_id").orderBy("piece", "part")) - 1
    return parts.withColumn("block_index", index).drop("piece", "part")


def blocks(members: DataFrame) -> DataFrame:
    """media_id, block_index, kind, title, start_us, end_us (of the last member), members, occ_ids."""
    return members.groupBy("media_id", "block_index", "kind", "title").agg(
        F.min("start_us").alias("start_us"),
        F.max_by("end_us", "place").alias("end_us"),
        F.count(F.lit(1)).alias("members"),
        F.transform(F.sort_array(F.collect_list(F.struct("place", "occ_id"))), lambda x: x["occ_id"]).alias("occ_ids"),
    )


def block_stats(members: DataFrame) -> DataFrame:
    kinds = blocks(members).agg(F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("kind").startswith("unit")).alias("unit_blocks"), F.count_if(F.col("kind") == "unextracted").alias("unextracted_blocks"), F.count_if(F.col("kind") == "unit_edited").alias("edited_units"))
    labels = members.agg(F.count(F.lit(1)).alias("occurrences"), F.count_if(F.col("label") == "repeat").alias("repeat_displays"), F.count_if(F.col("label") == "modified").alias("modified_displays"))
    return kinds.crossJoin(labels)  # two tables of one row


def block_refs(members: DataFrame, alignment: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Per block its utterances and contents, each once, in order of first appearance. Contents are those of the members."""
    key = ["media_id", "block_index"]
    said = members.join(alignment.select("occ_id", "utt_id"), "occ_id").groupBy(*key, "utt_id").agg(F.min("place").alias("first"))
    said = said.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("first", "utt_id"))), lambda x: x["utt_id"]).alias("utt_ids"))
    shown = members.filter("content_id IS NOT NULL").groupBy(*key, "content_id").agg(F.min("place").alias("first"))
    shown = shown.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("first", "content_id"))), lambda x: x["content_id"]).alias("content_ids"))
    return blocks(members).select(*key).join(said, key, "left").join(shown, key, "left")


def events_in_blocks(blocks_: DataFrame, events: DataFrame) -> DataFrame:
    """Change events inside each block, cursor events aside."""
    from .intervals import containment_join

    return containment_join(blocks_.select("media_id", "block_index", "start_us", "end_us"), events.filter("event_kind <> 'cursor'"))
