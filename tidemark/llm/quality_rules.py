"""Quality rules as a short-circuit cascade.

A sample tells each rule's cost per document and the share that it rejects; rules then run in order of rejection per
cost, each over what the ones before it have left. The order changes the work only, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .kernels import chunks
from .textstats import Stretch

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Stretch], np.ndarray]


#: What fails a document outright.
BASE = (
    Rule("few_words", lambda d: d.n_words < 10),
    Rule("repeated_words", lambda d: 100 * d.n_repeat_words > 20 * d.n_words),
)
#: The method's own rules. Counts are compared as integers, so that every engine agrees on the edges.
RULES = (
    Rule("symbols", lambda d: 10 * d.n_symbols > d.n_words),
    Rule("exclamations", lambda d: 5 * d.n_marks > d.n_words),
    Rule("shouting", lambda d: 2 * d.n_upper > d.n_letters),
    Rule("stuttered_words", lambda d: 5 * d.n_stutters > d.n_words),
    Rule("duplicate_lines", lambda d: 2 * d.n_dup_lines > d.n_lines),
    Rule("short_words", lambda d: 2 * d.word_chars < 5 * d.n_words),
    Rule("long_words", lambda d: d.word_chars > 12 * d.n_words),
)


def cascade(stretch: Stretch, rules: Sequence[Rule]) -> np.ndarray:
    """Mask of documents that no rule rejects. A rule sees only documents that are still in."""
    left, kept = np.arange(stretch.n), np.zeros(stretch.n, bool)
    for rule in rules:
        if not len(left):
            return kept
        out = rule.rejects(stretch)
        if out.any():
            stretch, left = stretch.take(np.flatnonzero(~out)), left[~out]
    kept[left] = True
    return kept


def ordered(docs: DataFrame, rules: Sequence[Rule], sample_rows: int) -> list[Rule]:
    """The rules by rejection per cost, measured on about `sample_rows` rows: the first ones of every partition, where they
    are. What all rules share, the words of a text, is charged to none. Only sums leave the executors."""
    each = max(1, -(-sample_rows // max(1, docs.rdd.getNumPartitions())))

    def measure(batches):
        spent, out, left = [0.0] * len(rules), [0] * len(rules), each
        for batch in batches:
            for _, _, data, at in chunks(batch.slice(0, left).column("text")):
                shared = Stretch(data, at)
                for k, rule in enumerate(rules):
                    stretch = shared.fresh()
                    began = time.perf_counter()
                    out[k] += int(rule.rejects(stretch).sum())
                    spent[k] += time.perf_counter() - began
            left -= min(left, batch.num_rows)
            if not left:
                break
        if left < each:
            yield pa.RecordBatch.from_pydict({"rule": pa.array(range(len(rules)), pa.int32()), "rejected": pa.array(out, pa.int64()), "cost": pa.array(spent, pa.float64())})

    found = docs.mapInArrow(measure, "rule int, rejected long, cost double").groupBy("rule").agg(F.sum("rejected").alias("rejected"), F.sum("cost").alias("cost")).collect()
    rank = {r.rule: (-r.rejected / max(r.cost, 1e-9), r.cost) for r in found}
    return [rules[k] for k in sorted(range(len(rules)), key=lambda k: (rank.get(k, (0, 0)), k))]


def quality_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE, sample_rows: int = 256) -> DataFrame:
    """One row per row of docs: doc_id, the five MEASURES, base_failed and kept (no base rule and no rule rejects).

    The measures are taken of every whole text; the cascade runs over rows that pass the base. Null text counts as
    empty and fails the base. Null doc_ids and repeated rows are rows like any other, an empty table gives no rows,
    extra columns are not read. Nothing is shuffled.
    """
    rows = text_or_empty(docs, "doc_id")
    order = ordered(rows.select("text"), rules, sample_rows)

    def run(batches):
        for batch in batches:
            for first, stop, data, at in chunks(batch.column("text")):
                stretch = Stretch(data, at)
                failed = np.zeros(stretch.n, bool)
                for rule in base:
                    failed |= rule.rejects(stretch)
                kept = ~failed
                kept[kept] = cascade(stretch.take(np.flatnonzero(kept)) if failed.any() else stretch, order)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, stop - first), *(pa.array(getattr(stretch, m), pa.int64()) for m in MEASURES), pa.array(failed), pa.array(kept)], ["doc_id", *MEASURES, "base_failed", "kept"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES) + ", base_failed boolean, kept boolean")


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE, sample_rows: int = 256) -> DataFrame:
    """The rows of docs, all columns as they are, that no rule of the whole cascade (base rules too) rejects.

    Null and empty texts have too few words and go; null doc_ids and repeated rows are rows like any other, an empty
    table gives none, and extra columns of any name go along."""
    order = ordered(text_or_empty(docs).select("text"), [*base, *rules], sample_rows)

    def run(batches):
        for batch in batches:
            kept = [cascade(Stretch(data, at), order) for _, _, data, at in chunks(batch.column("text"))]
            yield batch.filter(pa.array(np.concatenate(kept) if kept else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)
