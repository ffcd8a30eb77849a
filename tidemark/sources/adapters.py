"""Model adapters: what reads an image or a stretch of sound is a plug-in, run once per partition.

A call goes through one policy: look in the cache, ask, ask again on an error or a reading that cannot be used, stop at
a truncated one; only good readings are cached.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from typing import Protocol
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.quality import cache_key
from ..operators.regions import kept_regions


@dataclass(frozen=True)
class Reading:
    status: str  # ok, truncated, schema_invalid or error
    payload: str | None = None
    detail: str = ""


class Adapter(Protocol):
    """Reads one request. `identity` names model and parameters: a change of it makes cached readings unusable."""

    identity: str

    def read(self, request: Mapping) -> Reading: ...

    def recover(self) -> None: ...

    def close(self) -> None: ...


class ScriptedAdapter:
    """Answers from a table, for tests: key of the request -> reading, or a list of readings to give in turn."""

    def __init__(self, script: Mapping, key: str = "key", identity: str = "scripted") -> None:
        self.script, self.key, self.identity, self.calls = dict(script), key, identity, 0

    def read(self, request: Mapping) -> Reading:
        self.calls += 1
        answer = self.script.get(request[self.key], Reading("error", detail="no such request"))
        if isinstance(answer, list):
            answer = answer.pop(0) if len(answer) > 1 else answer[0]
        return answer

    def recover(self) -> None: ...

    def close(self) -> None: ...


MARKER_BITS = 12


def marker(number: int, cell: int = 4) -> np.ndarray:
    """A strip of light and dark cells that writes a number, for screens of tests."""
    return np.kron([[255 * (number >> k & 1) for k in range(MARKER_BITS)]], np.ones((cell, cell))).astype(np.uint8)


class MarkerAdapter(ScriptedAdapter):
    """Knows screens by the marker in their top left corner (request: pixels, rows of gray values)."""

    def __init__(self, script: Mapping, cell: int = 4) -> None:
        super().__init__(script, "marker", "marker")
        self.cell = cell

    def read(self, request: Mapping) -> Reading:
        strip = np.asarray(request["pixels"])[: self.cell, : self.cell * MARKER_BITS]
        bits = strip.reshape(self.cell, MARKER_BITS, self.cell).mean(axis=(0, 2)) > 127
        return super().read({"marker": int((bits << np.arange(MARKER_BITS)).sum())})


class ChunkAdapter:
    """Sound by the chunk: `transcribe(request)` gives segments (start_us, end_us, text) from the chunk's own beginning; a
    segment that does not lie in the chunk is an error, not something to be moved."""

    def __init__(self, transcribe: Callable[[Mapping], Iterable[tuple[int, int, str]]], identity: str) -> None:
        self.transcribe, self.identity = transcribe, identity

    def read(self, request: Mapping) -> Reading:
        length, out = request["end_us"] - request["start_us"], []
        try:
            for start, end, text in self.transcribe(request):
                if not 0 <= start <= end <= length:
                    return Reading("schema_invalid", detail=f"a segment at {start} to {end} of {length}")
                out.append({"start_us": request["start_us"] + start, "end_us": request["start_us"] + end, "text": text})
        except OSError as e:
            return Reading("error", detail=str(e))
        return Reading("ok", json.dumps(out, ensure_ascii=False))

    def recover(self) -> None: ...

    def close(self) -> None: ...


class ScreenReader:
    """One screen through several readings: the whole of it first, halves where that fails, then uncertain regions again at
    full size, the uncertain before the large, a bounded number of them. Requests go to `inner` with kind full, tile or
    crop; rereading keeps the second text and says so where both differ."""

    def __init__(self, inner: Adapter, most_rereads: int = 4, retries: int = 2) -> None:
        self.inner, self.most, self.retries, self.identity = inner, most_rereads, retries, f"screen({inner.identity},{most_rereads})"

    def _ask(self, request: Mapping, **more) -> Reading:
        return ask(self.inner, {**request, **more}, self.retries)[0]

    def read(self, request: Mapping) -> Reading:
        full = self._ask(request, kind="full")
        if full.payload is None:
            return self._in_halves(request)
        screen = json.loads(full.payload)
        flags = ["truncated"] if full.status == "truncated" else []
        regions = screen.get("regions", [])
        kept, _ = kept_regions([r.get("text") or "" for r in regions])
        if len(kept) < len(regions):
            flags.append("duplicate_regions_removed")
            regions = [regions[k] for k in kept]
        doubtful = lambda r: bool(r.get("unreadable")) or "unreadable" in r.get("flags", [])
        area = lambda b: (b[2] - b[0]) * (b[3] - b[1]) if b else 0
        again = sorted((r for r in regions if doubtful(r) or request.get("downscaled") and r.get("role", "material_body") == "material_body"), key=lambda r: (not doubtful(r), -area(r.get("bbox"))))
        for r in again[: self.most]:
            self._reread(request, r)
        if any(map(doubtful, regions)):
            flags.append("unreadable")
        return Reading(full.status, json.dumps({**screen, "regions": regions, "flags": sorted(flags)}, ensure_ascii=False), full.detail)

    def _reread(self, request: Mapping, region: dict) -> None:
        near = self._ask(request, kind="crop", bbox=region.get("bbox"))
        said = json.loads(near.payload).get("text", "") if near.status == "ok" and near.payload else None
        if said:
            if said.strip() != (region.get("text") or "").strip():
                region["flags"] = sorted({*region.get("flags", []), "reread_differs_from_full_pass"})
            region["text"] = said
        else:
            region["flags"] = sorted({*region.get("flags", []), "crop_reread_failed" if said is None else "crop_reread_empty"})

    def _in_halves(self, request: Mapping) -> Reading:
        parts = split_read(lambda top, bottom: self._ask(request, kind="tile", top=top, bottom=bottom), request["height"])
        regions = []
        for top, _, reading in parts:
            for r in json.loads(reading.payload).get("regions", []) if reading.payload else []:
                box = r.get("bbox")
                regions.append(r | ({"bbox": [box[0], box[1] + top, box[2], box[3] + top]} if box else {}))
        if not regions:
            return Reading("error", detail="not_extracted")
        flags = ["fallback_split_read"] + ["not_extracted"] * any(r.payload is None for _, _, r in parts)
        return Reading("ok", json.dumps({"screen_kind": "other", "output_complete": True, "regions": regions, "flags": sorted(flags)}, ensure_ascii=False))

    def recover(self) -> None:
        self.inner.recover()

    def close(self) -> None:
        self.inner.close()


def area_unchanged(adapter: Adapter, before: Mapping, now: Mapping, key: Callable[[str], str]) -> bool | None:
    """Whether the changed area reads the same in both frames by its comparison key; None if either cannot be read, and then
    the whole screen is. Equal areas let a display inherit the content before it."""
    told = []
    for request in (before, now):
        reading, _ = ask(adapter, {**request, "kind": "crop"})
        if reading.status != "ok" or not reading.payload:
            return None
        found = json.loads(reading.payload)
        told.append(key("\n".join(found.get("lines") or [found.get("text") or ""])))
    return told[0] == told[1]


def loopback(url: str) -> str:
    """The url, if it names this machine; models are never asked elsewhere."""
    if urlsplit(url).hostname not in ("127.0.0.1", "localhost", "::1"):
        raise ValueError(f"not a loopback address: {url}")
    return url


def ask(adapter: Adapter, request: Mapping, retries: int = 2) -> tuple[Reading, int]:
    """The reading and how often the adapter was asked."""
    for attempt in range(1, retries + 2):
        reading = adapter.read(request)
        if reading.status in ("ok", "truncated"):
            break
        if reading.status == "error" and attempt <= retries:
            adapter.recover()
    return reading, attempt


def split_read(read: Callable[[int, int], Reading], height: int, depth: int = 3, least: int = 180) -> list[tuple[int, int, Reading]]:
    """Readings of a screen that cannot be read whole: halves, their halves, down to `depth` or `least` rows."""
    todo, out = [(0, height, depth)], []
    while todo:
        top, bottom, left = todo.pop(0)
        reading = read(top, bottom)
        middle = (top + bottom) // 2
        if reading.status == "ok" or left == 0 or bottom - top < 2 * least:
            out.append((top, bottom, reading))
        else:
            todo[:0] = [(top, middle, left - 1), (middle, bottom, left - 1)]
    return out


def read_all(requests: DataFrame, cache: DataFrame, adapter: Callable[[], Adapter], identity: str, parts: Iterable[str], retries: int = 2) -> DataFrame:
    """requests with cache_key, status, payload, detail, asked (0: from the cache). cache: cache_key, payload.

    parts: columns that decide what a request reads. Only requests that the cache lacks reach the adapter; rows with one
    key are asked once."""
    parts = list(parts)
    keyed = requests.withColumn("__identity", F.lit(identity)).withColumn("cache_key", cache_key([*parts, "__identity"])).drop("__identity")
    fresh = keyed.join(cache.select("cache_key"), "cache_key", "left_anti").dropDuplicates(["cache_key"])

    def run(batches):
        own = adapter()
        try:
            for batch in batches:
                rows = [ask(own, r, retries) for r in batch.to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("cache_key"), *(pa.array([getattr(r, f) for r, _ in rows], pa.string()) for f in ("status", "payload", "detail")), pa.array([n for _, n in rows], pa.int32())], ["cache_key", "status", "payload", "detail", "asked"])
        finally:
            own.close()

    read = fresh.mapInArrow(run, "cache_key string, status string, payload string, detail string, asked int")
    had = cache.select("cache_key", F.lit("ok").alias("status"), "payload", F.lit("").alias("detail"), F.lit(0).alias("asked"))
    return keyed.join(read.unionByName(had), "cache_key")


def cacheable(readings: DataFrame) -> DataFrame:
    return readings.filter("status = 'ok' AND asked > 0").select("cache_key", "payload").dropDuplicates(["cache_key"])


def changed_area_small(boxes: F.Column, share: float = 0.15) -> F.Column:
    """Whether a change (normalized box) is small enough that reading only its area may decide."""
    return (boxes[2] - boxes[0]) * (boxes[3] - boxes[1]) <= share
