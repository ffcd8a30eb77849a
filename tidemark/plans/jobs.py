"""Stages of a run, which of them are still good, and what a run's state amounts to."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field

#: The stages in order, each with those whose results it reads. Fixed values.
READS = {
    "ingest": (),
    "frame_scan": ("ingest",),
    "asr": ("ingest",),
    "vision": ("frame_scan",),
    "screen_tracker": ("vision",),
    "align": ("asr", "screen_tracker"),
    "blocks": ("align",),
    "export": ("blocks",),
}
STAGES = tuple(READS)


def downstream(stage: str) -> list[str]:
    """Stages that a new result of this one makes stale, in order."""
    stale = {stage}
    for later, reads in READS.items():
        if stale & set(reads):
            stale.add(later)
    return [s for s in STAGES if s in stale and s != stage]



def stable_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def config_hash(config: dict, keys: Iterable[str] | None = None) -> str:
    """Hash of the settings that a stage reads; others do not make its result stale."""
    own = {k: config[k] for k in sorted(keys) if k in config} if keys is not None else config
    return hashlib.sha256(stable_json(own).encode()).hexdigest()


#: Sections of a run's settings and what each holds if it is not set.
DEFAULTS = {
    "range": {"start_us": None, "end_us": None},
    "scan": {"interval_us": 200_000, "stable_us": 700_000, "small_width": 960},
    "audio": {"channel": "mix", "chunk_us": 600_000_000, "chunk_overlap_us": 2_000_000},
    "speech": {"language": "auto", "beam": 5},
    "vision": {"max_image_long_side": 2048, "crop_max_pixels": 1_500_000},
    "blocks": {"max_gap_us": 30_000_000},
    "export": {"video_link": True, "structure_notes": True, "appendix": True},
}
#: Sections that each stage reads; the range counts for all.
SECTIONS = {"frame_scan": ("scan",), "audio_prepare": ("audio",), "asr": ("audio", "speech"), "vision": ("vision",), "blocks": ("blocks",), "export": ("export",)}


def load_config(path: str) -> dict[str, dict]:
    """Settings from a JSON file: known sections over their defaults; an unknown section or setting is refused."""
    with open(path, encoding="utf-8") as f:
        return merged_config(json.load(f))


def merged_config(given: dict) -> dict[str, dict]:
    unknown = [s for s in given if s not in DEFAULTS] + [f"{s}.{k}" for s, own in given.items() if s in DEFAULTS for k in own if k not in DEFAULTS[s]]
    if unknown:
        raise ValueError(f"no such setting: {sorted(unknown)}")
    return {s: own | given.get(s, {}) for s, own in DEFAULTS.items()}


def save_config(config: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(config, f, ensure_ascii=False, indent=2, sort_keys=True)


def stage_hash(stage: str, config: dict[str, dict]) -> str:
    """Hash of what a stage reads of the settings."""
    return config_hash({"stage": stage, "range": config["range"], "own": {s: config[s] for s in SECTIONS.get(stage, ())}})


def quick_hash(size: int, head: bytes, tail: bytes) -> str:
    """Tells a large file apart by its size and both ends."""
    return hashlib.sha256(b"%d\0" % size + head + b"\0" + tail).hexdigest()


def input_hash(parts: Iterable[str]) -> str:
    """Hash of the hashes of what a stage reads, in their order."""
    return hashlib.sha256("\x1f".join(parts).encode()).hexdigest()


@dataclass
class Job:
    stage: str
    input_hash: str
    config_hash: str
    status: str = "running"
    checkpoint: dict = field(default_factory=dict)


class Jobs:
    """The job table of one media. It is small (a row per stage) and lives with the driver."""

    def __init__(self, rows: Iterable[dict] = ()) -> None:
        self.rows = {r["stage"]: Job(**r) for r in rows}

    def is_done(self, stage: str, inputs: str, config: str) -> bool:
        j = self.rows.get(stage)
        return bool(j) and j.status == "done" and (j.input_hash, j.config_hash) == (inputs, config)

    def start(self, stage: str, inputs: str, config: str) -> Job:
        """A checkpoint is carried over only if input and settings are those it was made with."""
        old = self.rows.get(stage)
        kept = old.checkpoint if old and (old.input_hash, old.config_hash) == (inputs, config) else {}
        self.rows[stage] = job = Job(stage, inputs, config, "running", dict(kept))
        return job

    def finish(self, stage: str, status: str = "done") -> None:
        self.rows[stage].status = status

    def invalidate(self, stage: str) -> None:
        """Drops what is downstream, checkpoints too."""
        for later in downstream(stage):
            self.rows.pop(later, None)

    def run(self, stage: str, inputs: str, config: str, work: Callable[[Job], None]) -> bool:
        """Runs the stage unless its result is still good; whether it ran."""
        if self.is_done(stage, inputs, config):
            return False
        job = self.start(stage, inputs, config)
        try:
            work(job)
        except BaseException:
            self.finish(stage, "failed")
            raise
        self.finish(stage)
        self.invalidate(stage)
        return True

    def all_done(self) -> bool:
        return all(s in self.rows and self.rows[s].status == "done" for s in STAGES)

    def to_json(self) -> str:
        return stable_json([asdict(j) for j in self.rows.values()])

    @classmethod
    def from_json(cls, text: str) -> "Jobs":
        return cls(json.loads(text))


def completion(all_done: bool, reviews_open: int) -> str:
    """processing, completed_with_review or reviewed."""
    return "processing" if not all_done else "completed_with_review" if reviews_open else "reviewed"


def selected(only: Iterable[str] | None) -> list[str]:
    """Stages to run, in order; an unknown name is refused."""
    if only is None:
        return list(STAGES)
    unknown = set(only) - set(STAGES)
    if unknown:
        raise ValueError(f"no such stage: {sorted(unknown)}")
    return [s for s in STAGES if s in set(only)]


def manifest(media: dict, jobs: Jobs, config: dict, outputs: Iterable[str], reviews_open: int, versions: dict[str, str]) -> str:
    """What a run was made from and with, as JSON. Paths are listed in order; nothing in it depends on the clock."""
    return stable_json({
        "media": media,
        "stages": {s: asdict(j) for s, j in jobs.rows.items()},
        "config_hash": config_hash(config),
        "outputs": sorted(outputs),
        "status": completion(jobs.all_done(), reviews_open),
        "versions": versions,
    })
