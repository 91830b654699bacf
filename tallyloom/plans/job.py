"""Background jobs: one at a time, with events, cancelling and a summary at the end."""

from __future__ import annotations

import dataclasses
import json
import os
import queue
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import SparkSession

from tallyloom.operators.distinct import ALPHABETICAL, dedupe_stats, distinct_tokens, file_stats
from tallyloom.plans.config import AUTO, DISK, GLOBAL, Config, Decision, Memory, Sample, decide_mode, escape_separator, percent, preview_separator
from tallyloom.sources.files import Corpus, file_corpus, input_bytes, is_rich, sample_files
from tallyloom.sources.sink import write_joined


class Busy(RuntimeError):
    """Another job is running."""


class Canceled(RuntimeError):
    """The job was cancelled."""


@dataclass(frozen=True)
class Event:
    """type: started, stage, progress, done, error, canceled or summary."""

    type: str
    job_id: str
    body: dict[str, Any] = field(default_factory=dict)

    @property
    def topic(self) -> str:
        return f"job://{self.type}"

    def to_dict(self) -> dict[str, Any]:
        return {"type": self.type, "job_id": self.job_id} | self.body

    def to_json(self) -> str:
        return json.dumps(self.to_dict())


@dataclass
class Stats:
    files: int = 0
    tokens_seen: int = 0
    unique_tokens: int = 0
    duplicates: int = 0
    filtered_by_length: int = 0
    elapsed_ms: int = 0
    failed_inputs: list[str] = field(default_factory=list)
    per_file: list[dict[str, Any]] | None = None
    decision: Decision | None = None
    sample: Sample | None = None
    stage_ms: dict[str, int] = field(default_factory=dict)


def system_memory() -> Memory:
    """What the machine of the driver has, from /proc; zeros where that can't be read."""
    try:
        with open("/proc/meminfo") as f:
            found = {k: int(v.split()[0]) * 1024 for k, v in (line.split(":") for line in f) if v.split()}
    except OSError:
        return Memory(0, 0, 0)
    return Memory(found.get("MemTotal", 0), found.get("MemAvailable", 0), found.get("MemFree", 0))


def plan_mode(spark: SparkSession, config: Config, memory: Callable[[], Memory] = system_memory) -> tuple[Decision, Sample]:
    """The mode that runs: as asked for, or as decided from a sample of the input and the memory at hand."""
    plain = [p for p in config.inputs if not is_rich(p)]
    sample = sample_files(spark, plain, config.filters)
    decision = decide_mode(len(config.inputs), input_bytes(config.inputs), sample, memory(), config.ordering)
    return (decision if config.mode == AUTO else dataclasses.replace(decision, mode=config.mode, reason="")), sample


def run_dedupe(spark: SparkSession, config: Config, on_stage: Callable[[str], None] = lambda s: None, canceled: Callable[[], bool] = lambda: False,
               memory: Callable[[], Memory] = system_memory) -> Stats:
    """Distinct tokens of the inputs, written to the output; first-seen order holds in every mode."""
    config.validate()
    marks: list[tuple[str, float]] = []

    def stage(name: str) -> None:
        if canceled():
            raise Canceled
        marks.append((name, time.monotonic()))
        on_stage(name)

    if any(map(is_rich, config.inputs)):
        stage("ExtractingText")
    corpus: Corpus = file_corpus(spark, config.inputs)
    stage("Planning")
    decision, sample = plan_mode(spark, config, memory)
    began = time.monotonic()
    stage("Tokenizing")
    filters = config.filters
    counted = dedupe_stats(corpus.lines, filters).collect()[0]
    stats = Stats(len(config.inputs), counted["tokens_seen"], counted["unique_tokens"], counted["duplicates"], counted["filtered_by_length"])
    if config.per_file_stats:
        stage("FileStats")
        found = {r["file_idx"]: r for r in file_stats(corpus.lines, filters).collect()}  # a row for each input path
        stats.per_file = [{"path": p, "file_bytes": input_bytes([p])} | {k: found[i][k] if i in found else 0 for k in ("tokens_seen", "duplicates", "unique_new", "filtered_by_length")}
                          for i, p in enumerate(config.inputs)]
    stage("WritingOutput")
    local = decision.mode == DISK and (config.ordering == "unordered" or config.ordering == ALPHABETICAL and config.disk_alphabetical_mode != GLOBAL)
    write_joined(distinct_tokens(corpus.lines, filters, config.ordering, config.disk_buckets if local else None), config.output, config.output_separator)
    stage("Finalizing")
    now = time.monotonic()
    ends = [t for _, t in marks[1:]] + [now]
    stats.stage_ms = {name: round((end - start) * 1000) for (name, start), end in zip(marks, ends, strict=True)}
    stats.elapsed_ms = round((now - began) * 1000)
    stats.failed_inputs = [f"{p}: {e}" for p, e in corpus.failures]
    stats.decision, stats.sample = decision, sample
    return stats


def warnings(config: Config, status: str, reduction_pct: float, uniq_pct: float, failures: list[str]) -> list[str]:
    """What the user should know about a run."""
    cases = (
        (config.ordering == "unordered", "unordered: the order of the output is not fixed"),
        (len(config.output_separator) > 1, f"the separator has several characters: {escape_separator(config.output_separator)}"),
        (reduction_pct >= 80.0, "80 % or more of the tokens are duplicates"),
        (uniq_pct <= 20.0, "20 % or fewer of the tokens are unique"),
        (status == "error", "the run failed; nothing was written"),
        (status == "canceled", "the run was canceled; nothing was written"),
    )
    return [text for holds, text in cases if holds] + [f"not extracted: {f}" for f in failures]


@dataclass
class RunSummary:
    job_id: str
    status: str
    started_at: str
    finished_at: str
    mode: str
    mode_effective: str
    ordering: str
    output_path: str
    output_bytes: int
    input_bytes_total: int
    files_total: int
    files_done: int
    tokens_seen: int
    unique_tokens: int
    duplicates: int
    filtered_by_length: int
    reduction_pct: float
    uniq_pct: float
    elapsed_ms: int
    avg_throughput_tps: int
    peak_throughput_tps: int | None
    stage_durations_ms: dict[str, int] | None
    trim: bool
    drop_empty: bool
    drop_length_min: int | None
    drop_length_max: int | None
    output_separator_raw: str
    output_separator_preview: str
    disk_alphabetical_mode: str | None
    disk_buckets: int | None
    disk_run_bytes: int | None
    auto_available_memory_bytes: int | None
    auto_total_memory_bytes: int | None
    auto_usable_memory_bytes: int | None
    auto_safety_margin_bytes: int | None
    auto_estimated_ram_bytes: int | None
    auto_sample_tokens: int | None
    auto_sample_unique_ratio: float | None
    auto_sample_duplicate_ratio: float | None
    auto_decision_reason: str | None
    warnings: list[str]
    error_message: str | None
    per_file: list[dict[str, Any]] | None

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self))


def _stamp(at: float) -> str:
    return datetime.fromtimestamp(at, UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def summarize(job_id: str, config: Config, status: str, started: float, finished: float, stats: Stats | None, error: str | None, memory: Memory | None = None) -> RunSummary:
    s = stats or Stats()
    auto = s.decision if s.decision and s.decision.reason else None
    reduction, unique = percent(s.duplicates, s.tokens_seen), percent(s.unique_tokens, s.tokens_seen)
    disk = (s.decision.mode if s.decision else config.mode) == DISK
    elapsed = s.elapsed_ms or round((finished - started) * 1000)
    return RunSummary(
        job_id=job_id, status=status, started_at=_stamp(started), finished_at=_stamp(finished), mode=config.mode,
        mode_effective=s.decision.mode if s.decision else config.mode, ordering=config.ordering, output_path=config.output,
        output_bytes=os.path.getsize(config.output) if status == "success" and os.path.exists(config.output) else 0,
        input_bytes_total=input_bytes(config.inputs), files_total=len(config.inputs), files_done=s.files, tokens_seen=s.tokens_seen,
        unique_tokens=s.unique_tokens, duplicates=s.duplicates, filtered_by_length=s.filtered_by_length, reduction_pct=reduction, uniq_pct=unique,
        elapsed_ms=elapsed, avg_throughput_tps=s.tokens_seen * 1000 // elapsed if elapsed else 0, peak_throughput_tps=None,
        stage_durations_ms=s.stage_ms or None, trim=config.trim, drop_empty=config.drop_empty, drop_length_min=config.drop_length_min,
        drop_length_max=config.drop_length_max, output_separator_raw=escape_separator(config.output_separator),
        output_separator_preview=preview_separator(config.output_separator), disk_alphabetical_mode=config.disk_alphabetical_mode if disk else None,
        disk_buckets=config.disk_buckets if disk else None, disk_run_bytes=config.disk_run_bytes if disk else None,
        auto_available_memory_bytes=memory.available if auto and memory else None, auto_total_memory_bytes=memory.total if auto and memory else None,
        auto_usable_memory_bytes=auto.usable_bytes if auto else None,
        auto_safety_margin_bytes=max(1 << 30, memory.total // 5) if auto and memory else None, auto_estimated_ram_bytes=auto.estimated_bytes if auto else None,
        auto_sample_tokens=s.sample.tokens if auto and s.sample else None, auto_sample_unique_ratio=s.sample.unique_ratio if auto and s.sample else None,
        auto_sample_duplicate_ratio=s.sample.duplicate_ratio if auto and s.sample else None, auto_decision_reason=auto.reason if auto else None,
        warnings=warnings(config, status, reduction, unique, s.failed_inputs), error_message=error, per_file=s.per_file)


class JobManager:
    """Runs one job at a time on a thread of its own; its Spark jobs carry a tag, by which they are cancelled."""

    def __init__(self, spark: SparkSession, memory: Callable[[], Memory] = system_memory, poll_s: float = 0.125):
        self.spark, self.memory, self.poll_s = spark, memory, poll_s
        self.events: queue.Queue[Event] = queue.Queue()
        self.lock = threading.Lock()
        self.active: str | None = None
        self.stop = threading.Event()

    def start_job(self, config: Config) -> str:
        config.validate()
        with self.lock:
            if self.active:
                raise Busy(f"job {self.active} is running")
            self.active = job_id = uuid.uuid4().hex
            self.stop = threading.Event()
        threading.Thread(target=self._run, args=(job_id, dataclasses.replace(config), self.stop), daemon=True).start()
        return job_id

    def cancel_job(self, job_id: str) -> bool:
        """Whether that job was running."""
        with self.lock:
            if self.active != job_id:
                return False
            self.stop.set()
        self.spark.sparkContext.cancelJobsWithTag(job_id)
        return True

    def active_job_id(self) -> str | None:
        return self.active

    def is_running(self) -> bool:
        return self.active is not None

    def try_next_event(self) -> Event | None:
        try:
            return self.events.get_nowait()
        except queue.Empty:
            return None

    def next_event_timeout(self, seconds: float) -> Event | None:
        try:
            return self.events.get(timeout=seconds)
        except queue.Empty:
            return None

    def drain_events(self) -> list[Event]:
        out = []
        while (event := self.try_next_event()) is not None:
            out.append(event)
        return out

    def _watch(self, job_id: str, began: float, now: dict[str, Any], done: threading.Event) -> None:
        """Progress from Spark's own counts of tasks, a few times a second; the estimate smooths the speed."""
        speed, before, at = None, 0, began
        tracker = self.spark.sparkContext.statusTracker()
        while not done.wait(self.poll_s):
            infos = [i for s in tracker.getActiveStageIds() if (i := tracker.getStageInfo(s))]
            items, total = sum(i.numCompletedTasks for i in infos), sum(i.numTasks for i in infos)
            t = time.time()
            if t - at >= 0.2:
                fresh = max(0, items - before) / (t - at)
                speed, before, at = fresh if speed is None else 0.25 * fresh + 0.75 * speed, items, t
            eta = round((total - items) / speed * 1000) if speed and t - began >= 1 else None
            self.events.put(Event("progress", job_id, {"stage": now.get("stage"), "stage_items_done": items, "stage_items_total": total, "files_total": now["files"],
                                                       "progress_ppm": items * 1_000_000 // total if total else None, "elapsed_ms": round((t - began) * 1000), "eta_ms": eta}))

    def _run(self, job_id: str, config: Config, stop: threading.Event) -> None:
        began = time.time()
        now: dict[str, Any] = {"files": len(config.inputs)}
        done = threading.Event()
        self.events.put(Event("started", job_id))
        watcher = threading.Thread(target=self._watch, args=(job_id, began, now, done), daemon=True)
        watcher.start()

        def on_stage(name: str) -> None:
            now["stage"] = name
            self.events.put(Event("stage", job_id, {"stage": name}))

        stats, error, status = None, None, "success"
        self.spark.sparkContext.addJobTag(job_id)
        try:
            stats = run_dedupe(self.spark, config, on_stage, stop.is_set, self.memory)
        except Exception as e:  # the thread's only way to tell
            status, error = ("canceled", None) if stop.is_set() or isinstance(e, Canceled) else ("error", str(e) or repr(e))
        finally:
            self.spark.sparkContext.removeJobTag(job_id)
            done.set()
            watcher.join()
        with self.lock:
            self.active = None
        body = {"stats": dataclasses.asdict(stats)} if stats and status == "success" else {"message": error} if status == "error" else {}
        self.events.put(Event({"success": "done"}.get(status, status), job_id, body))
        summary = summarize(job_id, config, status, began, time.time(), stats, error, self.memory())
        self.events.put(Event("summary", job_id, {"summary": dataclasses.asdict(summary)}))
