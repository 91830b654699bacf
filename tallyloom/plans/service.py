"""Requests and responses: what an application calls. Every error has a category."""

from __future__ import annotations

import dataclasses
import os
import time
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import tallyloom
from tallyloom.operators.frequency import token_frequency
from tallyloom.operators.fuzzy import fuzzy_clusters
from tallyloom.operators.distinct import ALPHABETICAL, PRESERVE, first_seen
from tallyloom.operators.lookup import WordChecker
from tallyloom.operators.ngram import distinct_ngrams, ngram_stats
from tallyloom.operators.setops import set_op, set_stats
from tallyloom.operators.tokens import tokens
from tallyloom.functions.spill import written
from tallyloom.plans.config import Config, ConfigError, unescape_separator
from tallyloom.plans.job import Busy, Event, JobManager
from tallyloom.sources.files import expand_paths, file_corpus
from tallyloom.sources.sink import check_output, write_joined


class CommandError(RuntimeError):
    """category: invalid_config, output_exists, job_busy, runtime_error, checker_not_loaded or internal_error."""

    def __init__(self, category: str, message: str):
        super().__init__(message)
        self.category = category


@dataclass
class TokenRequest:
    """What all requests that write tokens have."""

    inputs: list[str] = field(default_factory=list)
    output: str = ""
    allow_overwrite: bool = False
    ordering: str = PRESERVE
    trim: bool = True
    drop_empty: bool = True
    drop_length_min: int | None = None
    drop_length_max: int | None = None
    output_separator: str = "\n"
    interpret_separator_escapes: bool = False
    extract_rich: bool = True

    def config(self, **more) -> Config:
        separator = unescape_separator(self.output_separator) if self.interpret_separator_escapes else self.output_separator
        return Config(inputs=expand_paths(self.inputs), output=self.output, output_separator=separator, ordering=self.ordering, trim=self.trim,
                      drop_empty=self.drop_empty, drop_length_min=self.drop_length_min, drop_length_max=self.drop_length_max, **more)


@dataclass
class JobRequest(TokenRequest):
    mode: str = "auto"
    disk_buckets: int = 256
    disk_alphabetical_mode: str = "fast-bucket-local"
    disk_run_bytes: int = 256 << 20
    per_file_stats: bool = False


@dataclass
class FrequencyRequest(TokenRequest):
    top_n: int | None = None


@dataclass
class SetOpRequest(TokenRequest):
    """``inputs`` is the left side."""

    right: list[str] = field(default_factory=list)
    op: str = "diff"


@dataclass
class FuzzyRequest(TokenRequest):
    max_edit_distance: int = 1


@dataclass
class NgramRequest(TokenRequest):
    n: int = 2


class Service:
    """All operations on one session. Jobs run in the background; the others answer when they are done."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.jobs = JobManager(spark)
        self.checker: WordChecker | None = None

    def _guarded(self, make):
        try:
            return make()
        except ConfigError as e:
            raise CommandError("output_exists" if e.kind == "OutputExists" else "invalid_config", str(e)) from e
        except Busy as e:
            raise CommandError("job_busy", str(e)) from e
        except (FileNotFoundError, PermissionError, OSError) as e:
            raise CommandError("runtime_error", str(e)) from e
        except ValueError as e:
            raise CommandError("invalid_config", str(e)) from e

    def start_job(self, request: JobRequest) -> str:
        def go() -> str:
            config = request.config(mode=request.mode, disk_buckets=request.disk_buckets, disk_alphabetical_mode=request.disk_alphabetical_mode,
                                    disk_run_bytes=request.disk_run_bytes, per_file_stats=request.per_file_stats)
            config.validate()
            check_output(config.output, config.inputs, request.allow_overwrite)
            return self.jobs.start_job(config)

        return self._guarded(go)

    def cancel_job(self, job_id: str) -> bool:
        return self.jobs.cancel_job(job_id)

    def app_info(self) -> dict[str, str]:
        return {"name": tallyloom.__name__, "version": tallyloom.__version__, "spark": self.spark.version}

    def runtime_state(self) -> dict[str, object]:
        return {"running": self.jobs.is_running(), "active_job_id": self.jobs.active_job_id()}

    def next_events(self, seconds: float, most: int) -> list[Event]:
        """Up to ``most`` events (1 to 256), the first within ``seconds`` (5 at most)."""
        first = self.jobs.next_event_timeout(min(5.0, max(0.0, seconds)))
        out = [first] if first else []
        while first and len(out) < min(256, max(1, most)) and (event := self.jobs.try_next_event()) is not None:
            out.append(event)
        return out

    def load_word_list(self, path: str) -> int:
        """Distinct tokens of the list."""
        def go() -> int:
            if not os.path.exists(path):
                raise FileNotFoundError(f"{path} is not there")
            if self.checker:
                self.checker.close()
            self.checker = WordChecker(file_corpus(self.spark, expand_paths([path])).lines)
            return len(self.checker)

        return self._guarded(go)

    def check_word(self, word: str) -> tuple[bool, int]:
        """(found, size of the list); the word is taken as it is."""
        if self.checker is None:
            raise CommandError("checker_not_loaded", "no word list is loaded")
        return word in self.checker, len(self.checker)

    def _checked(self, request: TokenRequest, right: list[str] = ()) -> Config:
        config = request.config()
        config.validate()
        check_output(config.output, [*config.inputs, *right], request.allow_overwrite)
        return config

    def frequency(self, request: FrequencyRequest) -> dict[str, object]:
        """entries (token, count), and the totals over all tokens whatever ``top_n`` is."""
        def go() -> dict[str, object]:
            config = request.config()
            if not config.inputs:
                return {"entries": [], "tokens_seen": 0, "unique_tokens": 0}
            corpus = file_corpus(self.spark, config.inputs, request.extract_rich).lines
            counted = written(token_frequency(corpus, config.filters), "frequency")
            totals = counted.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("u")).collect()[0]
            top = counted.orderBy(F.desc("count"), F.asc("token"))
            rows = (top if request.top_n is None else top.limit(request.top_n)).collect()
            return {"entries": [(r["token"], r["count"]) for r in rows], "tokens_seen": totals["n"], "unique_tokens": totals["u"]}

        return self._guarded(go)

    def set_operation(self, request: SetOpRequest) -> dict[str, object]:
        def go() -> dict[str, object]:
            began = time.monotonic()
            right_paths = expand_paths(request.right)
            config = self._checked(request, right_paths)
            left, right = (file_corpus(self.spark, p, request.extract_rich).lines for p in (config.inputs, right_paths))
            stats = set_stats(left, right, request.op, config.filters).collect()[0]
            write_joined(set_op(left, right, request.op, config.filters, config.ordering), config.output, config.output_separator)
            return {"unique_tokens": stats["unique_tokens"], "tokens_seen": stats["tokens_seen"], "duplicates": stats["duplicates"],
                    "files": len(config.inputs) + len(right_paths), "elapsed_ms": round((time.monotonic() - began) * 1000), "output_path": config.output}

        return self._guarded(go)

    def fuzzy(self, request: FuzzyRequest) -> dict[str, object]:
        def go() -> dict[str, object]:
            began = time.monotonic()
            if not 1 <= request.max_edit_distance <= 10:
                raise ConfigError("MaxEdit", "the edit distance must be from 1 to 10")
            config = self._checked(request)
            corpus = file_corpus(self.spark, config.inputs, request.extract_rich).lines
            words = written(first_seen(corpus, config.filters), "fuzzy-words")
            clusters = written(fuzzy_clusters(words, request.max_edit_distance), "fuzzy-clusters")
            kept = clusters.filter("token = representative").select("token")
            if config.ordering == PRESERVE:
                kept = words.join(kept, "token", "left_semi").orderBy("first").select("token")
            elif config.ordering == ALPHABETICAL:
                kept = kept.orderBy("token")
            found = write_joined(kept, config.output, config.output_separator)
            return {"tokens_seen": tokens(corpus, config.filters).count(), "exact_unique": words.count(), "clusters_found": found,
                    "elapsed_ms": round((time.monotonic() - began) * 1000), "output_path": config.output}

        return self._guarded(go)

    def ngrams(self, request: NgramRequest) -> dict[str, object]:
        def go() -> dict[str, object]:
            began = time.monotonic()
            config = self._checked(request)
            corpus = file_corpus(self.spark, config.inputs, request.extract_rich).lines
            stats = ngram_stats(corpus, request.n, config.filters).collect()[0]
            write_joined(distinct_ngrams(corpus, request.n, config.filters, config.ordering), config.output, config.output_separator)
            return stats.asDict() | {"files": len(config.inputs), "elapsed_ms": round((time.monotonic() - began) * 1000), "output_path": config.output}

        return self._guarded(go)

    @staticmethod
    def request_fields(kind: type) -> dict[str, object]:
        """Names and defaults of a request, for interfaces that build forms."""
        return {f.name: f.default if f.default is not dataclasses.MISSING else [] for f in dataclasses.fields(kind)}
