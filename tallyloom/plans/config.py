"""Parameters of a query, their validation, and the choice of a mode."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from tallyloom.functions.tokens import Filters

AUTO, RAM, DISK = "auto", "ram", "disk"
MODES = (AUTO, RAM, DISK)
ORDERINGS = ("preserve", "alphabetical", "unordered")
BUCKET_LOCAL, GLOBAL = "fast-bucket-local", "global-perfect"
_GIB, _MIB = 1 << 30, 1 << 20


class ConfigError(ValueError):
    """A parameter that cannot be: ``kind`` names the rule."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


@dataclass
class Config:
    inputs: list[str] = field(default_factory=list)
    output: str = ""
    output_separator: str = "\n"
    mode: str = AUTO
    ordering: str = "preserve"
    trim: bool = True
    drop_empty: bool = True
    drop_length_min: int | None = None
    drop_length_max: int | None = None
    disk_buckets: int = 256
    disk_alphabetical_mode: str = BUCKET_LOCAL
    disk_run_bytes: int = 256 * _MIB
    per_file_stats: bool = False

    @property
    def filters(self) -> Filters:
        return Filters(self.trim, self.drop_empty, self.drop_length_min, self.drop_length_max)

    def validate(self) -> None:
        """Raises ``ConfigError`` for the first rule that is broken. Disk parameters count in every mode."""
        low, high = self.drop_length_min, self.drop_length_max
        both = low is not None and high is not None
        rules = (
            (not self.inputs, "NoInputs", "at least one input is needed"),
            (not self.output, "NoOutput", "an output is needed"),
            (not self.output_separator, "EmptySeparator", "the separator must not be empty"),
            (self.mode not in MODES, "Mode", f"mode must be one of {', '.join(MODES)}"),
            (self.ordering not in ORDERINGS, "Ordering", f"ordering must be one of {', '.join(ORDERINGS)}"),
            (both and not 1 <= (low or 0) <= 10, "DropLengthMinOutOfRange", "the smallest dropped length must be from 1 to 10"),
            (both and not 1 <= (high or 0) <= 10, "DropLengthMaxOutOfRange", "the largest dropped length must be from 1 to 10"),
            (both and (low or 0) > (high or 0), "DropLengthRangeInverted", "the smallest dropped length is over the largest"),
            (self.disk_buckets < 8, "DiskBucketsTooSmall", "at least 8 buckets are needed"),
            (self.disk_run_bytes < 1_000_000, "DiskRunBytesTooSmall", "a run needs at least 1000000 bytes"),
        )
        for broken, kind, message in rules:
            if broken:
                raise ConfigError(kind, message)


_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "\\": "\\"}


def unescape_separator(text: str) -> str:
    r"""``\n \t \r \f \\`` become characters and ``\rn`` a carriage return and line feed; other escapes stay as they are."""
    return re.sub(r"\\(rn|.)", lambda m: "\r\n" if m[1] == "rn" else _ESCAPES.get(m[1], m[0]), text, flags=re.DOTALL)


def escape_separator(text: str) -> str:
    return "".join({v: "\\" + k for k, v in _ESCAPES.items()}.get(c, c) for c in text)


def preview_separator(text: str) -> str:
    return text.translate({10: "↵", 13: "␍", 9: "⇥", 12: "␌"})


_UNITS = {"": 1, "B": 1, "K": 1 << 10, "KB": 1 << 10, "M": _MIB, "MB": _MIB, "G": _GIB, "GB": _GIB}


def parse_size(text: str) -> int:
    """Bytes of sizes such as 42, 1KB, 2mb or 3G, in powers of 1024."""
    found = re.fullmatch(r"\s*([0-9]+)\s*([A-Za-z]*)\s*", text)
    if not found or found[2].upper() not in _UNITS:
        raise ConfigError("Size", f"not a size: {text!r}")
    return int(found[1]) * _UNITS[found[2].upper()]


def percent(part: int, whole: int) -> float:
    """Hundredths rounded to two decimals, halves upwards; 0 of nothing."""
    return math.floor(part * 100 / whole * 100 + 0.5) / 100 if whole else 0.0


@dataclass(frozen=True)
class Memory:
    total: int
    available: int
    free: int


@dataclass(frozen=True)
class Sample:
    """What a look at the input found: see ``tallyloom.sources.files.sample_files``."""

    tokens: int = 0
    unique: int = 0
    duplicates: int = 0
    avg_bytes: float = 0.0
    density: float = 0.0  # tokens for each byte
    sampled_bytes: int = 0

    @property
    def unique_ratio(self) -> float:
        return self.unique / self.tokens if self.tokens else 0.0

    @property
    def duplicate_ratio(self) -> float:
        return self.duplicates / self.tokens if self.tokens else 0.0


@dataclass(frozen=True)
class Decision:
    mode: str
    reason: str
    usable_bytes: int
    estimated_bytes: int
    input_bytes: int


#: Bytes that a held token costs besides its own, and the surcharge on the estimate.
_TOKEN_COST, _LEAST_TOKEN, _SURCHARGE = 56, 4, 1.20


def estimated_memory(input_bytes: int, sample: Sample) -> int:
    unique = input_bytes * sample.density * sample.unique_ratio
    return math.ceil(_SURCHARGE * unique * (max(sample.avg_bytes, _LEAST_TOKEN) + _TOKEN_COST))


def decide_mode(files: int, input_bytes: int, sample: Sample, memory: Memory, ordering: str = "preserve") -> Decision:
    """The automatic mode. Spark spills by itself, so the mode says how output is dealt, and is reported."""
    available = memory.available or memory.free
    usable = max(0, available - int(max(_GIB, 0.20 * memory.total)))
    estimate = estimated_memory(input_bytes, sample)
    most, half = (math.floor(share * usable + 0.5) for share in (0.70, 0.50))
    none = memory.available == 0
    table = (
        (none and memory.free > 0 and input_bytes > memory.free // 2, DISK, "available_memory_zero_fallback_to_free_memory"),
        (none and memory.total > 0 and input_bytes > memory.total // 2, DISK, "available_memory_zero_fallback_to_total_memory"),
        (none, RAM, "available_memory_zero_fallback_ram"),
        (most > 0 and estimate > most, DISK, "estimated_ram_exceeds_70pct_usable_memory"),
        (usable < 512 * _MIB and input_bytes > 64 * _MIB, DISK, "usable_memory_below_512mb_with_large_input"),
        (files >= 2 and input_bytes > 128 * _MIB and 0.10 <= sample.duplicate_ratio <= 0.90 and ordering == "preserve", DISK, "multi_file_partial_overlap_prefers_disk"),
        (files == 1 and half > 0 and estimate <= half, RAM, "single_file_within_50pct_usable_memory"),
        (usable > 0 and estimate <= usable, RAM, "estimated_ram_fits_usable_memory"),
        (usable == 0 and input_bytes <= 64 * _MIB, RAM, "usable_memory_zero_but_input_small"),
        (True, DISK, "conservative_disk_fallback"),
    )
    mode, reason = next((m, r) for holds, m, r in table if holds)
    return Decision(mode, reason, usable, estimate, input_bytes)
