"""Results as files: one file with a separator between tokens and none behind the last, or part files in order."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame

from tallyloom.plans.config import ConfigError


def check_output(path: str, inputs: list[str], allow_overwrite: bool) -> None:
    """Raises if the output is there already and may not be replaced, or is one of the inputs."""
    if any(os.path.abspath(path) == os.path.abspath(p) for p in inputs):
        raise ConfigError("OutputIsInput", f"{path} is an input too")
    if os.path.exists(path) and not allow_overwrite:
        raise ConfigError("OutputExists", f"{path} exists")


def write_joined(tokens: DataFrame, path: str, separator: str = "\n") -> int:
    """Writes the first column in the order of ``tokens``; returns the number of tokens.

    One partition at a time comes to the driver; the file takes its name only when it is whole.
    """
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    part, n = f"{path}.part", 0
    try:
        with open(part, "w", encoding="utf-8", newline="") as f:
            for (token,) in tokens.select(tokens.columns[0]).toLocalIterator(prefetchPartitions=True):
                f.write(separator + token if n else token)
                n += 1
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)
    return n


def write_parts(tokens: DataFrame, path: str, separator: str = "\n", overwrite: bool = False) -> None:
    """Writes part files whose names are in the order of ``tokens``, from the executors; each token ends with the separator."""
    tokens.select(tokens.columns[0]).write.mode("overwrite" if overwrite else "errorifexists").text(path, lineSep=separator)
