"""Lists of datasets and of names: small text files, read on the driver."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

from .files import open_plain

MODES = ("reads", "unitigs", "auto")
NAME = re.compile(r"[A-Za-z0-9._-]+")
#: Suffixes that automatic names drop, in this order, each once.
SUFFIXES = (".gz", ".xz", ".zstd", ".zst", ".fasta", ".fastq", ".fna", ".fa", ".fq")


def auto_name(number: int, path: str) -> str:
    """A name for the number-th dataset (from 1) of a list, from its file's name."""
    base = path.rstrip("/").rsplit("/", 1)[-1]
    for suffix in SUFFIXES:
        base = base.removesuffix(suffix)
    return f"{number:06d}_" + re.sub(r"[^A-Za-z0-9._-]", "_", base)


def check_name(name: str) -> str:
    if not NAME.fullmatch(name) or name in (".", ".."):
        raise ValueError(f"a dataset's name has only ASCII letters, digits, dots, dashes and underscores: {name}")
    return name


def parse_datasets(lines, default: str = "auto") -> list[tuple[int, str, str, str]]:
    """(number, name, path, mode) of lines with a path, a name and a path, or these and a mode, by tabs; # comments and blank
    lines are left out; bad lines, names and modes, and names that repeat, raise."""
    found, names = [], set()
    for n, line in enumerate(lines, 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        fields = [x.strip() for x in line.split("\t")]
        if len(fields) > 3 or not all(fields):
            raise ValueError(f"line {n}: expected a path, or name and path, or name, path and mode")
        path = fields[0] if len(fields) == 1 else fields[1]
        name = auto_name(len(found) + 1, path) if len(fields) == 1 else fields[0]
        mode = fields[2] if len(fields) == 3 else default
        if mode not in MODES:
            raise ValueError(f"line {n}: unknown mode {mode}")
        if check_name(name) in names:
            raise ValueError(f"line {n}: repeated name {name}")
        names.add(name)
        found.append((len(found) + 1, name, path, mode))
    if not found:
        raise ValueError("the list has no datasets")
    return found


def read_datasets(spark: SparkSession, path: str, default: str = "auto") -> DataFrame:
    """(dataset_id, name, path, mode) of a list; paths are relative to the list's folder; local ones must be files."""
    with open_plain(path) as stream:
        rows = parse_datasets(stream.read().decode().splitlines(), default)
    home, out = path.rsplit("/", 1)[0] if "/" in path else ".", []
    for number, name, where, mode in rows:
        full = where if where.startswith("/") or "://" in where else f"{home}/{where}"
        if "://" not in full:
            full = os.path.realpath(full.removeprefix("file:"))
            if not os.path.isfile(full):
                raise ValueError(f"not a file: {where}")
        out.append((number, name, full, mode))
    return spark.createDataFrame(out, "dataset_id int, name string, path string, mode string")


def read_names(spark: SparkSession, path: str | None, given: tuple[str, ...] = ()) -> DataFrame:
    """(name): the distinct names of a list (# comments and blank lines left out) and those given; an empty list raises."""
    names = list(given)
    if path is not None:
        with open_plain(path) as stream:
            names += [x for x in (line.strip() for line in stream.read().decode().splitlines()) if x and not x.startswith("#")]
        if not names:
            raise ValueError("the list is empty")
    return spark.createDataFrame([(x,) for x in dict.fromkeys(names)], "name string")
