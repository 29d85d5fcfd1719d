"""Settings, from defaults, a parameter file and the command line, in that order of strength."""

from __future__ import annotations

import argparse
import warnings
from dataclasses import dataclass, field, fields
from pathlib import Path


#: The names that parameter files use, and the flags of the command line.
FILE_NAMES = {
    "nSubtreesMin": "min_subtrees",
    "nPartitionsMin": "min_partitions",
    "nParticlesPerLeafMax": "leaf_size",
    "achDecompType": "decomposition",
    "achTreeType": "tree",
    "nIterations": "iterations",
    "nShareNodes": "share_nodes",
    "iCacheShareDepth": "share_depth",
    "iFlushPeriod": "flush_period",
    "iFlushPeriodMaxAvgRatio": "flush_ratio",
    "iLbPeriod": "balance_period",
    "bPeriodic": "periodic",
    "dxPeriod": "period",
    "dyPeriod": "period",
    "dzPeriod": "period",
    "nReplicas": "replicas",
    "dSoft": "softening",
    "achInputFile": "input",
    "achOutputFile": "output",
}
FLAGS = {"n": "min_subtrees", "p": "min_partitions", "l": "leaf_size", "d": "decomposition", "t": "tree", "i": "iterations", "s": "share_nodes", "u": "flush_period", "r": "flush_ratio", "b": "balance_period", "e": "softening", "f": "input", "v": "output"}
CHOICES = {"decomposition": ("oct", "binoct", "sfc", "kd", "longest"), "tree": ("oct", "binoct", "kd", "longest")}


@dataclass
class Config:
    min_partitions: int = 8
    min_subtrees: int = 8
    leaf_size: int = 12
    decomposition: str = "binoct"
    tree: str = "binoct"
    iterations: int = 3
    share_nodes: int = 0
    periodic: bool = False
    period: float = 1.0
    replicas: int = 0
    softening: float | None = None
    theta: float = 0.7
    max_dt: float = 1e-5
    # read from parameter files, but without effect: Spark has no caches of nodes to share,
    # and every step decomposes and balances anew
    share_depth: int = 0
    flush_period: int = 0
    flush_ratio: int = 0
    balance_period: int = 0
    input: str = ""
    output: str = ""
    origin: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str | None = None, args: list[str] | None = None) -> Config:
        """A file has ``name = value`` lines with # comments; a name given twice is an
        error, an unknown one a warning. Arguments are stronger: ``--name value``, a name
        of FILE_NAMES after one or two dashes, or a flag; ``-x`` names a file. The three
        periods must be equal: replicas and Ewald sums know cubes only."""
        kinds = {f.name: f.type for f in fields(cls) if f.name != "origin"}
        parser = argparse.ArgumentParser(allow_abbrev=False, add_help=False)
        parser.add_argument("-x", dest="_file")
        for name in kinds:
            parser.add_argument(f"--{name}", *(f"-{f}" for f, n in FLAGS.items() if n == name), dest=name)
        for name in FILE_NAMES:
            parser.add_argument(f"-{name}", f"--{name}", dest=f"_{name}")
        given = {k: v for k, v in vars(parser.parse_args(args or [])).items() if v is not None}
        path = given.pop("_file", path)
        out = cls()
        out.take(kinds, pairs(path), "file", path)
        out.take(kinds, [(k.removeprefix("_"), v) for k, v in given.items()], "command line")
        return out

    def take(self, kinds: dict, settings: list[tuple[str, str]], origin: str, path: str | None = None) -> None:
        seen: dict = {}
        for given, value in settings:
            name = FILE_NAMES.get(given, given)
            if name not in kinds:
                warnings.warn(f"unknown setting {given} in {path}", stacklevel=3)
                continue
            value = convert(kinds[name], value)
            if name in CHOICES and value not in CHOICES[name]:
                raise ValueError(f"{given} is {value}, not one of {', '.join(CHOICES[name])}")
            if seen.setdefault(name, value) != value:
                raise ValueError(f"{name} is given as {seen[name]} and {value}")
            setattr(self, name, value)
            self.origin[name] = origin


def pairs(path: str | None) -> list[tuple[str, str]]:
    """Names and values of a parameter file."""
    out: dict[str, str] = {}
    for line in Path(path).read_text().splitlines() if path else []:
        line = line.split("#", 1)[0].strip()
        if line:
            name, _, value = (x.strip() for x in line.partition("="))
            if name in out:
                raise ValueError(f"{name} is given twice in {path}")
            out[name] = value
    return list(out.items())


def convert(kind: str, value: str):
    if kind == "bool":
        if value.lower() not in ("0", "1", "true", "false", "yes", "no"):
            raise ValueError(f"{value} is not a truth value")
        return value.lower() in ("1", "true", "yes")
    return int(value) if kind == "int" else float(value) if kind.startswith("float") else value
