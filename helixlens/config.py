"""Job configuration: thresholds, dictionaries and position grouping."""

from __future__ import annotations

import pkgutil
from dataclasses import dataclass, field
from enum import Enum


class GroupKind(Enum):
    NONE = "none"
    LINEAR = "linear"
    EXPONENTIAL = "exponential"


def split_by_space(line: str) -> list[str]:
    """Tokens between runs of white space; a last token that starts at the line's first column is no token."""
    tokens = line.split()
    return [] if len(tokens) == 1 and not line[:1].isspace() and not line[-1:].isspace() else tokens


def parse_limits(text: str, base: dict[str, float] | None = None) -> dict[str, float]:
    """Thresholds by "module:level" over those of base.

    Comments and empty lines are skipped; a line without exactly three tokens ends the reading; a threshold that is no
    number is passed over.
    """
    limits = dict(base or {})
    for line in text.splitlines():
        if not line or line.startswith("#"):
            continue
        tokens = split_by_space(line)
        if len(tokens) != 3:
            break
        try:
            limits[f"{tokens[0]}:{tokens[1]}"] = float(tokens[2])
        except ValueError:
            continue
    return limits


def parse_dictionary(text: str) -> list[tuple[str, str]]:
    """(name, sequence) of a tab-separated dictionary: before the first and after the last tab; other lines are skipped."""
    lines = [x for x in text.splitlines() if x and not x.startswith("#") and "\t" in x]
    return [(x.split("\t", 1)[0], x.rsplit("\t", 1)[1]) for x in lines]


def bundled(name: str) -> str:
    return pkgutil.get_data("helixlens.dims", name).decode()


@dataclass(frozen=True)
class QcConfig:
    """What a quality-control run is told; thresholds are read with limit("module:level")."""

    limits: dict[str, float] = field(default_factory=lambda: parse_limits(bundled("limits.txt")))
    adapters: list[tuple[str, str]] = field(default_factory=lambda: parse_dictionary(bundled("adapters.tsv")))
    contaminants: list[tuple[str, str]] = field(default_factory=lambda: parse_dictionary(bundled("contaminants.tsv")))
    grouping: GroupKind = GroupKind.LINEAR
    unique_cap: int = 100_000
    tile_cap: int = 501
    tile_sample: int = 10
    kmer_sample: int = 50
    kmer_prefix: int = 500
    kmer_size: int = 7
    overrepresented_percent: float = 0.1

    def limit(self, key: str) -> float:
        if key not in self.limits:
            raise KeyError(f"no threshold {key}")
        return self.limits[key]
