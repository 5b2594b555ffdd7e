"""All reports with their verdicts, as text or JSON."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import QcConfig
from ..functions.columns import least_code, verdict
from ..operators import positions, reads as by_read, sequences


class QcError(Exception):
    """A report cannot be made of this input."""


def _limit(cfg: QcConfig, module: str, value: Column) -> Column:
    """Verdict of a value that should stay small."""
    return verdict(value > cfg.limit(f"{module}:error"), value > cfg.limit(f"{module}:warn"))


def statuses(reads: DataFrame, cfg: QcConfig | None = None) -> DataFrame:
    """ord, report, status: a row for each report, but for tiles where ids name none."""
    cfg = cfg or QcConfig()
    low = lambda c, level: F.coalesce(F.min(c) < cfg.limit(f"quality_base_{'median' if c == 'median' else 'lower'}:{level}"), F.lit(False))
    content = F.greatest(F.max(F.abs(F.col("c_percent") - F.col("g_percent"))), F.max(F.abs(F.col("t_percent") - F.col("a_percent"))))
    score = F.max_by(F.col("score"), F.struct("count", -F.col("score")))
    lengths = reads.agg(F.min(F.length("seq")).alias("lo"), F.max(F.length("seq")).alias("hi"))
    on = lambda level: F.lit(cfg.limit(f"sequence_length:{level}") != 0)
    quality = by_read.per_sequence_quality(reads)
    offset = reads.agg(F.min(least_code(F.col("qual"))).alias("least")).select(F.when(F.col("least") < 64, 33).otherwise(64).alias("offset"))
    kmers = sequences.kmer_enrichment(reads, cfg)
    first = F.max_by("p_value", F.struct("max_obs_exp", F.expr("transform(split(sequence, ''), x -> -ascii(x))")))
    strength = F.when(F.count(F.lit(1)) == 0, 1.0).when(first <= 0, math.inf).otherwise(-F.log10(first))
    rows = [
        ("Basic Statistics", by_read.basic_statistics(reads).agg(F.lit("Pass").alias("status"))),
        ("Per base sequence quality", positions.per_base_quality(reads, cfg).agg(verdict(low("median", "error") | low("lower_quartile", "error"), low("median", "warn") | low("lower_quartile", "warn")).alias("status"))),
        ("Per tile sequence quality", positions.per_tile_quality(reads, cfg).agg(_limit(cfg, "tile", F.greatest(F.max("deviation"), F.lit(0.0))).alias("status"), F.count(F.lit(1)).alias("n")).filter("n > 0").drop("n")),
        ("Per sequence quality scores", quality.crossJoin(F.broadcast(offset)).agg((score + F.max("offset")).alias("code")).select(_limit(cfg, "quality_sequence", F.col("code")).alias("status"))),
        ("Per base sequence content", positions.per_base_content(reads, cfg).agg(_limit(cfg, "sequence", content).alias("status"))),
        ("Per sequence GC content", by_read.gc_theoretical(reads).agg(_limit(cfg, "gc_sequence", F.max("deviation_percent")).alias("status"))),
        ("Per base N content", positions.n_content(reads, cfg).agg(_limit(cfg, "n_content", F.max("percentage")).alias("status"))),
        ("Sequence Length Distribution", lengths.select(verdict(on("error") & (F.col("lo") == 0), on("warn") & (F.col("lo") == F.col("hi"))).alias("status"))),
        ("Sequence Duplication Levels", reads.agg(F.lit("Pass").alias("status"))),
        ("Overrepresented sequences", sequences.overrepresented(reads, cfg).agg(_limit(cfg, "overrepresented", F.coalesce(F.max("percentage"), F.lit(0.0))).alias("status"))),
        ("Adapter Content", sequences.adapter_content(reads, cfg).agg(_limit(cfg, "adapter", F.coalesce(F.max("enrichment"), F.lit(0.0))).alias("status"))),
        ("Kmer Content", kmers.agg(_limit(cfg, "kmer", strength).alias("status"))),
    ]
    out = None
    for i, (name, df) in enumerate(rows):
        row = df.select(F.lit(i).alias("ord"), F.lit(name).alias("report"), "status")
        out = row if out is None else out.unionByName(row)
    return out


@dataclass
class Report:
    """One finished report: a small table and its verdict."""

    name: str
    status: str
    columns: list[str]
    rows: list[tuple]


#: Name, operator, order of rows, and whether the operator takes a configuration.
MODULES = (
    ("Basic Statistics", by_read.basic_statistics, [], False),
    ("Per base sequence quality", positions.per_base_quality, ["lower_base"], True),
    ("Per tile sequence quality", positions.per_tile_quality, ["tile", "lower_base"], True),
    ("Per sequence quality scores", by_read.per_sequence_quality, ["score"], False),
    ("Per base sequence content", positions.per_base_content, ["lower_base"], True),
    ("Per sequence GC content", by_read.gc_theoretical, ["gc_pct"], False),
    ("Per base N content", positions.n_content, ["lower_base"], True),
    ("Sequence Length Distribution", by_read.length_distribution, ["lower_length"], False),
    ("Sequence Duplication Levels", sequences.duplication_levels, ["slot"], True),
    ("Overrepresented sequences", sequences.contaminant_hits, ["-count", "seq"], True),
    ("Adapter Content", sequences.adapter_content, ["adapter_ord", "lower_base"], True),
    ("Kmer Content", sequences.kmer_enrichment, ["-max_obs_exp", "sequence"], True),
)
#: Two pairs of reports share a name in the compatible output; of each the later one remains in JSON.
COMPATIBLE = {"Overrepresented sequences": "Sequence Duplication Levels", "Kmer Content": "Adapter Content"}


#: Names of reports in the limits, where they can be set to be ignored.
LIMIT_NAMES = dict(zip((m[0] for m in MODULES[1:]), ("quality_base", "tile", "quality_sequence", "sequence", "gc_sequence", "n_content", "sequence_length", "duplication", "overrepresented", "adapter", "kmer"), strict=True))


def build(reads: DataFrame, cfg: QcConfig | None = None) -> list[Report]:
    """All reports; their tables are small (positions, bins, fewer than 1000 sequences). Reports whose limit `ignore` is not 0 are left out."""
    cfg = cfg or QcConfig()
    reads = reads.persist()
    try:
        if by_read.basic_statistics(reads).first()["encoding"] is None:
            raise QcError("no known quality encoding: no reads, or quality bytes out of range")
        status = {r["report"]: r["status"] for r in statuses(reads, cfg).collect()}
        out = []
        for name, operator, order, takes in MODULES:
            if name in status and not cfg.limits.get(f"{LIMIT_NAMES.get(name)}:ignore", 0):
                df = operator(reads, cfg) if takes else operator(reads)
                df = df.orderBy(*[F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in order]) if order else df
                out.append(Report(name, status[name], df.columns, [tuple(r) for r in df.collect()]))
        return out
    finally:
        reads.unpersist()


def _plain(x) -> str:
    """A value as text: whole numbers without a fraction, missing ones as NaN."""
    if x is None:
        return "NaN"
    return str(int(x)) if isinstance(x, float) and x.is_integer() else str(x)


def _span(row: dict, lower: str, upper: str) -> str:
    return f"{row[lower]}" if row[lower] == row[upper] else f"{row[lower]}-{row[upper]}"


def _table(head: str | None, *cells):
    """Lines of a report: a header, then a line for each row; cells are column names or functions of a row."""

    def lines(rows: list[dict]) -> list[str]:
        body = ["\t".join(c(r) if callable(c) else _plain(r[c]) for c in cells) for r in rows]
        return body if head is None else [head, *body]

    return lines


def _base(row: dict) -> str:
    return _span(row, "lower_base", "upper_base")


def _basic_lines(rows: list[dict]) -> list[str]:
    r = rows[0]
    parts = (("Encoding", r["encoding"]), ("Total Sequences", r["total_sequence"]), ("Filtered Sequences", r["filtered_sequence"]),
             ("Sequence length", _span(r, "sequence_min_length", "sequence_max_length")), ("%GC", r["gc_percent"]))
    return [f"{k}\t{_plain(v)}" for k, v in parts]


def _duplication_lines(rows: list[dict]) -> list[str]:
    table = _table("#Duplication Level\tPercentage of deduplicated\tPercentage of total\n", "label", "deduplicated_percentage", "total_percentage")
    return ["#Total Deduplicated Percentage", _plain(rows[0]["total_dedup_percentage"]), *table(rows)]


def _by_adapter(rows: list[dict]) -> tuple[list[str], list[tuple[int, int]], dict]:
    names = list(dict.fromkeys(r["adapter"] for r in rows))
    groups = list(dict.fromkeys((r["lower_base"], r["upper_base"]) for r in rows))
    return names, groups, {(r["adapter"], r["lower_base"]): r["enrichment"] for r in rows}


def _adapter_lines(rows: list[dict]) -> list[str]:
    names, groups, at = _by_adapter(rows)
    return ["\t".join(["#Position", *names])] + ["\t".join([f"{lo}" if lo == hi else f"{lo}-{hi}", *(_plain(at[n, lo]) for n in names)]) for lo, hi in groups]


#: Text bodies by report. Headers are fixed values.
BODIES = {
    "Basic Statistics": _basic_lines,
    "Per base sequence quality": _table(None, _base, "mean", "median", "lower_quartile", "upper_quartile", "percentile_10", "percentile_90"),
    "Per tile sequence quality": _table("Tile\tBase\tMean", "tile", _base, "deviation"),
    "Per sequence quality scores": _table(None, "score", "count"),
    "Per base sequence content": _table("#Base\tG\tA\tT\tC", _base, "g_percent", "a_percent", "t_percent", "c_percent"),
    "Per sequence GC content": _table("#GC Content\tCount", "gc_pct", "count"),
    "Per base N content": _table("#Base\tN-Count", _base, "percentage"),
    "Sequence Length Distribution": _table("#Length Count", lambda r: _span(r, "lower_length", "upper_length"), "count"),
    "Sequence Duplication Levels": _duplication_lines,
    "Overrepresented sequences": _table("#Sequence\tCount\tPercentage\tPossible Source", "seq", "count", "percentage", "possible_source"),
    "Adapter Content": _adapter_lines,
    "Kmer Content": _table("#Sequence\tCount\tPValue\tObs/Exp Max\tMax Obs/Exp Position", "sequence", "count", "p_value", "max_obs_exp", lambda r: _span(r, "max_lower_position", "max_upper_position")),
}


def _dicts(r: Report) -> list[dict]:
    return [dict(zip(r.columns, row, strict=True)) for row in r.rows]


def to_text(reports: list[Report], compat_keys: bool = False) -> str:
    """Sections between >>name<tab>status and >>END_MODULE; a position range is written n or lo-hi."""
    lines = []
    for r in reports:
        name = COMPATIBLE.get(r.name, r.name) if compat_keys else r.name
        lines += [f">>{name}\t{r.status}", *(BODIES[r.name](_dicts(r)) if r.rows or r.name == "Kmer Content" else []), ">>END_MODULE"]
    return "\n".join(lines) + "\n"


def _groups(rows: list[dict]) -> list[dict]:
    seen = dict.fromkeys((r["lower_base"], r["upper_base"]) for r in rows)
    return [{"lower_count": lo, "upper_count": hi} for lo, hi in seen]


def _pick(*columns: str, **renamed: str):
    return lambda rows: [{c: r[c] for c in columns} | {new: r[old] for new, old in renamed.items()} for r in rows]


def _tiles(rows: list[dict]) -> dict:
    by = {}
    for r in rows:
        by.setdefault(r["tile"], []).append(r["deviation"])
    return {"tiles": list(by), "groups": _groups(rows), "qualities": list(by.values())}


def _adapters(rows: list[dict]) -> dict:
    names, groups, at = _by_adapter(rows)
    return {"groups": _groups(rows), "adapter_names": names, "enrichments": [[at[n, lo] for lo, _ in groups] for n in names]}


_BASIC = ("encoding", "total_sequence", "filtered_sequence", "sequence_min_length", "sequence_max_length", "gc_percent")
_QUALITY = ("lower_base", "upper_base", "mean", "median", "lower_quartile", "upper_quartile", "percentile_10", "percentile_90")
#: JSON fields by report, beside status.
FIELDS = {
    "Basic Statistics": lambda rows: _pick(*_BASIC)(rows)[0],
    "Per base sequence quality": lambda rows: {"quality_data": _pick(*_QUALITY)(rows)},
    "Per tile sequence quality": _tiles,
    "Per sequence quality scores": lambda rows: {"qualities": [[r["score"], r["count"]] for r in rows]},
    "Per base sequence content": lambda rows: {"group": _groups(rows), "percents": [[r[f"{b}_percent"] for b in "gatc"] for r in rows]},
    "Per sequence GC content": lambda rows: {"gc_distribution": [r["count"] for r in rows], "theoretical_distribution": [r["theoretical"] for r in rows]},
    "Per base N content": lambda rows: {"groups": _groups(rows), "percentages": [r["percentage"] for r in rows]},
    "Sequence Length Distribution": lambda rows: {"length_counts": _pick(lower_count="lower_length", upper_count="upper_length", value="count")(rows)},
    "Sequence Duplication Levels": lambda rows: {"total_dedup_percentage": rows[0]["total_dedup_percentage"], "duplication_levels": _pick("label", "deduplicated_percentage", "total_percentage")(rows)},
    "Overrepresented sequences": lambda rows: {"over_represented": _pick("seq", "count", "percentage", "possible_source")(rows)},
    "Adapter Content": _adapters,
    "Kmer Content": lambda rows: {"kmers": _pick("sequence", "count", "p_value", "max_obs_exp", "max_lower_position", "max_upper_position")(rows)},
}


def _finite(x):
    """x without what JSON has no number for."""
    if isinstance(x, dict):
        return {k: _finite(v) for k, v in x.items()}
    if isinstance(x, list):
        return [_finite(v) for v in x]
    return None if isinstance(x, float) and not math.isfinite(x) else x


def to_json(reports: list[Report], compat_keys: bool = False) -> str:
    """One object keyed by report name. compat_keys: shared names, so that the later of two reports replaces the earlier."""
    out = {}
    for r in reports:
        key = COMPATIBLE.get(r.name, r.name) if compat_keys else r.name
        out[key] = {"status": r.status} | _finite(FIELDS[r.name](_dicts(r)))
    return json.dumps(out, indent=2, sort_keys=True)
