"""python -m helixlens.cli [-a adapters] [-c contaminants] [-l limits] [-o report.txt] file..."""

from __future__ import annotations

import argparse
from dataclasses import replace
from pathlib import Path

from pyspark.sql import SparkSession

from .config import GroupKind, QcConfig, parse_dictionary, parse_limits
from .plans.report import build, to_json, to_text
from .plans.session import ship
from .sources.fastq import read_fastq


def parse(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="helixlens", description="Quality control of sequencing reads")
    p.add_argument("files", nargs="+", help="FASTQ files, reported one by one")
    p.add_argument("-a", "--adapters", type=Path, help="tab-separated adapters")
    p.add_argument("-c", "--contaminants", type=Path, help="tab-separated contaminants")
    p.add_argument("-l", "--limits", type=Path, help="thresholds: module, level, value")
    p.add_argument("-o", "--output", type=Path, default=Path("qc_report.txt"), help="text report")
    p.add_argument("-g", "--grouping", choices=[k.value for k in GroupKind], default=GroupKind.LINEAR.value)
    p.add_argument("--compat-keys", action="store_true", help="the shared names of two pairs of reports")
    return p.parse_args(args)


def config(options: argparse.Namespace) -> QcConfig:
    cfg = QcConfig(grouping=GroupKind(options.grouping))
    if options.limits:
        cfg = replace(cfg, limits=parse_limits(options.limits.read_text(), cfg.limits))
    if options.adapters:
        cfg = replace(cfg, adapters=parse_dictionary(options.adapters.read_text()))
    if options.contaminants:
        cfg = replace(cfg, contaminants=parse_dictionary(options.contaminants.read_text()))
    return cfg


def main(args: list[str] | None = None) -> None:
    options = parse(args)
    cfg = config(options)
    spark = ship(SparkSession.builder.appName("helixlens").getOrCreate())
    texts = []
    for file in options.files:
        reports = build(read_fastq(spark, file), cfg)
        texts.append(to_text(reports, options.compat_keys))
        print(to_json(reports, options.compat_keys))
    options.output.write_text("".join(texts))


if __name__ == "__main__":
    main()
