"""Sequencing-read quality control as declarative Spark plans."""
