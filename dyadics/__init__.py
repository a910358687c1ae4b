"""Paired-choice analytics expressed as Spark DataFrame plans."""
