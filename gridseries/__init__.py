"""Gridded daily measurements and their series, as Spark DataFrame operators."""
