"""Dataflow and analytics operators as Spark DataFrame plans."""
