"""Runtime behaviour analytics as Spark DataFrame functions."""
