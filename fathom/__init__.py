"""Graph kernels and measurement-log analytics as Spark DataFrame programs."""
