"""A PySpark-native workbench for messy tabular files."""
