"""Media-library and dataset-hygiene analytics as DataFrame -> DataFrame operators."""
