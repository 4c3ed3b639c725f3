"""PySpark-native dataflow for document translation: lines, units, terms, prompts, resume, reassembly, metrics."""
