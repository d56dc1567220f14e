"""Training-data operators: language id, token files, similarity joins, quality,
URL lists, page text, source mixing, toxicity, repeated passages, benchmark
decontamination. Nothing else in the library imports this subpackage."""
