"""Training-data operators: text and vector work for corpora on Spark."""
