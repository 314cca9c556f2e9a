"""Multi-model analytics on PySpark: documents, graphs, full text and vectors as DataFrame operators."""
