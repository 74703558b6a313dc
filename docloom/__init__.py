"""docloom: dataflow operators for large document corpora on Spark."""
