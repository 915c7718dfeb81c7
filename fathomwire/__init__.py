"""Wire records on Spark: schemas, codecs, framed sources and sinks, as DataFrame operators."""
