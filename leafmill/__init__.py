"""Document analytics on Spark: ordered tables of lines, boxes and documents."""
