"""Storage-layout analytics on Spark: byte-range algebra, disk and image decoding, and worker streams as DataFrames."""
