"""The schemas of the tables that the engine reads and writes."""

from pyspark.sql import types as T

CORPUS = T.StructType().add("path", T.StringType()).add("content", T.BinaryType()).add("size", T.LongType()).add("mtime", T.LongType())
#: flags: SCAN_ALWAYS for texts over the size cap, BINARY for what is never searched.
FILES = T.StructType().add("file_id", T.LongType()).add("path", T.StringType()).add("size", T.LongType()).add("mtime", T.LongType()).add("flags", T.IntegerType())
TEXTS = T.StructType(list(FILES.fields)).add("content", T.BinaryType())
POSTINGS = T.StructType().add("tri", T.IntegerType()).add("file_id", T.LongType())
SPANS = "array<struct<start:int,end:int>>"
SCAN_ALWAYS, BINARY = 1, 2
FORMAT_VERSION = 2
