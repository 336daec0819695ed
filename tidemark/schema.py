"""The change log: one row per operation, (key, seq, op, value)."""

from pyspark.sql import types as T

PUT, DELETE = 1, 2

#: keys are raw bytes; text keys order the same way under the default collation
LOG_SCHEMA = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("op", T.IntegerType(), False),
        T.StructField("value", T.BinaryType(), True),
    ]
)
