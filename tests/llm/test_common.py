import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from supportgraph.llm.common import BATCH_BYTES, bound_batches, crc32, texts


def test_texts_are_bytes_and_null_is_empty():
    column = pa.array(["é", None, ""] * 200)
    assert list(texts(column)) == ["é".encode(), b"", b""] * 200
    assert list(texts(column.slice(1, 2))) == [b"", b""]


def test_crc32_is_that_of_the_decimal_text(spark):
    df = spark.createDataFrame([(17,), (None,)], "i long").select(crc32(F.col("i")).alias("c"))
    assert [r.c for r in df.collect()] == [zlib.crc32(b"17"), None]


def test_batches_are_bounded_unless_the_session_says_otherwise(spark):
    spark.conf.unset(BATCH_BYTES)
    bound_batches(spark)
    assert spark.conf.get(BATCH_BYTES) == "4m"
    spark.conf.set(BATCH_BYTES, "9m")
    bound_batches(spark)
    assert spark.conf.get(BATCH_BYTES) == "9m"
    spark.conf.unset(BATCH_BYTES)
