"""Files: existence rules, byte ranges, whole contents, and their metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How an existing target is treated, as Spark's save modes.
IF_EXISTS = {"overwrite": "overwrite", "keep": "ignore", "fail": "error", "append": "append"}


def _path(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write(df: DataFrame, path: str, if_exists: str = "fail") -> None:
    df.write.mode(IF_EXISTS[if_exists]).parquet(path)


def write_bytes(spark: SparkSession, path: str, data: bytes, if_exists: str = "fail") -> None:
    """One file of these bytes; ``append`` writes the old content and the new to another file, which then takes the place of the first."""
    where, fs = _path(spark, path)
    there = fs.exists(where)
    if there and if_exists == "fail":
        raise FileExistsError(path)
    if there and if_exists == "keep":
        return
    if there and if_exists == "append":
        data = bytes(read_bytes(spark, path).first()["bytes"]) + data
    part, _ = _path(spark, f"{path}.part")
    out = fs.create(part, True)
    out.write(bytearray(data))
    out.close()
    if there:
        fs.delete(where, False)
    if not fs.rename(part, where):
        raise OSError(f"{path} can't be written")


def write_text(spark: SparkSession, path: str, text: str, if_exists: str = "fail", charset: str = "UTF-8") -> None:
    write_bytes(spark, path, text.encode(charset), if_exists)


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _path(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str, must_exist: bool = False) -> bool:
    """Whether something was deleted; a missing path is an error only if it must exist."""
    where, fs = _path(spark, path)
    if not fs.exists(where):
        if must_exist:
            raise FileNotFoundError(path)
        return False
    return fs.delete(where, True)


def read_bytes(spark: SparkSession, path: str, offset: int = 0, count: int | None = None) -> DataFrame:
    """``path, bytes`` of whole files, or of a range; a range that starts beyond a file's end is an error."""
    content = F.col("content")
    part = content if count is None and not offset else F.substring(content, F.lit(offset + 1), F.lit(2**31 - 1 if count is None else count))
    checked = F.when(F.col("length") < offset, F.raise_error(F.lit("offset beyond the end of the file")).cast("binary")).otherwise(part)
    return spark.read.format("binaryFile").load(path).select("path", checked.alias("bytes"))


def read_text(spark: SparkSession, path: str, charset: str = "UTF-8") -> DataFrame:
    return read_bytes(spark, path).select("path", F.decode("bytes", charset).alias("text"))


def file_info(df: DataFrame) -> DataFrame:
    """Name, place, size and time of the files that ``df`` reads."""
    return df.select("_metadata.file_name", "_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
