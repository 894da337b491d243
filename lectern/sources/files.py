"""Text files by name, each from many rows: written line by line, never as one value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_files(lines: DataFrame, root: str, order: list[str], name: str = "file", line: str = "line", parts: int | None = None) -> None:
    """A folder `file=<name>` for each name, with one file that holds its lines in order.

    lines: name, the columns of order, and line. A name's lines go to one task, which sorts (on disk, if they are many) and streams
    them; a file is one task's work, but no text is ever collected. Running it again gives the same bytes.
    """
    parts = parts or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = lines.repartition(parts, name).sortWithinPartitions(name, *order)
    rows.select(F.col(name).alias("file"), F.col(line).alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 0).partitionBy("file").text(root)


def write_many(lines: DataFrame, root: str, order: list[str], name: str = "file", line: str = "line") -> None:
    """The same lines where names are many: a table of file, the columns of order, and line, with a name's lines in order in one file.

    A file of the table holds many names, so that the number of files follows the lines and not the names.
    """
    rows = lines.repartition(name).sortWithinPartitions(name, *order)
    rows.select(F.col(name).alias("file"), *order, F.col(line).alias("line")).write.mode("overwrite").parquet(root)
