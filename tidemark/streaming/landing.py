"""Documents that land as files, taken in once: a read-through cache over any store.

The stream's log knows which files it has seen, so a second run lists the folder and reads only new files. Each is checked;
what is no document goes to quarantine with the reason. Both tables are appended by key, so a batch that died after it
wrote is written again without a second row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import sinks
from tidemark.sources import gazette

FILES = "path string, modificationTime timestamp, length long, content binary"
#: XML's white space; without it named, Spark's trims take spaces alone.
_BLANKS = " \t\r\n"


def checked(files: DataFrame) -> DataFrame:
    """(file, landed_at, id, xml, reason) of files (path, modificationTime, content): ``reason`` is null where the file is a document."""
    text = F.expr("try_validate_utf8(cast(content as string))")
    told = files.select(F.col("path").alias("file"), F.col("modificationTime").alias("landed_at"), text.alias("xml"))
    # what does not end as it began was cut off, or is another page
    root = F.regexp_extract("xml", r"<(?!\?|!)([A-Za-z_][\w.:-]*)", 1)
    whole = (root != "") & F.rtrim("xml", F.lit(_BLANKS)).endswith(F.concat(F.lit("</"), root, F.lit(">")))
    id_ = F.nullif(F.regexp_extract("xml", r"<id>\s*([^<\s]+)\s*</id>", 1), F.lit(""))
    reason = F.when(F.col("xml").isNull(), "not UTF-8").when(F.trim("xml", F.lit(_BLANKS)) == "", "empty").when(~whole, "not a whole document").when(~F.col("xml").rlike(r"<(?:\w+:)?publicationText|<(?:\w+:)?meta>"), "not a publication").when(id_.isNull(), "no id")
    return told.select("file", "landed_at", F.when(reason.isNull(), id_).alias("id"), "xml", reason.alias("reason"))


def take_in(spark: SparkSession, source: str, path: str, files_per_batch: int = 10_000) -> int:
    """Takes in what has landed below ``source`` since the last run; returns the number of files read.

    ``path/documents`` has (file, landed_at, id, xml), one row for each id, the first one that came; ``path/quarantine`` has
    (file, landed_at, reason); ``path/checkpoint`` is the stream's own.
    """
    stream = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.xml").option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(source)

    read = []

    def write(batch: DataFrame, _: int) -> None:
        rows = checked(batch).persist()  # a file is read once for both tables
        try:
            read.append(rows.count())
            sinks.insert_absent(rows.where("reason is null").select("file", "landed_at", "id", "xml"), f"{path}/documents", "id")
            sinks.insert_absent(rows.where("reason is not null").select("file", "landed_at", "reason"), f"{path}/quarantine", "file")
        finally:
            rows.unpersist()

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(read)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, landed_at, id, xml) of what has been taken in."""
    return spark.read.schema("file string, landed_at timestamp, id string, xml string").parquet(f"{path}/documents")


def published(spark: SparkSession, path: str) -> DataFrame:
    """The taken-in documents as publications, with their XML."""
    docs = documents(spark, path).select("xml")
    return gazette.publications(docs)
