"""Files to text: plain text and delimited files in the JVM, office packages through `office.extract`."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .office import EXTRACTORS, Failure, Limits, extract

MOST_NAME = 255
PLAIN = ("txt", "csv", "tsv", "md")
RESULT = "path string, text string, warnings array<string>, counts struct<slides:int,pages:int,sheets:int,hidden:int,notes:int,comments:int>, error_code string, error_category string, is_retryable boolean"


def filename_lines(pasted: Column, most: int | None = None) -> Column:
    """One `File name: "..."` line for each non-blank line; null if a name is too long, or if there are more names than `most`.

    `filename_error` tells which. Without `most`, a list has no limit.
    """
    quoted = F.transform(_names(pasted), lambda x: F.concat(F.lit("File name: "), quote(x)))
    return F.when(filename_error(pasted, most).isNull(), F.array_join(quoted, "\n"))


def filename_error(pasted: Column, most: int | None = None) -> Column:
    """Why `filename_lines` gives null: `filename_list_limit` (more names than `most`) or `filename_long`; null if it does not."""
    names = _names(pasted)
    long = F.when(F.exists(names, lambda x: F.length(x) > MOST_NAME), F.lit("filename_long"))
    return long if most is None else F.when(F.size(names) > most, F.lit("filename_list_limit")).otherwise(long)


def _names(pasted: Column) -> Column:
    return F.filter(F.transform(F.split(pasted, "\r?\n"), lambda x: F.trim(x)), lambda x: x != "")


def quote(name: Column) -> Column:
    """A name in quotes, with back-slashes and quotes escaped."""
    return F.concat(F.lit('"'), F.replace(F.replace(name, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def decode_plain(content: Column) -> Column:
    """UTF-16 by its mark, else strict UTF-8; null if the bytes are no such text. The mark is dropped."""
    mark = F.hex(F.substring(content, 1, 2))
    wide = F.when(mark == "FFFE", F.decode(F.substring(content, F.lit(3), F.length(content)), "UTF-16LE")).when(mark == "FEFF", F.decode(F.substring(content, F.lit(3), F.length(content)), "UTF-16BE"))
    return F.when(mark.isin("FFFE", "FEFF"), wide).otherwise(F.regexp_replace(F.try_validate_utf8(content.cast("string")), "^\\x{FEFF}", ""))


def read_files(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """`extract_files` of every file below a path."""
    return extract_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), limits)


def extract_files(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """files (path, length, content) -> path, text, warnings, counts and error columns; a bad file is an error row, never a failed job.

    Files above the size limit are refused by their length alone. Names go before the text.
    """
    kind = F.lower(F.element_at(F.split("path", "\\."), -1))
    files = files.withColumn("kind", kind).withColumn("content", F.when(F.col("length") <= limits.file_bytes, F.col("content")))
    plain = F.when(F.col("kind").isin(*PLAIN), decode_plain(F.col("content")))
    code = F.when(F.col("length") > limits.file_bytes, "file_large").when(~F.col("kind").isin(*PLAIN, *EXTRACTORS), "file_unsupported")
    files = files.select("path", "kind", code.alias("code"), plain.alias("plain"), F.when(F.col("kind").isin(*EXTRACTORS) & code.isNull(), F.col("content")).alias("content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for f in batch.itertuples(index=False):
                text, warnings, counts, failed = None, [], dict.fromkeys(("slides", "pages", "sheets", "hidden", "notes", "comments"), 0), f.code
                if not failed:
                    try:
                        if f.kind in PLAIN:
                            text, failed = (f.plain, None) if f.plain is not None else (None, "file_encoding")
                        else:
                            text, warnings, counts = extract(bytes(f.content), f.kind, limits)
                    except Failure as x:
                        failed = x.code
                if text is not None:
                    name = f.path.rsplit("/", 1)[-1].replace("\\", "\\\\").replace('"', '\\"')
                    text = f'File name: "{name}"\n\n{text}'
                    if len(text) > limits.text_chars:
                        text, failed = None, "text_large"
                rows.append((f.path, text, warnings, counts, failed, "validation" if failed else None, False if failed else None))
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in ("path", "text", "warnings", "counts", "error_code", "error_category", "is_retryable")])

    return files.mapInPandas(run, RESULT)
