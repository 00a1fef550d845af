"""Side files of the annotation steps: attribute CSVs, tag lists, bin JSONs, id lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annoframe.functions import vocabulary as V
from annoframe.operators.prompts import PromptParts

# Characters cut from both ends of a tag line.
LINE_BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def read_attribute_csv(
    spark: SparkSession, path: str, attribute: str, id_column: str = "segment_id", multi_line: bool = False,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """One attribute file with the columns id, ``attribute`` and ``attribute_value``.

    Columns are found by name, so a file may hold more of them or in another order;
    ``columns`` names all of them in the order of the file, which spares the look at its
    first line, and must equal it. Quotes in a quoted cell are doubled. ``multi_line``
    allows line breaks in cells; such a file cannot be split among tasks. Cells that
    spell a missing value become NULL.
    """
    reader = spark.read.option("header", True).option("mode", "FAILFAST").option("quote", '"').option("escape", '"')
    reader = reader.option("multiLine", multi_line)
    if columns is not None:
        reader = reader.option("enforceSchema", False).schema(", ".join(f"`{name}` string" for name in columns))
    cells = reader.csv(path)
    label = F.col(attribute)
    score = F.col(f"{attribute}_value")
    return cells.select(
        F.col(id_column),
        F.when(~label.isin(*V.CSV_MISSING), label).alias(attribute),
        F.when(~score.isin(*V.CSV_MISSING), score).cast("double").alias(f"{attribute}_value"),
    )


def read_tag_lines(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated ``id, tag`` lines with a sortable line position.

    A line without a tag stands for the tag "None"; fields after the second are
    ignored. The position (file, block, row within the task that reads the block)
    grows with the line number, so large files are still read in parallel.
    """
    lines = spark.read.text(path).select(
        F.split(F.trim(F.col("value"), F.lit(LINE_BLANKS)), "\t").alias("fields"),
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("position"),
    )
    return lines.select(
        F.col("fields")[0].alias("segment_id"),
        F.coalesce(F.get(F.col("fields"), F.lit(1)), F.lit(V.MISSING_LABEL)).alias("tag"),
        "position",
    )


def read_number_lists(spark: SparkSession, path: str) -> dict[str, list[float]]:
    """A JSON object of number lists, such as bin edges; a small settings file."""
    return _read_lists(spark, path, "map<string,array<double>>")


def read_word_lists(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """A JSON object of word lists, such as label vocabularies; a small settings file."""
    return _read_lists(spark, path, "map<string,array<string>>")


def _read_lists(spark: SparkSession, path: str, schema: str) -> dict:
    text = spark.read.text(path, wholetext=True)
    row = text.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("lists")).first()
    if row is None or row["lists"] is None:
        raise ValueError(f"{path} holds no JSON object")
    return row["lists"]


def read_prompt_parts(spark: SparkSession, path: str) -> PromptParts:
    """Prompt wording from a JSON object with ``front``, ``examples`` and, if they differ, ``end`` and ``keys``."""
    text = spark.read.text(path, wholetext=True)
    schema = "front string, examples array<string>, end string, keys array<string>"
    row = text.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("parts")).first()
    if row is None or row["parts"] is None or row["parts"]["front"] is None or row["parts"]["examples"] is None:
        raise ValueError(f"{path} holds no JSON object with front and examples")
    given = row["parts"]
    more = {name: given[name] for name in ("end",) if given[name] is not None}
    if given["keys"] is not None:
        more["keys"] = tuple(given["keys"])
    return PromptParts(given["front"], tuple(given["examples"]), **more)


def write_bin_edges(edges: DataFrame, path: str, overwrite: bool = False) -> None:
    """Save a one-row edge table as one JSON object, ready for ``read_number_lists``."""
    edges.coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").json(path)


def write_ids(df: DataFrame, path: str, id_column: str = "segment_id") -> None:
    """One id per line."""
    df.select(F.col(id_column).cast("string").alias("value")).write.text(path)
