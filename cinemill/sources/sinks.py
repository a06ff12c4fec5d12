"""Writers of reports, logs and exports, and their readers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table_text(df: DataFrame, rows: int) -> str:
    """The first rows in columns of even width, and how many more there are."""
    shown = [[("NULL" if x is None else str(x)) for x in r] for r in df.limit(rows).collect()]
    left = df.count() - len(shown) if len(shown) == rows else 0
    widths = [max(len(c), *(len(r[i]) for r in shown)) if shown else len(c) for i, c in enumerate(df.columns)]
    line = lambda cells: " | ".join(c.ljust(w) for c, w in zip(cells, widths)).rstrip()
    return "\n".join([line(df.columns), "-+-".join("-" * w for w in widths), *map(line, shown), *([f"({left} more)"] if left else [])])


def report(df: DataFrame, form: str, at: str | None = None, rows: int = 1000):
    """A report as table text (of so many rows, with the number of those left out), JSON lines or CSV files; plain is one tab-separated column of the rows."""
    if form == "table":
        return table_text(df, rows)
    if form == "plain":
        text = df.select(F.concat_ws("\t", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns)).alias("value"))
        return text.write.mode("overwrite").text(at)
    if form == "json":
        return df.write.mode("overwrite").option("ignoreNullFields", "false").json(at)
    if form == "csv":
        return df.write.mode("overwrite").csv(at, header=True)
    raise ValueError(f"no such form: {form}")


def sections(frames: dict[str, DataFrame], wanted: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The report sections asked for; none asks for all, an unknown one is an error."""
    if unknown := set(wanted) - set(frames):
        raise ValueError("no such section: " + ", ".join(sorted(unknown)))
    return {k: v for k, v in frames.items() if not wanted or k in wanted}


def append_lines(df: DataFrame, at: str) -> None:
    """Append rows as JSON lines."""
    df.write.mode("append").json(at)


def read_lines(spark: SparkSession, at: str, schema: str, destination: str | None = None) -> DataFrame:
    """Rows of a JSON-lines log, of one destination if given; the schema is never inferred."""
    df = spark.read.schema(schema).json(at)
    return df if destination is None else df.where(F.col("destination") == destination)


def json_rows(df: DataFrame) -> Iterator[str]:
    """Rows as JSON texts, fetched a partition at a time."""
    for row in df.select(F.to_json(F.struct(*df.columns)).alias("j")).toLocalIterator():
        yield row["j"]


def export_tsv(df: DataFrame, at: str) -> None:
    df.write.mode("overwrite").csv(at, sep="\t", header=True, nullValue="")


def storage_stats(df: DataFrame) -> DataFrame:
    """(files, bytes) of the files that a table's rows lie in."""
    sized = df.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b")).distinct()
    return sized.agg(F.count(F.lit(1)).alias("files"), F.sum("b").alias("bytes"))


def compacted(df: DataFrame, at: str, rows_per_file: int = 1_000_000) -> None:
    """Rewrite a table into fewer files."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(at)
