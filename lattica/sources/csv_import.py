"""CSV import: names, a profile of all columns in one pass, type promotion, and columns that tables share."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions.paths import label
from lattica.tables import written

INTEGER = r"^\s*[+-]?\d+\s*$"
FLOAT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
US_DATE = r"^\d{1,2}/\d{1,2}/\d{4}$"

#: What stands within quotes, and whole fields with the comma after them; possessive, so a line is read once.
QUOTED = r'[^"]*+(?:""[^"]*+)*+'
FIELDS = rf'(?:(?:"{QUOTED}"[^,]*+|[^",][^,]*+|),)*+'
#: Lines that end within quotes if they start outside of them, and if they start within.
OPENING = re.compile(rf'{FIELDS}"{QUOTED}')
STAYING = re.compile(rf'{QUOTED}(?:"[^,]*+,{FIELDS}"{QUOTED})?')


def snake_case(name: str) -> str:
    """CamelCase to snake_case; a run of capitals is one word, whose last letter begins the next before a small one."""
    name = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    name = re.sub(r"([A-Z]{2,})([A-Z][a-z])", r"\1_\2", name)
    return re.sub(r"^([A-Z])([A-Z][a-z])", r"\1_\2", name).lower()


def table_name(file_name: str) -> str:
    return snake_case(re.sub(r"\.csv$", "", file_name.rsplit("/", 1)[-1], flags=re.I))


def column_name(header: str) -> str:
    name = re.sub(r"[^a-z0-9_]", "_", header.strip().lower())
    return "col" if not name else ("_" + name if name[0].isdigit() else name)


def unique_names(names: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for name in names:
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


CSV_OPTIONS = {"inferSchema": False, "mode": "PERMISSIVE", "escape": '"'}


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A CSV file, or a folder of files of one header, as text columns with clean, unique names; empty values are null.

    Short rows are filled with nulls, what long ones have beyond the header is dropped. ``multi_line`` allows line ends
    within quotes; files that Spark would cut into several parts are then read in parts, too: by Spark itself if they
    hold no quote at all, so every line is a record, else by ``read_parts``.
    """
    header = spark.read.csv(path, header=False, multiLine=multi_line, **CSV_OPTIONS).first()
    if header is None:
        return spark.createDataFrame([], "col string").limit(0)
    names = unique_names([column_name(h or "") for h in header])
    if multi_line:
        sizes = spark.read.format("binaryFile").load(path).agg(F.max("length").alias("largest"))
        part = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
        if sizes.first()["largest"] > part:
            if not _lines_are_records(spark, path):
                return read_parts(spark, path, names)
            multi_line = False
    schema = ", ".join(f"`{name}` string" for name in names)
    return spark.read.schema(schema).csv(path, header=True, nullValue="", enforceSchema=True, multiLine=multi_line, **CSV_OPTIONS)


def _lines_are_records(spark: SparkSession, path: str) -> bool:
    """Whether every line that isn't empty is a record, in any reader: no quotes, no blank lines, \\r at most at the end."""
    odd = F.col("value").contains('"') | F.col("value").rlike(r"\r(?!\z)") | F.col("value").rlike(r"\A(?!\r\z)[\x00-\x20]+\z")
    return not spark.read.text(path, lineSep="\n").filter(odd).limit(1).count()


LINES = "file string, part long, line long, text string, " + ", ".join(f"before{k} int, after{k} int, ended{k} long" for k in (0, 1))


def _stepped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines (file, part, text) in the order of the file, with what holds before and after them if their part starts
    outside (0) or within quotes (1): whether that is within quotes, and how many records of the part have ended."""
    at, states, ended, line = None, [0, 1], [0, 0], 0
    for batch in batches:
        if batch.empty:
            continue
        key = (batch["file"] != batch["file"].shift()) | (batch["part"] != batch["part"].shift())
        for _, rows in batch.groupby(key.cumsum(), sort=False):
            here = (rows["file"].iloc[0], rows["part"].iloc[0])
            if here != at:
                at, states, ended, line = here, [0, 1], [0, 0], 0
            texts = rows["text"].to_numpy()
            quoted = np.flatnonzero(rows["text"].str.contains('"', regex=False))
            moves = [[int((STAYING if s else OPENING).fullmatch(texts[i]) is not None) for i in quoted] for s in (0, 1)]
            blank = np.isin(texts, ["", "\r"])
            out = {"file": rows["file"], "part": rows["part"], "line": line + np.arange(len(rows)), "text": rows["text"]}
            for k in (0, 1):
                changes, state = np.empty(len(quoted) + 1, dtype=np.int32), states[k]
                changes[0] = state
                for n in range(len(quoted)):
                    state = moves[state][n]
                    changes[n + 1] = state
                passed = np.zeros(len(rows), dtype=np.int64)
                passed[quoted] = 1
                passed = passed.cumsum()
                after = changes[passed]
                before = np.concatenate([[states[k]], after[:-1]]).astype(np.int32)
                ends = ((after == 0) & ~((before == 0) & blank)).astype(np.int64)
                out |= {f"before{k}": before, f"after{k}": after, f"ended{k}": ended[k] + ends.cumsum() - ends}
                states[k], ended[k] = state, ended[k] + int(ends.sum())
            line += len(rows)
            yield pd.DataFrame(out)


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, text) of the records of CSV files, from 0 in each; line ends within quotes belong to the record.

    A file is read in parts by many tasks. Whether a part starts within quotes follows from those before it: a line takes
    each of the two states to one, and so do the lines of a part, in order. Each line is written once with what
    holds for either start; a row per part then tells which start is true. Lines that are a record of their own stay where
    they are, and only the others are grouped, so a record lies in one row (a quote that is never closed takes the rest
    of its file, as it does in any reader). Lines end in \\n or \\r\\n; empty lines outside of quotes are no records. A
    quote counts where it opens a field, so ``5" pipe`` opens nothing.
    """
    source = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part")
    raw = spark.read.text(path, lineSep="\n").select(*source, F.col("value").alias("text"))
    lines = written(raw.mapInPandas(_stepped, LINES), "csv-lines")
    own = lines.groupBy("file", "part").agg(*[
        column for k in (0, 1) for column in (
            F.max_by(f"after{k}", "line").alias(f"after{k}"),
            F.sum(F.when((F.col(f"after{k}") == 0) & ~((F.col(f"before{k}") == 0) & F.col("text").isin("", "\r")), 1).otherwise(0)).alias(f"ended{k}"),
        )
    ])
    # A part that ends alike whatever it starts with fixes the state; after it, each part that turns the state counts.
    order = Window.partitionBy("file").orderBy("part")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    turned = F.count_if(F.col("after0") > F.col("after1")).over(order)
    fixed = F.when(F.col("after0") == F.col("after1"), F.struct(F.col("after0").alias("state"), F.col("turned")))
    starts = own.withColumn("turned", turned).withColumn("fixed", F.last(fixed, ignorenulls=True).over(earlier))
    turns = F.coalesce(F.lag("turned").over(order), F.lit(0)) - F.coalesce(F.col("fixed.turned"), F.lit(0))
    starts = starts.withColumn("start", (F.coalesce(F.col("fixed.state"), F.lit(0)) + turns) % 2)
    ended = F.when(F.col("start") == 0, F.col("ended0")).otherwise(F.col("ended1"))
    starts = starts.select("file", "part", "start", F.coalesce(F.sum(ended).over(earlier), F.lit(0)).alias("base"))
    starts = written(starts, "csv-parts")
    pick = lambda name: F.when(F.col("start") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1")).alias(name)
    placed = lines.join(starts, ["file", "part"]).select("file", "part", "line", "text", "base", pick("before"), pick("after"), pick("ended"))
    placed = placed.withColumn("record", F.col("base") + F.col("ended"))
    alone = (F.col("before") == 0) & (F.col("after") == 0)
    whole = placed.filter(alone & ~F.col("text").isin("", "\r")).select("file", "record", "text")
    pieces = F.sort_array(F.collect_list(F.struct("part", "line", "text")))
    joined = placed.filter(~alone).groupBy("file", "record").agg(F.array_join(F.transform(pieces, lambda p: p["text"]), "\n").alias("text"))
    return whole.unionByName(joined).withColumn("text", F.regexp_replace("text", r"\r\z", ""))


def read_parts(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The rows of CSV files with a header as text columns ``names``, from :func:`csv_records`."""
    schema = ", ".join(f"`{name}` string" for name in names)
    options = {"mode": "PERMISSIVE", "escape": '"', "multiLine": "true", "nullValue": ""}
    rows = csv_records(spark, path).filter("record > 0")
    return rows.select(F.from_csv("text", schema, options).alias("row")).select("row.*")


def profile(table: DataFrame) -> DataFrame:
    """A row per column: counts of values and of each type, distinct values, smallest and largest as text.

    Values are counted by (column, value), which combines on the map side, and what remains by column; so a value is
    tested once, however often it occurs, and the rows are read once for all columns.
    """
    name = lambda c: F.lit(c).alias("column")
    cells = F.array(*[F.struct(name(c), F.col(f"`{c}`").alias("value")) for c in table.columns])
    counted = table.select(F.explode(cells).alias("c")).groupBy("c.column", "c.value").agg(F.count("*").alias("n"))
    names = F.explode(F.array(*[F.lit(c) for c in table.columns])).alias("column")
    none = table.sparkSession.range(1).select(names, F.lit(None).cast("string").alias("value"), F.lit(0).cast("long").alias("n"))
    value = F.col("value")

    def number(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long")

    rows = counted.unionByName(none).groupBy("column").agg(
        F.sum("n").cast("long").alias("rows"), number(value.isNotNull()).alias("filled"), number(value == "").alias("empty"),
        F.count("value").alias("distinct"), F.min("value").alias("min"), F.max("value").alias("max"),
        number(value.rlike(INTEGER)).alias("integers"), number(value.rlike(FLOAT)).alias("floats"),
        number(value.rlike(ISO_DATE) | value.rlike(US_DATE)).alias("dates"),
    )
    nil = F.col("rows") - F.col("filled")
    promoted = (
        F.when(F.col("integers") > 0, "BIGINT").when(F.col("floats") > 0, "DOUBLE").when(F.col("dates") > 0, "DATE")
    )
    fitting = F.when(F.col("integers") > 0, F.col("integers")).when(F.col("floats") > 0, F.col("floats")).otherwise(F.col("dates"))
    rated = nil / F.greatest(nil + F.col("empty") + F.col("distinct"), F.lit(1))
    return rows.select(
        "column", "rows", nil.alias("nil_count"), "empty", "distinct", "min", "max",
        F.coalesce(promoted, F.lit("TEXT")).alias("type"),
        (promoted.isNotNull() & (fitting < F.col("filled"))).alias("partial"),
        rated.alias("nil_rate"), (nil / F.greatest("rows", F.lit(1))).alias("nil_share"),
    )


def _promoted(value: Column, kind: str) -> Column:
    if kind == "BIGINT":
        return F.when(value.rlike(INTEGER), F.trim(value).try_cast("bigint"))
    if kind == "DOUBLE":
        return F.when(value.rlike(FLOAT), F.trim(value).try_cast("double"))
    iso, us = F.try_to_date(value, "yyyy-MM-dd"), F.try_to_date(value, "M/d/yyyy")
    return F.when(value.rlike(ISO_DATE), iso).when(value.rlike(US_DATE), us)


def promote(table: DataFrame, columns: list[tuple[str, str, bool]]) -> DataFrame:
    """``table`` with the types that a profile found: (column, type, partial) of every column, in one projection.

    Values that don't fit become null; a partial column keeps its text beside it as ``<column>_raw``.
    """
    out = []
    for name, kind, partial in columns:
        value = F.col(f"`{name}`")
        out.append(value.alias(name) if kind == "TEXT" else _promoted(value, kind).alias(name))
        if partial:
            out.append(value.alias(f"{name}_raw"))
    return table.select(*out)


def import_table(table: DataFrame) -> DataFrame:
    """Profile and promote: two passes over the table. The profile has a row per column."""
    found = profile(table).select("column", "type", "partial").collect()
    by_name = {row["column"]: (row["column"], row["type"], row["partial"]) for row in found}
    return promote(table, [by_name[name] for name in table.columns])


def shared_columns(spark: SparkSession, tables: dict[str, list[str]]) -> DataFrame:
    """(left_table, right_table, column) for columns of equal names in two tables, in the order of ``tables``."""
    rows = [(k, name, column) for k, (name, columns) in enumerate(tables.items()) for column in columns]
    named = spark.createDataFrame(rows, "idx int, table string, column string")
    left = named.select(F.col("idx").alias("i"), F.col("table").alias("left_table"), "column")
    right = named.select(F.col("idx").alias("j"), F.col("table").alias("right_table"), "column")
    return left.join(right, "column").filter("i < j").select("left_table", "right_table", "column")


@dataclass
class Dataset:
    """An imported directory: typed tables by name, a node per dataset, table and column, and the shared_column edges."""

    tables: dict[str, DataFrame]
    nodes: DataFrame
    edges: DataFrame


def csv_files(spark: SparkSession, folder: str) -> list[str]:
    """The CSV files of a folder by name; only their paths are read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.[cC][sS][vV]").load(folder)
    return sorted(row["path"] for row in found.select("path").collect())


def import_directory(spark: SparkSession, folder: str, project: str, multi_line: bool = True) -> Dataset:
    """Import every CSV file of a folder: profile it, promote its columns, and describe it in nodes.

    A file is read twice, once for its profile and once when its typed table is read. Nodes are (id, kind, content,
    parent_id, position, path, metadata); ids are paths of project, table and column. The driver holds names alone.
    """
    tables, profiles, listed = {}, None, {}
    paths = csv_files(spark, folder)
    names = unique_names([table_name(path) for path in paths])
    for place, (path, name) in enumerate(zip(paths, names, strict=True)):
        raw = read_csv(spark, path, multi_line)
        found = written(profile(raw), "csv-profile")
        kinds = {row["column"]: (row["column"], row["type"], row["partial"]) for row in found.select("column", "type", "partial").collect()}
        tables[name] = promote(raw, [kinds[c] for c in raw.columns])
        listed[name] = raw.columns
        at = F.array_position(F.array(*[F.lit(c) for c in raw.columns]), F.col("column")) - 1
        own = found.select(
            F.lit(name).alias("table"), F.lit(place).alias("place"), F.lit(path.rsplit("/", 1)[-1]).alias("source_file"),
            at.cast("int").alias("at"), *found.columns,
        )
        profiles = own if profiles is None else profiles.unionByName(own)
    root = label(project)
    if profiles is None:
        empty = "id string, kind string, content string, parent_id string, position int, path string, metadata string"
        none = spark.createDataFrame([], empty)
        return Dataset({}, none, spark.createDataFrame([], "source_id string, target_id string, relation string"))
    profiles = written(profiles, "csv-profiles")
    nothing = F.lit(None).cast("string")
    by_table = profiles.groupBy("table", "place", "source_file").agg(
        F.max("rows").alias("row_count"), F.count("*").alias("column_count"), F.sum("nil_count").alias("nil_total")
    )
    counts = F.struct(F.count("*").alias("table_count"), F.sum("row_count").alias("total_rows"), F.sum("column_count").alias("total_columns"))
    dataset = by_table.agg(F.to_json(counts).alias("metadata")).select(
        F.lit(root).alias("id"), F.lit("csv_dataset").alias("kind"), F.lit(project).alias("content"), nothing.alias("parent_id"),
        F.lit(0).alias("position"), F.lit(root).alias("path"), "metadata",
    )
    table_path = F.concat_ws(".", F.lit(root), F.col("table"))
    described = by_table.select(
        table_path.alias("id"), F.lit("csv_table").alias("kind"), F.col("table").alias("content"), F.lit(root).alias("parent_id"),
        F.col("place").alias("position"), table_path.alias("path"),
        F.to_json(F.struct("source_file", "row_count", "column_count", "nil_total")).alias("metadata"),
    )
    column_path = F.concat_ws(".", table_path, F.col("column"))
    columns = profiles.select(
        column_path.alias("id"), F.lit("csv_column").alias("kind"), F.col("column").alias("content"), table_path.alias("parent_id"),
        F.col("at").alias("position"), column_path.alias("path"),
        F.to_json(F.struct("type", "partial", "rows", "nil_count", "empty", "distinct", "min", "max", "nil_rate")).alias("metadata"),
    )
    shared = shared_columns(spark, listed)
    end = lambda side: F.concat_ws(".", F.lit(root), F.col(f"{side}_table"), F.col("column"))
    edges = shared.select(end("left").alias("source_id"), end("right").alias("target_id"), F.lit("shared_column").alias("relation"))
    return Dataset(tables, dataset.unionByName(described).unionByName(columns), edges)
