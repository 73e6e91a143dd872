"""Readers with provenance (file and ordinal of every row) and plain writers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATORS = [";", ",", "\t", "|"]


def _base_name(path: Column) -> Column:
    """File name of a URI, with its escapes undone."""
    return F.url_decode(F.regexp_extract(path, "([^/]+)$", 1))


def sniff_separator(header: str) -> str:
    """The separator that cuts a header into most fields; ties go to the first of `;`, `,`, tab, `|`."""
    return max(SEPARATORS, key=lambda s: (len(header.split(s)), -SEPARATORS.index(s)))


#: Stands for a separator inside quotes while a row is cut: a code point that is no character.
_HELD = "\uffff"


def _fields(row: Column, sep: str) -> Column:
    """The fields of a CSV row: a quote opens and closes wherever it stands, two inside quotes are one.

    Cut at the quotes, every second piece lies inside; an empty piece between two
    of those is a doubled quote.
    """
    pieces = F.split(row, '"', -1)

    def piece(x: Column, i: Column) -> Column:
        return F.when(i % 2 == 1, F.replace(x, F.lit(sep), F.lit(_HELD))).when((x == "") & (i > 0) & (i < F.size(pieces) - 1), '"').otherwise(x)

    cut = F.split(F.array_join(F.transform(pieces, piece), ""), re.escape(sep), -1)
    return F.when(F.contains(row, F.lit('"')), F.transform(cut, lambda x: F.replace(x, F.lit(_HELD), F.lit(sep)))).otherwise(F.split(row, re.escape(sep), -1))


def _csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """(_path, _row, value): the rows of CSV files, numbered from 1 (the header) in each file; empty lines between rows do not count.

    A file is read by splits.  Whether a line begins inside quotes is the parity
    of the quotes before it: a running sum over the lines of its split, and over
    the sums of the splits before it.  Only rows that span lines are put together
    from them; all others stay as they were read.
    """
    at = ["_path", "_start"]
    lines = spark.read.option("lineSep", "\n").text(path).select(F.replace("value", F.lit("\r"), F.lit("")).alias("value"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    lines = lines.withColumn("_quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    in_split = Window.partitionBy(*at).orderBy("_id")
    lines = lines.withColumn("_odd", (F.coalesce(F.sum("_quotes").over(in_split.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2).cast("int"))
    # of either parity at a split's start: how many rows begin in it
    begins = lambda parity: F.count_if((F.col("_odd") == parity) & (F.col("value") != ""))
    splits = lines.groupBy(*at).agg(F.sum("_quotes").alias("q"), begins(0).alias("n0"), begins(1).alias("n1"))
    before = Window.partitionBy("_path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_turned", (F.coalesce(F.sum("q").over(before), F.lit(0)) % 2).cast("int"))
    splits = splits.withColumn("_before", F.coalesce(F.sum(F.when(F.col("_turned") == 0, F.col("n0")).otherwise(F.col("n1"))).over(before), F.lit(0)))
    known = lines.join(splits.select(*at, "_turned", "_before"), at).withColumn("_inside", F.col("_odd") != F.col("_turned"))
    known = known.filter("_inside or value <> ''").withColumn("_row", F.col("_before") + F.sum(F.when(F.col("_inside"), 0).otherwise(1)).over(in_split))
    whole = ~F.col("_inside") & (F.col("_quotes") % 2 == 0)
    spread = known.filter(~whole).groupBy("_path", "_row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_start", "_id", "value"))), lambda x: x["value"]), "\n").alias("value"))
    return known.filter(whole).select("_path", "_row", "value").unionByName(spread)


def read_csv(spark: SparkSession, path: str, sep: str = ";", trim: bool = False) -> DataFrame:
    """All columns as text ('' where empty), `_file`, and `_linha`, the row's ordinal plus one.

    Quoted fields may hold line breaks; even so many tasks read one file, by its
    splits.  Rows of less than two fields are left out (not of files of one column).
    """
    names = spark.read.option("sep", sep).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("inferSchema", False).csv(path).columns  # reads the first row
    rows = _csv_rows(spark, path).filter("_row > 1").withColumn("_f", _fields(F.col("value"), sep))
    if len(names) > 1:
        rows = rows.filter(F.size("_f") > 1)
    clean = (lambda c: F.trim(c)) if trim else (lambda c: c)
    cells = [clean(F.coalesce(F.get("_f", F.lit(i)), F.lit(""))).alias(c.strip() if trim else c) for i, c in enumerate(names)]
    return rows.select(*cells, _base_name(F.col("_path")).alias("_file"), F.col("_row").cast("long").alias("_linha"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """`value`, `_file` and `_linha` (from 1) of all lines that are not empty."""
    rows = spark.read.text(path).filter("value <> ''").select("value", F.col("_metadata.file_path").alias("_path"), F.monotonically_increasing_id().alias("_id"))
    # a split of a file is one task, so ids only need the splits' counts before them
    split = F.shiftright("_id", 33)
    counts = rows.groupBy("_path", split.alias("_split")).agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("_path").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.withColumn("_split", split).join(before, ["_path", "_split"]).select("value", _base_name(F.col("_path")).alias("_file"), (F.col("_id") - F.col("_first") + F.col("_before") + 1).cast("long").alias("_linha"))


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A row per line that is not empty, with `_file` and `_linha`."""
    return read_lines(spark, path).select(F.from_json("value", schema).alias("o"), "_file", "_linha").select("o.*", "_file", "_linha")


def infer_json(spark: SparkSession, path: str) -> T.StructType:
    return spark.read.option("primitivesAsString", True).option("multiLine", path.endswith(".json")).json(path).schema


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """`arquivo` and whole `texto` of every text file."""
    return spark.read.text(path, wholetext=True).select(_base_name(F.col("_metadata.file_path")).alias("arquivo"), F.col("value").alias("texto"))


def flatten(df: DataFrame) -> DataFrame:
    """Nested fields under dotted names; arrays joined by ' | '; null as ''."""

    def leaves(kind: T.DataType, at: Column, name: str) -> list[Column]:
        if isinstance(kind, T.StructType):
            return [c for f in kind.fields for c in leaves(f.dataType, at[f.name], f"{name}.{f.name}" if name else f.name)]
        if isinstance(kind, T.ArrayType):
            items = F.transform(at, lambda x: F.coalesce((F.to_json(x) if isinstance(kind.elementType, (T.StructType, T.ArrayType)) else x.cast("string")), F.lit("")))
            return [F.coalesce(F.array_join(items, " | "), F.lit("")).alias(name)]
        return [F.coalesce(at.cast("string"), F.lit("")).alias(name)]

    return df.select(*[c for f in df.schema.fields for c in leaves(f.dataType, F.col(f"`{f.name}`"), f.name)])


def _list(spark: SparkSession, folder: str) -> list[tuple[str, bool]]:
    """Names in a folder of any Hadoop file system, sorted, and whether they are folders."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted((s.getPath().getName(), s.isDirectory()) for s in fs.listStatus(path))


def read_source(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """('tabela' or 'documentos', rows) of a csv, tsv, jsonl, ndjson, json or text file."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("csv", "tsv"):
        header = spark.read.text(path).first()
        return "tabela", read_csv(spark, path, sniff_separator(header.value if header else ""), trim=True)
    if kind in ("jsonl", "ndjson"):
        rows = read_jsonl(spark, path, infer_json(spark, path))
        return "tabela", flatten(rows.drop("_file")).withColumn("_linha", F.col("_linha").cast("long"))
    if kind == "json":
        whole = spark.read.option("primitivesAsString", True).option("multiLine", True).json(path)
        lists = [f.name for f in whole.schema.fields if isinstance(f.dataType, T.ArrayType)]
        if lists:
            # an object: its first array in the order of the text; only the places come to the driver
            text = spark.read.text(path, wholetext=True)
            places = text.select(*[F.regexp_instr("value", F.lit(rf'"{re.escape(n)}"\s*:\s*\[')).alias(str(i)) for i, n in enumerate(lists)]).first()
            first = min(zip(places, lists, strict=True), key=lambda x: x[0] or float("inf"))[1]
            whole = whole.select(F.posexplode(f"`{first}`").alias("_pos", "_o"))
            rows = whole.select("_o.*", "_pos") if isinstance(whole.schema["_o"].dataType, T.StructType) else whole.select(F.col("_o").alias("valor"), "_pos")
            return "tabela", flatten(rows.withColumn("_linha", F.col("_pos") + 1).drop("_pos")).withColumn("_linha", F.col("_linha").cast("long"))
        ids = whole.withColumn("_linha", F.monotonically_increasing_id() + 1)  # a json file is one task
        return "tabela", flatten(ids).withColumn("_linha", F.col("_linha").cast("long"))
    return "documentos", read_texts(spark, path)


def read_folder(spark: SparkSession, folder: str) -> dict[str, tuple[str, DataFrame]]:
    """Every source of a folder by name; a folder of txt or md files is one source; names with 'gabarito' are left out."""
    out: dict[str, tuple[str, DataFrame]] = {}
    for name, is_folder in _list(spark, folder):
        path = f"{folder.rstrip('/')}/{name}"
        if is_folder:
            if texts := [n for n, sub in _list(spark, path) if not sub and re.search(r"\.(txt|md)$", n, re.I)]:
                out[f"{name}/"] = ("documentos", read_texts(spark, [f"{path}/{n}" for n in texts]))
        elif re.search(r"\.(csv|tsv|jsonl|ndjson|json|txt|md)$", name, re.I) and not re.search("gabarito", name, re.I):
            out[name] = read_source(spark, path)
    return out


def write_csv(df: DataFrame, path: str, sep: str = ";") -> None:
    """Quotes only where a field holds a quote, the separator or a line break."""
    df.write.mode("overwrite").option("sep", sep).option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def public_columns(df: DataFrame) -> DataFrame:
    """Without columns that begin with an underscore."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith("_")])


def pending_jobs(jobs: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Jobs whose key no finished run has: a run can stop and go on."""
    return jobs.join(done.select(key).distinct(), key, "left_anti")
