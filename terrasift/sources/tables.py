"""Text tables as surveys write them: encodings, skipped lines, white-space columns, template headers, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Encodings that Spark's reader knows by itself.
KNOWN = ("utf-8", "iso-8859-1", "us-ascii", "utf-16", "utf-32")


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", encoding: str = "utf-8", header: bool = False) -> DataFrame:
    """A delimited table with its columns named by position. Fields that don't parse are null.

    Other one-byte encodings, such as cp1250, are read byte for byte and their letters put in their places.
    """
    own = encoding.lower() in KNOWN
    rows = spark.read.csv(path, schema=schema, sep=sep, encoding=encoding if own else "iso-8859-1", header=header, mode="PERMISSIVE")
    if own:
        return rows
    letters = [(chr(b), bytes([b]).decode(encoding, "replace")) for b in range(128, 256)]
    wrong, right = ("".join(x) for x in zip(*((a, b) for a, b in letters if a != b)))
    return rows.withColumns({c: F.translate(c, wrong, right) for c, kind in rows.dtypes if kind == "string"})


def read_columns(spark: SparkSession, path: str, schema: dict[str, str], skip: int = 0, sep: str = r"\s+") -> DataFrame:
    """(file, columns) of lines split by white space, or a pattern, without the first ``skip`` lines of each file.

    A file is read whole by one task, which alone knows which lines come first.
    """
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value")
    lines = files.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line")).where((F.col("line_no") >= skip) & (F.trim("line") != ""))
    parts = F.split(F.trim("line"), sep)
    columns = [F.try_element_at(parts, F.lit(k + 1)).try_cast(kind).alias(name) for k, (name, kind) in enumerate(schema.items())]
    return lines.select("file", *columns)


def write_with_header(rows: DataFrame, path: str, header: list[str], sep: str = ";") -> None:
    """A delimited text file that starts with the lines of a template; one task writes it, in the order of the rows.

    For device files of a few thousand rows. Larger tables are written in parts, by ``write.csv``.
    """
    spark = rows.sparkSession
    body = rows.select(F.concat_ws(sep, *(F.col(c).cast("string") for c in rows.columns)).alias("value"), F.monotonically_increasing_id().alias("n"))
    head = spark.createDataFrame([(line, k - len(header)) for k, line in enumerate(header)], "value string, n long")
    head.union(body).coalesce(1).sortWithinPartitions("n").select("value").write.text(path)


def append_once(rows: DataFrame, path: str, batch: str, form: str = "csv", **options) -> None:
    """Append ``rows`` to the table of files below ``path`` as one named batch, without a lock.

    A batch has its own folder, which is replaced as a whole: appending it again, or after a failure, changes nothing else
    and doubles nothing, and batches of different names can be written at the same time.
    """
    rows.write.format(form).options(**options).mode("overwrite").save(f"{path.rstrip('/')}/batch={batch}")


def write_report(lines: DataFrame, path: str, order: str = "line_no", text: str = "text") -> None:
    """A text report of (line_no, text), as one file; for reports of some thousand lines."""
    lines.select(order, text).coalesce(1).sortWithinPartitions(order).select(text).write.mode("overwrite").text(path)


def coverage_report(files: DataFrame, covered: DataFrame, folder: str, cell: float) -> DataFrame:
    """(line_no, text): the report of a coverage run over ``files`` (name, error) and the occupied cells ``covered``."""
    counts = files.agg(F.count(F.lit(1)).alias("all"), F.count("error").alias("bad"))
    area = covered.agg((F.count(F.lit(1)) * cell * cell).alias("m2"))
    values = counts.join(F.broadcast(area))  # one row each
    # the report's lines are fixed values: other tools read them
    line = lambda k, *parts: F.struct(F.lit(k).cast("long").alias("line_no"), F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts)).alias("text"))
    number = lambda c, digits: F.format_string(f"%.{digits}f", c.cast("double"))
    head = F.array(
        line(0, "=== FOOTPRINT CHMUR PUNKTÓW ==="),
        line(1, f"Źródłowy katalog: {folder}"),
        line(2, "Liczba plików .laz (wszystkich): ", F.col("all").cast("string")),
        line(3, "Liczba plików przetworzonych poprawnie: ", (F.col("all") - F.col("bad")).cast("string")),
        line(4, "Liczba plików z błędem: ", F.col("bad").cast("string")),
        line(5, f"Rozdzielczość maski: {cell} m"),
        line(6, ""),
        line(7, "Powierzchnia pokrycia: ", number(F.col("m2"), 2), " m²"),
        line(8, "Powierzchnia pokrycia: ", number(F.col("m2") / 10_000, 4), " ha"),
    )
    failed = files.where("error is not null").select((F.lit(10) + F.row_number().over(Window.orderBy("name"))).cast("long").alias("line_no"), F.concat(F.lit(" - "), "name").alias("text"))
    title = values.where("bad > 0").select(F.inline(F.array(line(9, ""), line(10, "Pliki, których nie udało się przetworzyć:"))))
    return values.select(F.inline(head)).union(title).union(failed)


def missing(wanted: DataFrame, done: DataFrame, name: str = "name") -> DataFrame:
    """What isn't there yet: the rows of ``wanted`` whose file name, the end of an address, is not in a listing."""
    end = lambda c: F.element_at(F.split(F.col(c), "/"), -1)
    return wanted.withColumn("_n", end(name)).join(done.select(F.col("name").alias("_n")).distinct(), "_n", "left_anti").drop("_n")


def write_worldfiles(rows: DataFrame, path: str, key: str) -> None:
    """The six lines of a world file (px, 0, 0, -px, x, y) for each raster, in a folder named by its key."""
    lines = F.array(*(F.col(c).cast("string") if c else F.lit("0.0") for c in ("px", None, None)), (-F.col("px")).cast("string"), *(F.col(c).cast("string") for c in ("x", "y")))
    rows.select(key, F.array_join(lines, "\n").alias("value")).write.partitionBy(key).text(path)


def listing(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """(path, name, length) of the files of a folder; their content isn't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def read_ascii_grid(spark: SparkSession, path: str) -> DataFrame:
    """(file, r, c, x, y, value) of ESRI ASCII grids; x and y are cell centres, no data is null."""
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value")
    head = lambda k: F.regexp_extract("value", rf"(?i){k}\s+(-?[\d.eE+]+)", 1).try_cast("double")
    files = files.select("file", "value", *(head(k).alias(k) for k in ("nrows", "xllcorner", "yllcorner", "cellsize", "nodata_value")))
    lines = files.withColumn("lines", F.filter(F.split("value", r"\r?\n"), lambda s: F.trim(s).rlike(r"^[-\d.]"))).drop("value")
    cells = lines.select("*", F.posexplode("lines").alias("r", "line")).drop("lines")
    cells = cells.select("*", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("c", "v")).withColumn("v", F.col("v").try_cast("double"))
    x = F.col("xllcorner") + (F.col("c") + 0.5) * F.col("cellsize")
    y = F.col("yllcorner") + (F.col("nrows") - F.col("r") - 0.5) * F.col("cellsize")
    return cells.select("file", "r", "c", x.alias("x"), y.alias("y"), F.when(~F.col("v").eqNullSafe(F.col("nodata_value")), F.col("v")).alias("value"))


def write_ascii_rows(cells: DataFrame, path: str, nodata: float = -9999.0) -> None:
    """The rows of an ASCII grid (r, c, value), one line per row, dealt to files by ranges of rows."""
    line = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c", F.coalesce("value", F.lit(nodata)).alias("v")))), lambda s: s["v"].cast("string")), " ")
    cells.groupBy("r").agg(line.alias("value")).repartitionByRange("r").sortWithinPartitions("r").select("value").write.text(path)


def skip_lines(rows: DataFrame, key: str, order: str, skip: int) -> DataFrame:
    """Rows of a table without the first ``skip`` of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_n") > skip).drop("_n")
