"""Records from semi-structured text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrasift.functions import geometry as G
from terrasift.functions import text as X


def text_blocks(rows: DataFrame, key: str, text: str, separator: str = r"\n\s*\n") -> DataFrame:
    """(key, block_no, block): the non-empty blocks of each text."""
    return rows.select(key, F.posexplode(X.blocks(F.col(text), separator)).alias("block_no", "block"))


def airspaces(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Airspaces from blocks of lines that start with a field's two letters: class, name, limits and vertices.

    Blocks without a vertex (``DP d:m:s N d:m:s E``) are left out.
    """
    parts = text_blocks(rows, key, text).withColumn("lines", F.split("block", r"\n"))
    field = lambda code: F.get(F.filter("lines", lambda s: s.startswith(f"{code} ")), F.lit(0)).substr(4, 1000)
    points = F.filter("lines", lambda s: s.startswith("DP "))
    place = lambda s, n: G.dms_to_degrees(F.regexp_extract(s, r"DP\s+(\S+\s+[NS])\s+(\S+\s+[EW])", n))
    out = parts.select(
        key, "block_no", field("AC").alias("class"), field("AN").alias("name"), field("AL").alias("low"), field("AH").alias("high"),
        F.transform(points, lambda s: F.struct(place(s, 1).alias("lat"), place(s, 2).alias("lon"))).alias("vertices"),
    )
    return out.where(F.size("vertices") > 0)


def key_value_records(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, fields): the ``key: value`` lines of each text as a map.

    A key without a value opens a section, whose name is put before the keys that follow; of equal keys the last wins.
    """
    lines = rows.select(key, F.posexplode(F.split(text, r"\n")).alias("n", "line")).where(F.col("line").contains(":"))
    lines = lines.select(key, "n", F.trim(F.split_part("line", F.lit(":"), F.lit(1))).alias("k"), F.trim(F.expr("substring(line, instr(line, ':') + 1)")).alias("v"))
    w = Window.partitionBy(key).orderBy("n")
    section = F.last(F.when(F.col("v") == "", F.col("k")), ignorenulls=True).over(w)
    named = lines.withColumn("section", section).where("v <> ''")
    name = F.when(F.col("section").isNull(), F.col("k")).otherwise(F.concat_ws(".", "section", "k"))
    last = named.groupBy(key, name.alias("name")).agg(F.max_by("v", "n").alias("value"))
    return last.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("fields"))


#: The fields of an inspection page: the patterns of each, tried in order. Fixed by the documents' wording.
PAGE_FIELDS = {
    "file": (r"Nazwa pliku:?\s*(\S+)",),
    "number": (r"Numer wskazania:?\s*(\d+)",),
    "damage": (r"(?s)Uszkodzenie:?\s*(.*?)\s*Panel", r"Rodzaj:?\s*([^\n]+)"),
    "panel": (r"Panel:?\s*([\w,.-]+)",),
    "least": (r"MIN:?\s*(-?[\d.]+)",),
    "mean": (r"Średnia:?\s*(-?[\d.]+)", r"AVERAGE:?\s*(-?[\d.]+)"),
    "most": (r"MAX:?\s*(-?[\d.]+)",),
}


def page_records(rows: DataFrame, key: str, text: str) -> DataFrame:
    """The fields of each page, through a cascade of patterns; what isn't found is null."""
    found = {n: X.first_match(F.col(text), *p) for n, p in PAGE_FIELDS.items()}
    found["damage"] = X.without_suffix(found["damage"], "Pomiar")
    for n in ("least", "mean", "most"):
        found[n] = found[n].try_cast("double")
    return rows.select(key, *(c.alias(n) for n, c in found.items()))


def unpivot_points(rows: DataFrame, key: str, codes: dict[str, tuple[Column, Column, Column]]) -> DataFrame:
    """One row per code and point (x, y, z) of a wide row; points without coordinates are left out."""
    points = F.array(*(F.struct(F.lit(c).alias("code"), x.alias("x"), y.alias("y"), z.alias("z")) for c, (x, y, z) in codes.items()))
    return rows.select(key, F.inline(points)).where("x is not null")


def split_rows(rows: DataFrame, column: str) -> DataFrame:
    """One row per element of a comma-separated column."""
    return rows.withColumn(column, F.explode(F.split(column, r"\s*,\s*")))
