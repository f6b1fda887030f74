"""Addresses and places, as Column expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcela.functions.text import clean_text, col, fold, found, once
from parcela.sources.tables import shared_dir

# Neighbourhoods and their communes, in the order in which they are tried.
COMMUNES = (
    ("agronomia", 15), ("almagro", 5), ("balvanera", 3), ("barracas", 4), ("belgrano", 13), ("boedo", 5), ("caballito", 6),
    ("chacarita", 15), ("coghlan", 12), ("colegiales", 13), ("constitucion", 1), ("flores", 7), ("floresta", 10), ("la boca", 4),
    ("la paternal", 15), ("liniers", 9), ("mataderos", 9), ("monserrat", 1), ("monte castro", 10), ("nueva pompeya", 4),
    ("nunez", 13), ("palermo", 14), ("parque avellaneda", 9), ("parque chacabuco", 7), ("parque chas", 15),
    ("parque patricios", 4), ("puerto madero", 1), ("recoleta", 2), ("retiro", 1), ("saavedra", 12), ("san cristobal", 3),
    ("san nicolas", 1), ("san telmo", 1), ("velez sarsfield", 10), ("versalles", 10), ("villa crespo", 15),
    ("villa del parque", 11), ("villa devoto", 11), ("villa general mitre", 11), ("villa lugano", 8), ("villa luro", 10),
    ("villa ortuzar", 15), ("villa pueyrredon", 12), ("villa real", 10), ("villa riachuelo", 8), ("villa santa rita", 11),
    ("villa soldati", 8), ("villa urquiza", 12),
)


def parse_address(c: Column | str) -> Column:
    """struct<full, street, number, floor, unit>; number stays text. The floor's mark may be a bare p, so
    any word that starts with p counts as one."""
    return once(address_of, clean_text(c))


# What ends a street and its number, and the marks of floors, units and numbers.
BASE_END = r"(?is)(?:,|\bpiso\b|\bdpto\b|\bdepto\b|\bunidad\b).*"


def address_of(full: Column) -> Column:
    """parse_address() of a cleaned text, a column or bound by once(), as it is named many times."""
    floor = found(full, r"(?i)\b(?:piso|p\.?)[\s:]*([A-Za-z0-9-]+)", 1)
    unit = found(full, r"(?i)\b(?:depto|dpto|unidad|uf)[\s:]*([A-Za-z0-9-]+)", 1)
    pattern = r"^(.*?)\s+([0-9]{1,6})(?:\s|$)"
    read = lambda base, number: F.struct(
        full.alias("full"), F.when(number.isNotNull(), F.trim(F.regexp_extract(base, pattern, 1))).when(base != "", base).alias("street"), number.alias("number"), floor.alias("floor"), unit.alias("unit")
    )
    return once(lambda base: once(lambda number: read(base, number), found(base, pattern, 2)), F.trim(F.regexp_replace(full, BASE_END, "")))


def card_address(c: Column | str) -> Column:
    """struct<street, number>: the part before the first comma, and a number at its end. The street of a
    missing address is an empty string."""
    pattern = r"^(.*?)(?:\s+([0-9]{1,6}))?$"
    read = lambda first: F.struct(F.trim(F.regexp_extract(first, pattern, 1)).alias("street"), found(first, pattern, 2).try_cast("int").alias("number"))
    return once(read, F.trim(F.substring_index(F.coalesce(col(c), F.lit("")), ",", 1)))


def place_parts(c: Column | str) -> Column:
    """struct<district, town, province> of a comma-separated place."""
    text = F.coalesce(col(c), F.lit(""))
    province = F.when(F.contains(F.lower(text), F.lit("capital federal")), "Capital Federal")

    def read(parts: Column) -> Column:
        district, town = F.when(F.size(parts) >= 3, F.try_element_at(parts, F.lit(-2))), F.when(F.size(parts) > 0, F.try_element_at(parts, F.lit(-1)))
        return F.struct(district.alias("district"), town.alias("town"), province.alias("province"))

    return once(read, F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != ""))


def commune(c: Column | str) -> Column:
    """The commune of the first neighbourhood whose name the place contains. An ordered chain of cases: no
    join, no shuffle."""
    return once(commune_of, fold(c))


def commune_of(key: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, number in reversed(COMMUNES):
        out = F.when(F.contains(key, F.lit(name)), number).otherwise(out)
    return out


GRAM = 3


def first_contained(df: DataFrame, text: str, lookup: DataFrame, most: int = 10_000) -> DataFrame:
    """df with k and v of the first row (least ord) of lookup (ord, k, v) whose k the text contains; null if there is
    none. A lookup of at most `most` rows, which is checked, becomes one array literal of each row, and no rows are
    paired; of a larger one the names meet the texts in a join on their first GRAM characters."""
    rows = lookup.select("ord", "k", "v").orderBy("ord").limit(most + 1).collect()
    if len(rows) <= most:
        table = F.array(*[F.struct(F.lit(r.k).alias("k"), F.lit(r.v).alias("v")) for r in rows])
        hit = F.get(F.filter(table, lambda x: F.contains(F.col(text), x["k"])), F.lit(0)) if rows else F.lit(None).cast("struct<k:string,v:int>")
        return df.withColumn("_hit", hit).withColumns({"k": F.col("_hit.k"), "v": F.col("_hit.v")}).drop("_hit")
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/texts-{uuid.uuid4().hex}"
    df.withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)  # written, so that a row keeps its number
    own = spark.read.parquet(path)
    starts = lambda n: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substring(F.col(text), i, F.lit(n)))))
    names = lookup.select("ord", "k", "v", F.left("k", F.lit(GRAM)).alias("_gram"))
    grams = own.filter(F.col(text).isNotNull()).select("_row", starts(GRAM).alias("_gram"))
    for n in range(GRAM):  # names shorter than a gram
        grams = grams.union(own.filter(F.col(text).isNotNull()).select("_row", starts(n).alias("_gram") if n else F.lit("").alias("_gram")))
    near = grams.distinct().join(names, "_gram").join(own.select("_row", F.col(text).alias("_text")), "_row").filter(F.contains("_text", "k"))
    first = near.groupBy("_row").agg(F.min_by(F.struct("k", "v"), "ord").alias("_hit"))
    return own.join(first, "_row", "left").select(*df.columns, "_hit.k", "_hit.v")
