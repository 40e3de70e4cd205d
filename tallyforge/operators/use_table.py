"""From a table of uses, who buys what from whom, to a sector model.

Codes become sectors by a concordance of prefixes, the longest of which counts. Flows are
summed by pair of codes first, which leaves as many rows as there are pairs of codes whatever
the size of the table; everything after that is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.checkpoints import checkpointed
from tallyforge.functions.text import value_added_kind

#: The names in a file's header, by what stands below them; values reach up to the last of them.
HEADER = {"commodity": "Commodity", "industry": "Industry", "value": "PurVal", "end": "IOYear"}
#: Characters of a code, and the most header rows that are broadcast (a path and four offsets each).
CODE_WIDTH, BROADCAST_FILES = 6, 100_000


def use_table_files(spark: SparkSession, path: str) -> DataFrame:
    """Flows of all files under a path; each has its own header line."""
    lines = spark.read.text(path)  # bytes as they are: the files are in Latin-1
    return use_lines(lines.select(F.input_file_name().alias("file"), F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("value")))


def use_lines(lines: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """(row, column, value) of fixed-width lines (file, value) whose offsets stand in each file's header.

    A header has all four names, in any order and place. Codes are trimmed and in capitals.
    Lines whose value is blank, a dot or no number have no row; a file without a header is an error.
    Headers are looked for among ``headers``, lines too, else among all lines, which are then read twice.
    """
    at = {k: F.instr("value", name) for k, name in HEADER.items()}
    among = lines if headers is None else headers
    heads = checkpointed(among.where(" AND ".join(f"instr(value, '{n}') > 0" for n in HEADER.values())).groupBy("file").agg(*(F.min(c).alias(f"at_{k}") for k, c in at.items())))
    if heads.count() <= BROADCAST_FILES:
        heads = F.broadcast(heads)
    body = lines.join(heads, "file", "left")
    known = F.when(F.col("at_value").isNull(), F.raise_error(F.concat(F.lit("no header in "), "file")).cast("int")).otherwise(F.col("at_value"))
    cut = lambda start, length: F.trim(F.substring(F.col("value"), start, length))
    code = lambda k: F.upper(cut(F.col(f"at_{k}"), F.lit(CODE_WIDTH)))
    found = body.select(code("commodity").alias("row"), code("industry").alias("column"), cut(known, F.col("at_end") - F.col("at_value")).try_cast("double").alias("value"))
    return found.where("value IS NOT NULL AND NOT isnan(value)")


def concordance(codes: DataFrame, rules: DataFrame) -> DataFrame:
    """(code, sector) by the longest prefix (prefix, sector) that fits; null where that one says so or none fits. ``rules`` is a table of fixed size."""
    tried = codes.select("code").distinct().withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("code"), F.lit(1))), lambda n: F.substring(F.col("code"), F.lit(1), n))))
    return tried.join(F.broadcast(rules), "prefix", "left").groupBy("code").agg(F.max_by("sector", F.when(F.col("known"), F.length("prefix"))).alias("sector"))


def classified(flows: DataFrame, rules: DataFrame) -> DataFrame:
    """Flows by pair of codes with what they are: (row, column, value, n, row_sector, sector, kind).

    kind is labor, taxes or capital for value added, total for other rows of accounts and sums,
    and input for all else; zero flows are left out. The sums are written once, as both sides'
    codes and the flows themselves are read from them.
    """
    sums = checkpointed(flows.where("value <> 0").groupBy("row", "column").agg(F.sum("value").alias("value"), F.count("*").alias("n")))
    marked = rules.withColumn("known", F.lit(True))
    codes = sums.select(F.col("row").alias("code")).union(sums.select("column"))
    sectors = concordance(codes, marked)
    kind = F.coalesce(value_added_kind(F.col("row")), F.when(F.col("row").rlike("^[VTF]"), "total"), F.lit("input"))
    named = sums.join(sectors.select(F.col("code").alias("column"), "sector"), "column")
    return named.join(sectors.select(F.col("code").alias("row"), F.col("sector").alias("row_sector")), "row").withColumn("kind", kind)


def sales(rows: DataFrame) -> DataFrame:
    """(i, j, z): what sectors sell to sectors. Rows and columns without a sector have no part."""
    return rows.where("kind = 'input' AND row_sector IS NOT NULL AND sector IS NOT NULL").groupBy(F.col("row_sector").alias("i"), F.col("sector").alias("j")).agg(F.sum("value").alias("z"))


def accounts(rows: DataFrame) -> DataFrame:
    """(sector, labor, energy, capital, taxes, x): value added by kind and gross output.

    Output counts every input, of rows without a sector too, and all value added. Energy is a
    sector like others, so no row of value added is of that kind. A sector whose output isn't
    positive is an error.
    """
    part = lambda k: F.sum(F.when(F.col("kind") == k, F.col("value")).otherwise(0.0)).alias(k)
    sums = rows.where("sector IS NOT NULL AND kind <> 'total'").groupBy("sector").agg(*(part(k) for k in ("labor", "energy", "capital", "taxes")), F.sum("value").alias("x"))
    said = F.concat(F.lit("output of "), "sector", F.lit(" is not positive"))
    return sums.withColumn("x", F.when(F.col("x") > 0, F.col("x")).otherwise(F.raise_error(said).cast("double")))


def intensities(account: DataFrame) -> DataFrame:
    """Value added a unit of output, and their sum v."""
    each: dict[str, Column] = {k: F.col(k) / F.col("x") for k in ("labor", "energy", "capital", "taxes")}
    return account.select("sector", *(c.alias(k) for k, c in each.items()), sum(each.values()).alias("v"))


def ledger(rows: DataFrame) -> DataFrame:
    """(side, code, fate, n, value): what the model leaves out, and where it went.

    Columns without a sector are dropped with all that stands in them. In the columns kept, rows
    without a sector count as output alone, and sums and other accounts not at all.
    """
    columns = rows.where("sector IS NULL").select(F.lit("column").alias("side"), F.col("column").alias("code"), F.lit("dropped").alias("fate"), "n", "value")
    fate = F.when(F.col("kind") == "total", "ignored").otherwise("output only")
    lines = rows.where("sector IS NOT NULL AND (kind = 'total' OR kind = 'input' AND row_sector IS NULL)").select(F.lit("row").alias("side"), F.col("row").alias("code"), fate.alias("fate"), "n", "value")
    return columns.unionByName(lines).groupBy("side", "code", "fate").agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
