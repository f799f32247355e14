"""Package reference documents: Markdown lists of packages and policy links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trim_text
from ..schemas import PACKAGE_REFERENCE

_HEADING = r"^(\d+)\. \*\*(.+?)\*\*(?:[ \t]+\(([^)\n]*)\))?"


def read_reference(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Whole documents as ``text``; no path at all reads as an empty table."""
    if not paths:
        return spark.createDataFrame([], "text string")
    return spark.read.text(paths, wholetext=True).withColumnRenamed("value", "text")


def parse_reference(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per numbered package entry.

    ``## `` opens a category, ``### N. **name** (status)`` an entry, whose next
    line describes it and whose ``- **label**: value`` lines link it. Sections
    without numbered entries give no rows.
    """
    sections = documents.select(F.explode(_parts(F.col(text_col), "## ")).alias("_section"))
    entries = sections.select(
        trim_text(F.element_at(F.split("_section", "\n", 2), 1)).alias("category"),
        F.explode(_parts(F.col("_section"), "### ")).alias("_entry"),
    ).where(F.col("_entry").rlike(_HEADING))
    second = trim_text(F.coalesce(F.get(F.split("_entry", "\n"), F.lit(1)), F.lit("")))

    def link(label: str) -> Column:
        found = F.regexp_extract("_entry", rf"(?m)^- \*\*{label}\*\*: *(.*)$", 1)
        return F.nullif(trim_text(found), F.lit(""))

    return entries.select(
        F.regexp_extract("_entry", _HEADING, 1).cast("int").alias("ordinal"),
        "category",
        F.regexp_extract("_entry", _HEADING, 2).alias("name"),
        F.nullif(F.regexp_extract("_entry", _HEADING, 3), F.lit("")).alias("status"),
        F.when(~second.startswith("- "), second).alias("description"),
        link("npm").alias("npm_url"),
        link("Security Policy").alias("security_url"),
        link("Privacy Policy").alias("privacy_url"),
        link("GitHub").alias("github_url"),
        link("Note").alias("note"),
    ).to(PACKAGE_REFERENCE)


def reference_entry() -> Column:
    """A reference row as text, in the form that ``parse_reference`` reads."""

    def link(label: str, column: str) -> Column:
        return F.concat(F.lit(f"- **{label}**: "), F.col(column))  # null, and so left out, without a link

    return F.concat_ws(
        "\n",
        F.concat(
            F.lit("### "), F.col("ordinal").cast("string"), F.lit(". **"), "name", F.lit("**"),
            F.coalesce(F.concat(F.lit(" ("), "status", F.lit(")")), F.lit("")),
        ),
        "description",
        link("npm", "npm_url"), link("Security Policy", "security_url"),
        link("Privacy Policy", "privacy_url"), link("GitHub", "github_url"), link("Note", "note"),
    )


def _parts(text: Column, marker: str) -> Column:
    """Pieces after each line that opens with the marker."""
    pieces = F.split(text, rf"(?m)^{marker}")
    return F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))


def unique_reference(reference: DataFrame) -> DataFrame:
    """One entry per name, the lowest ordinal winning."""
    fields = [c for c in reference.columns if c != "name"]
    return reference.groupBy("name").agg(
        F.min_by(F.struct(*fields), F.struct("ordinal", "category")).alias("_r")
    ).select("name", "_r.*")
