"""Exact dedup: texts grouped by a 128-bit content hash and, inside a hash, by their bytes; one stable row of each group stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import spread_lookup


def without_blanks(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    norm = without_blanks(F.col(text_col))
    return docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("chars"),
                       F.unhex(F.md5(norm)).alias("h"), F.sha2(norm, 256).alias("text_sha256"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their bytes are, blanks (space, tab to carriage return) left out.  Of equal texts the row with the most
    code points stays, then the one with the least id.  Null text counts as empty; an empty text equals every other empty one;
    a null id loses against any other and comes back as it is; rows repeated with the same id and text are all marked like the one
    that stays; further columns are ignored; an empty table gives no rows.

    Grouping by (hash, bytes) compares the bytes themselves, and combines before the shuffle, so a group of any size sends one text per
    map task.  The way back to the rows carries no text."""
    keyed = _keyed(docs, id_col, text_col)
    classes = (keyed.groupBy("h", "norm").agg(F.count(F.lit(1)).alias("group_size"), F.first("text_sha256").alias("text_sha256"),
                                              F.max(F.struct("chars", (-F.col("doc_id")).alias("back"))).alias("best"))
               .select("h", "text_sha256", "group_size", (-F.col("best.back")).alias("keep_id")))
    rows = keyed.select("doc_id", "h", "text_sha256")
    return (spread_lookup(rows, classes, ["h", "text_sha256"], "group_size", F.col("doc_id"))
            .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns: one of each group of ``exact_groups``, taken whole in the grouping itself.

    Rows that tie in length and id are told apart by their other values, so the choice is stable."""
    norm = without_blanks(F.col(text_col))
    order = [F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("_chars"), (-F.col(id_col)).alias("_back"),
             *[F.col(c).alias(f"_c{i}") for i, c in enumerate(docs.columns)]]
    best = docs.groupBy(F.unhex(F.md5(norm)).alias("_h"), norm.alias("_norm")).agg(F.max(F.struct(*order)).alias("_best"))
    return best.select(*[F.col(f"_best._c{i}").alias(c) for i, c in enumerate(docs.columns)])
