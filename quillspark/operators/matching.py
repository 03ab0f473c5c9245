"""Which texts hold which phrases (J9), by the phrases' rarest grams as join keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T


def pieces(c: Column | str, size: int) -> Column:
    """The distinct stretches of ``size`` characters of a text; none if it is shorter."""
    c = T.col(c)
    n = F.length(c) - size + 1
    return F.when(n < 1, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(c, i, F.lit(size)))))


def holding(texts: DataFrame, phrases: DataFrame, size: int) -> DataFrame:
    """(text_id, phrase) where a text (text_id, text) holds a phrase (phrase), for phrases
    of ``size`` characters and more; shorter ones are left out.

    A phrase's anchor is the stretch of ``size`` characters that the fewest phrases have.
    Texts are joined by equality on the stretches they have that are anchors, and the
    phrase is looked for in those only, so millions of either side do not meet. A phrase
    is joined once, however often it occurs among the rows.
    """
    p = phrases.select("phrase").where(F.length("phrase") >= size).distinct()
    grams = p.select("phrase", F.explode(pieces("phrase", size)).alias("gram"))
    often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    anchor = grams.join(often, "gram").groupBy("phrase").agg(F.min(F.struct("n", "gram")).alias("a")).select("phrase", F.col("a.gram").alias("gram"))
    t = texts.select("text_id", "text").where(F.length("text") >= size)
    near = t.select("text_id", F.explode(pieces("text", size)).alias("gram")).join(anchor, "gram").select("text_id", "phrase")
    return near.join(t, "text_id").where(F.contains("text", F.col("phrase"))).select("text_id", "phrase").distinct()
