"""Segmentation of marked-up article texts into passages with stable backrefs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.text import WHITE_SPACE, detokenize, heading_kind, slug

LEAST_WORDS = 5


def passages(docs: DataFrame, key: str, text: str, scheme: str = "wikipedia") -> DataFrame:
    """(key, source_uri, passage): detokenised body lines of five words or more, numbered from 1 within their article.

    A title line starts an article; a title that came before in the same text gets -2, -3, … after its slug; lines before
    any title belong to _unknown; section lines are left out.
    """
    lines = docs.select(key, F.posexplode(F.split(text, "\r?\n")).alias("at", "raw")).withColumn("line", F.regexp_replace("raw", f"^{WHITE_SPACE}|{WHITE_SPACE}$", "")).where("line <> ''")
    lines = lines.withColumn("kind", heading_kind(F.col("line"))).where("kind <> 'section'")
    lines = lines.withColumn("clean", detokenize(F.when(F.col("kind") == "title", F.trim(F.regexp_replace("line", "^=+|=+$", ""))).otherwise(F.col("line"))))
    order = Window.partitionBy(key).orderBy("at")
    lines = lines.withColumn("article", F.sum((F.col("kind") == "title").cast("int")).over(order))
    titles = lines.where("kind = 'title'").select(key, "article", slug(F.col("clean")).alias("base"))
    again = F.row_number().over(Window.partitionBy(key, "base").orderBy("article"))
    titles = titles.select(key, "article", F.when(again == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), again.cast("string"))).alias("slug"))
    body = lines.where((F.col("kind") == "body") & (F.size(F.filter(F.split("clean", WHITE_SPACE), lambda w: w != "")) >= LEAST_WORDS))
    body = body.withColumn("n", F.row_number().over(Window.partitionBy(key, "article").orderBy("at")))
    named = body.join(titles, [key, "article"], "left")
    uri = F.concat(F.lit(f"{scheme}://"), F.coalesce("slug", F.lit("_unknown")), F.lit("#p"), F.col("n").cast("string"))
    return named.select(key, uri.alias("source_uri"), F.col("clean").alias("passage"))
