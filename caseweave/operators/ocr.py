"""Lines, flags and chat layout from a table of read words; pictures themselves are not read here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers as ids

# Floors of confidence, the header's share of the height, how much nearer one margin must be, screen labels.
MIN_BLOCK_CONFIDENCE, BLURRY_MEAN_CONFIDENCE = 30.0, 55.0
HEADER_BAND_RATIO, BUBBLE_MARGIN_DOMINANCE = 0.14, 0.12
HEADER_NOISE = (
    "transaction successful", "payment successful", "transaction failed", "transfer details", "payment details", "inbox", "sent", "drafts", "chats",
    "status", "calls", "settings", "search", "details", "receipt", "gmail", "whatsapp", "messages", "notifications",
)
LINE = ["image_id", "block_num", "par_num", "line_num"]


def line_blocks(words: DataFrame) -> DataFrame:
    """One row a line: LINE, text (its words in order), confidence (mean of those that have one), left, top, right, bottom.
    words: LINE, word_num, text, left, top, width, height, conf (below 0: none). Blank words don't count."""
    kept = words.where(F.trim("text") != "")
    known = F.when(F.col("conf") >= 0, F.col("conf"))
    return kept.groupBy(*LINE).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_num", "left", F.trim("text").alias("t")))), lambda x: x["t"]), " ").alias("text"),
        F.coalesce(F.avg(known), F.lit(0.0)).alias("confidence"), F.sum(known).alias("conf_sum"), F.count(known).alias("conf_n"),
        F.min("left").alias("left"), F.min("top").alias("top"), F.max(F.col("left") + F.col("width")).alias("right"), F.max(F.col("top") + F.col("height")).alias("bottom"),
    )


def quality_flags(images: DataFrame, blocks: DataFrame) -> DataFrame:
    """images (image_id, height) with `flags`: incomplete without any line; else blurry, low_quality and cropped, in that order of
    the alphabet."""
    n = blocks.groupBy(F.col("image_id").alias("_i")).agg(
        F.count("*").alias("n"), (F.sum("conf_sum") / F.sum("conf_n")).alias("mean"), F.count_if(F.col("confidence") < MIN_BLOCK_CONFIDENCE).alias("poor"),
        F.max("bottom").alias("bottom"), F.min("top").alias("top"),
    )
    cropped = (F.col("height") > 0) & ((F.col("bottom") >= F.col("height") - 2) | (F.col("top") <= 1))
    flags = F.array_sort(F.array_compact(F.array(
        F.when(F.col("n").isNull(), "incomplete"), F.when(F.col("mean") < BLURRY_MEAN_CONFIDENCE, "blurry"), F.when(F.col("poor") > F.col("n") / 3, "low_quality"), F.when(cropped, "cropped"),
    )))
    return images.join(n, F.col("image_id") == F.col("_i"), "left").select(*images.columns, flags.alias("flags"))


def directions(images: DataFrame, blocks: DataFrame) -> DataFrame:
    """Lines below the header with `direction`: incoming where they clearly hug the left margin, outgoing where the right, else null.
    images: image_id, width, height."""
    j = blocks.join(images.select(F.col("image_id").alias("_i"), "width", "height"), F.col("image_id") == F.col("_i"))
    left, right = F.col("left") / F.col("width"), 1 - F.col("right") / F.col("width")
    way = F.when(left + BUBBLE_MARGIN_DOMINANCE <= right, "incoming").when(right + BUBBLE_MARGIN_DOMINANCE <= left, "outgoing")
    return j.where(F.col("top") > F.col("height") * HEADER_BAND_RATIO).select(*LINE, "text", way.alias("direction"))


def names_somebody(text: Column) -> Column:
    """Whether a header line could name a person or account rather than label the screen."""
    digits, letters = F.length(F.regexp_replace(text, r"\D", "")), F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    word = text.rlike(r"(?:^|[\s+])\p{L}{3,}(?:[\s+]|$)")
    noise = F.btrim(F.lower(text), F.lit(" :·-")).isin(*HEADER_NOISE)
    return (text != "") & (F.length(text) <= 64) & ~noise & ((digits >= 8) | ((letters >= 3) & (letters * 2 >= F.length(text)) & word))


def header_identifiers(images: DataFrame, blocks: DataFrame) -> DataFrame:
    """image_id, identifier: the first phone number of the header lines, else the first line that could name somebody."""
    j = blocks.join(images.select(F.col("image_id").alias("_i"), "height"), F.col("image_id") == F.col("_i")).where(F.col("top") <= F.col("height") * HEADER_BAND_RATIO)
    phone = F.nullif(F.regexp_extract("text", ids.PHONE, 0), F.lit(""))
    text = F.trim("text")
    place = F.struct("block_num", "par_num", "line_num")
    best = j.groupBy("image_id").agg(
        F.min(F.when(phone.isNotNull(), F.struct(place.alias("p"), F.trim(phone).alias("t")))).alias("a"), F.min(F.when(names_somebody(text), F.struct(place.alias("p"), text.alias("t")))).alias("b")
    )
    return best.select("image_id", F.coalesce("a.t", "b.t").alias("identifier")).where("identifier IS NOT NULL")
