"""Documents with nulls, empty and long texts, repeated rows, and columns whose names could clash."""

from pyspark.sql import functions as F

LONG = "the quick brown fox and the lazy dog of that house " * 6000
PROSE = ("It is the end of the day and we are in the house with all of the others that have been here for a while, "
         "so there is nothing that we can do about it but wait for the morning to come and to bring the light. "
         "When it was over they went to the town by the river, which is not far from here, and on the way they met "
         "a man who had been to the sea and who told them of the ships that he had seen in the harbour there.")
ROWS = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, PROSE, "en", "a"), (3, PROSE, "en", "a"), (4, LONG, None, None),
    (5, " \t\n", "fr", "b"), (None, PROSE + " tail", "en", "b"), (6, PROSE + " tail", "en", "c"), (7, "12 34 !!", "de", "c"),
    (8, "\U0001f600 é中文 don't\r\n  x", "de", None), (9, "x", "en", "a")]
CLASHES = ["_row", "_t", "_text", "_words", "key", "n", "id", "digest", "start", "spans", "window", "rank", "kept", "value"]


def documents(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)])


def bit_texts():
    """Two different texts of one length whose polynomial sums modulo 2**64 are equal for every base."""
    first = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    return first, first.translate(str.maketrans("ab", "ba"))
