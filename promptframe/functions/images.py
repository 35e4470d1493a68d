"""Images carried inside prompt texts as bracketed data URIs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The data URI inside brackets, and the type of each file suffix.
DATA_URI = r"\[(data:image/\w+?;base64,[A-Za-z0-9+/=]+)\]"
IMAGE_TYPES = {
    "jpeg": "image/jpeg",
    "jpg": "image/jpeg",
    "png": "image/png",
    "gif": "image/gif",
    "webp": "image/webp",
}


def image_text(content: Column, suffix: Column) -> Column:
    """Bracketed data URI of a binary image column; NULL for other suffixes."""
    mime = F.element_at(F.create_map(*[F.lit(x) for kv in IMAGE_TYPES.items() for x in kv]),
                        F.lower(suffix))
    # Spark breaks the encoded text into lines
    encoded = F.translate(F.base64(content), "\r\n", "")
    return F.concat(F.lit("[data:"), mime, F.lit(";base64,"), encoded, F.lit("]"))


def images(prompt: Column) -> Column:
    """Data URIs of a prompt, in order."""
    return F.regexp_extract_all(prompt, F.lit(DATA_URI), F.lit(1))


def without_images(prompt: Column) -> Column:
    """Prompt text with ``[img01]``, ``[img02]`` ... in place of its images."""
    numbered = F.transform(
        images(prompt),
        lambda uri, i: F.struct(
            uri.alias("uri"),
            F.concat(F.lit("img"), F.lpad((i + 1).cast("string"),
                     F.greatest(F.lit(2), F.length((i + 1).cast("string"))), "0")).alias("label")))
    return F.when(
        F.contains(prompt, F.lit("[data:image/")),
        F.aggregate(numbered, prompt, lambda text, im: F.replace(text, im["uri"], im["label"]))
    ).otherwise(prompt)
