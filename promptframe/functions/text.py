"""How a typed value reads inside a prompt, and white-space trimming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F, types as T


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(col: Column) -> Column:
    """Remove leading and trailing Unicode white space."""
    space = r"[\s\x1c-\x1f]+"
    return F.regexp_replace(F.regexp_replace(col, rf"(?U)^{space}", ""), rf"(?U){space}\z", "")


def _exponent_text(col: Column) -> Column:
    """Exponent notation with the fewest digits that read back as the same double."""
    texts = [F.format_string(f"%.{digits - 1}e", col) for digits in (15, 16, 17)]
    return (F.when(texts[0].cast("double") == col, texts[0])
            .when(texts[1].cast("double") == col, texts[1]).otherwise(texts[2]))


def double_text(col: Column) -> Column:
    """Shortest decimal text of a double: 0.0001, 10000000.0, 1e+16, inf.

    Plain notation for 1e-4 <= |x| < 1e16, otherwise an exponent of at least two
    digits with its sign.
    """
    col = col.cast("double")
    text = F.abs(col).cast("string")
    # Spark's own text is right if it is plain and short; long ones may not be shortest
    plain = ~F.contains(text, F.lit("E")) & (F.length(text) < 16)

    def parts(exact: Column) -> Column:
        digits = F.rtrim(F.replace(F.substring_index(exact, "e", 1), F.lit("."), F.lit("")), F.lit("0"))
        return F.struct(digits.alias("digits"), F.length(digits).alias("n"),
                        F.substring_index(exact, "e", -1).cast("int").alias("exponent"))

    def placed(p: Column) -> Column:
        digits, n, exponent = p["digits"], p["n"], p["exponent"]
        whole = F.when(
            n <= exponent + 1, F.concat(F.rpad(digits, exponent + 1, F.lit("0")), F.lit(".0"))
        ).otherwise(F.concat(F.substring(digits, F.lit(1), exponent + 1), F.lit("."),
                             F.substring(digits, exponent + 2, n)))
        fraction = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
        size = F.abs(exponent).cast("string")
        scientific = F.concat(
            F.substring(digits, 1, 1),
            F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(""),
            F.when(exponent < 0, "e-").otherwise("e+"),
            F.when(F.length(size) < 2, F.concat(F.lit("0"), size)).otherwise(size))
        return (F.when((exponent >= 0) & (exponent < 16), whole)
                .when((exponent < 0) & (exponent >= -4), fraction).otherwise(scientific))

    body = F.when(plain, text).otherwise(
        let(_exponent_text(F.abs(col)), lambda exact: let(parts(exact), placed)))
    # the text of -0.0 has a sign that no comparison shows
    sign = F.when(col.cast("string").startswith("-"), "-").otherwise("")
    return (
        F.when(col.isNull() | F.isnan(col), "")
        .when(F.abs(col) == float("inf"), F.concat(sign, F.lit("inf")))
        .otherwise(F.concat(sign, body)))


def value_text(col: Column, dtype: T.DataType) -> Column:
    """Text of ``col`` inside a prompt; a missing value is the empty text."""
    if isinstance(dtype, T.StringType):
        return F.coalesce(col, F.lit(""))
    if isinstance(dtype, T.BooleanType):
        return F.when(col, "True").when(~col, "False").otherwise("")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return double_text(col)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        micros = F.date_format(col, "SSSSSS")
        base = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        return F.coalesce(
            F.when(micros == "000000", base).otherwise(F.concat(base, F.lit("."), micros)),
            F.lit(""))
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.coalesce(F.to_json(col), F.lit(""))
    return F.coalesce(col.cast("string"), F.lit(""))
