"""Deterministic hash arithmetic in built-in functions."""

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

_URL_NAMESPACE = uuid.NAMESPACE_URL.hex


def salted_md5(value: Column, salt: str = "") -> Column:
    return F.md5(F.concat(F.lit(salt), value).cast("binary"))


def hex_number(digits: Column) -> Column:
    """Up to 15 hexadecimal digits as a bigint."""
    return F.conv(digits, 16, 10).cast("bigint")


def uuid5_url(name: Column) -> Column:
    """Version 5 UUID of `name` in the URL namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(_URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (hex_number(F.substring(digest, 17, 1)) % 4 + 1).cast("int"),
                          F.lit(1))
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3),
        F.lit("-"), F.substring(digest, 21, 12))
