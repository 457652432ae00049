"""Expressions over the bytes of strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def n_bytes(s: Column | str) -> Column:
    return F.octet_length(s).cast("long")


def byte_tokens(s: Column | str) -> Column:
    """The bytes as array<int>, 0 to 255; empty for the empty string."""
    b = F.col(s).cast("binary") if isinstance(s, str) else s.cast("binary")
    one = F.transform(F.sequence(F.lit(1), F.octet_length(b)), lambda i: F.conv(F.hex(F.substring(b, i, F.lit(1))), 16, 10).cast("int"))
    return F.when(F.octet_length(b) > 0, one).otherwise(F.array().cast("array<int>"))


def token_string(s: Column | str) -> Column:
    """The bytes as fixed-width base tokens `x00HH`: `x` isn't a hex digit, so a search in it is always aligned."""
    return F.regexp_replace(F.hex(F.col(s).cast("binary") if isinstance(s, str) else s.cast("binary")), "(..)", "x00$1")


def tokens_of(t: Column | str) -> Column:
    """array<int> of a fixed-width token string."""
    t = F.col(t) if isinstance(t, str) else t
    n = F.floor(F.length(t) / 5).cast("int")
    one = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.substring(t, i * 5 + 2, F.lit(4)), 16, 10).cast("int"))
    return F.when(n > 0, one).otherwise(F.array().cast("array<int>"))


def merge_threshold(total_bytes: Column) -> Column:
    """How often an adjacent pair must be seen to become a token: log2 of the MiB, 2 at least, cut to an integer."""
    return F.greatest(F.log2(total_bytes / F.lit(1024.0 * 1024.0)), F.lit(2.0)).cast("int")
