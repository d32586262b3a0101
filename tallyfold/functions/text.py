"""Small scalar functions as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without blanks, tabs and newlines at either end."""
    return F.regexp_replace(col(x), r"(?U)^\s+|\s+$", "")


def empty_to_null(x: Column | str) -> Column:
    return F.nullif(col(x), F.lit(""))


def zero_to_null(x: Column | str) -> Column:
    return F.nullif(col(x), F.lit(0).cast("long"))


def branch_name(x: Column | str) -> Column:
    """The branch, or null: a detached head has no branch."""
    return F.nullif(F.nullif(strip(x), F.lit("HEAD")), F.lit(""))


def day_of(captured_at: Column | str) -> Column:
    """First ten characters; '' without a time. Offsets are not applied."""
    return F.substring(F.coalesce(col(captured_at), F.lit("")), 1, 10)


def pick_key(origin: Column | str = "origin_id", seq: Column | str = "seq") -> Column:
    """Orders lines alike everywhere: origin, a colon, seq in 20 digits."""
    return F.concat(col(origin), F.lit(":"), F.lpad(col(seq).cast("string"), 20, "0"))


def pull_request_key(repo: Column | str = "pr_repo", number: Column | str = "pr_number") -> Column:
    return F.concat_ws("#", col(repo), col(number).cast("string"))


def repo_name(repo: Column | str) -> Column:
    """What follows the last slash."""
    return F.substring_index(col(repo), "/", -1)


def shorten(x: Column | str) -> Column:
    return F.substring(col(x), 1, 8)


def content_hash(value: Column | str) -> Column:
    return F.sha2(col(value), 256)


def normalize_model(model: Column | str) -> Column:
    """Trimmed, cut at the first bracket, without a date of eight digits at the end."""
    return F.regexp_replace(F.substring_index(strip(model), "[", 1), "-[0-9]{8}$", "")


def digest_count(digest: Column | str) -> Column:
    """The count in front of a digest's colon."""
    return F.substring_index(col(digest), ":", 1).try_cast("long")


def host_of(addr: Column | str) -> Column:
    """host of host:port or [v6]:port; an address without a valid port stays whole."""
    a = col(addr)
    v6 = F.regexp_extract(a, r"^\[([^\[\]]*)\]:[^:\[\]]*$", 1)
    plain = F.regexp_extract(a, r"^([^:\[\]]*):[^:\[\]]*$", 1)
    return F.when(a.rlike(r"^\[[^\[\]]*\]:[^:\[\]]*$"), v6).when(a.rlike(r"^[^:\[\]]*:[^:\[\]]*$"), plain).otherwise(a)
