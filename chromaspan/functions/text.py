"""Validators of release metadata: versions, addresses, instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The languages accepted.
NUMBER = r"(?:0|[1-9][0-9]*)"
WORD = rf"(?:{NUMBER}|[0-9]*[A-Za-z-][0-9A-Za-z-]*)"
#: Major, minor, patch and the prerelease; both engines of regular expressions read it.
VERSION = rf"({NUMBER})\.({NUMBER})\.({NUMBER})(?:-({WORD}(?:\.{WORD})*))?"
#: Java ends a line before a final newline, so a text's end is \z.
SEMVER = rf"^{VERSION}\z"
HOST = r"(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
HTTPS = rf"^https://{HOST}(?:/(?!\.{{1,2}}(?:/|\z))[A-Za-z0-9._~!$&'()*+,;=:@-]+)+\z"
UTC = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z\z"


def semver_key(version: Column) -> Column:
    """A struct that orders as versions do, null if the text isn't a canonical version.

    Numbers order by length and then as text, so they may have any length; a version without a
    prerelease comes after those with one, numeric identifiers before others, a prefix first.
    """
    number = lambda x: F.struct(F.length(x).alias("n"), x.alias("t"))
    part = lambda i: F.regexp_extract(version, SEMVER, i)
    identifier = lambda x: F.struct((~x.rlike(r"^[0-9]+\z")).alias("word"), F.when(x.rlike(r"^[0-9]+\z"), F.length(x)).otherwise(0).alias("n"), x.alias("t"))
    pre = part(4)
    none = F.array().cast("array<struct<word:boolean,n:int,t:string>>")
    found = F.when(pre == "", none).otherwise(F.transform(F.split(pre, r"\."), identifier))
    return F.when(version.rlike(SEMVER), F.struct(number(part(1)).alias("major"), number(part(2)).alias("minor"), number(part(3)).alias("patch"), (pre == "").alias("final"), found.alias("pre")))


def is_stable_url(url: Column) -> Column:
    """An https address of lower-case host and literal path, without port, query, escapes or dots."""
    host = F.regexp_extract(url, "^https://([^/]*)", 1)
    return F.coalesce(url.rlike(HTTPS) & (F.length(host) <= 253), F.lit(False))


def is_canonical_utc(text: Column) -> Column:
    moment = F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return F.coalesce(text.rlike(UTC) & (F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'") == text), F.lit(False))


def is_sha256(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[0-9a-f]{64}\z"), F.lit(False))


def is_safe_path(path: Column) -> Column:
    """A relative path of plain parts without control characters."""
    parts = F.split(path, "/")
    return F.coalesce((path != "") & ~path.rlike(r"[\\\x00-\x1f]") & F.forall(parts, lambda x: ~x.isin("", ".", "..")), F.lit(False))
