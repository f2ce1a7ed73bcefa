"""Release bundles: deterministic archives, checksums, inspection and version transitions."""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import tarfile
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.text import VERSION

SUMS = "SHA256SUMS"
SEMVER = re.compile(VERSION)


class BundleError(ValueError):
    pass


def _safe(name: str) -> bool:
    return bool(name) and not any(c == "\\" or ord(c) < 32 for c in name) and all(p not in ("", ".", "..") for p in name.split("/"))


def archive(files: dict[str, bytes]) -> bytes:
    """A gzip-compressed USTAR archive that depends on names and contents only."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as tar:
        for name in sorted(files):
            if not _safe(name):
                raise BundleError(f"unsafe path {name!r}")
            info = tarfile.TarInfo(name)
            info.size, info.mode = len(files[name]), 0o644
            tar.addfile(info, io.BytesIO(files[name]))
    return gzip.compress(out.getvalue(), 9, mtime=0)


def unpack(data: bytes) -> dict[str, bytes]:
    """The files of an archive that is byte for byte what ``archive`` makes of them."""
    try:
        with tarfile.open(fileobj=io.BytesIO(gzip.decompress(data)), mode="r:") as tar:
            files = {m.name: tar.extractfile(m).read() for m in tar.getmembers() if m.isreg()}
    except (OSError, EOFError, tarfile.TarError, ValueError) as e:
        raise BundleError(str(e)) from None
    except Exception as e:  # zlib.error has no common base with the others
        raise BundleError(str(e)) from None
    if archive(files) != data:
        raise BundleError("not in canonical form")
    return files


def write(folder: Path, files: dict[str, bytes]) -> None:
    """Files and their checksums, the checksums last."""
    for name, data in sorted(files.items()):
        if not _safe(name) or name == SUMS:
            raise BundleError(f"unsafe path {name!r}")
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(data)
    (folder / SUMS).write_text("".join(f"{hashlib.sha256(d).hexdigest()}  {n}\n" for n, d in sorted(files.items())))


def inspect(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """(fault, file) where a bundle differs from its checksums, hashed on the executors."""
    top = folder if "://" in folder else f"file://{folder}"
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(top)
    name = F.regexp_extract("path", rf"{re.escape(top.split('://', 1)[1].rstrip('/'))}/(.*)$", 1)
    hashed = content.select(name.alias("name"), F.sha2("content", 256).alias("h"))
    # Readers leave empty files out; the listing has them.
    path = spark._jvm.org.apache.hadoop.fs.Path(top)
    files, names = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True), []
    while files.hasNext():
        names.append(files.next().getPath().toUri().getPath().removeprefix(top.split("://", 1)[1].rstrip("/") + "/"))
    listed = spark.createDataFrame([(n,) for n in names if n != SUMS and not n.endswith(".crc")], "name string")
    found = listed.join(hashed, "name", "left").select("name", F.coalesce("h", F.sha2(F.lit(""), 256)).alias("got"))
    lines = spark.read.text(f"{top}/{SUMS}").select(F.split("value", "  ", 2).alias("x")).select(F.col("x")[1].alias("name"), F.col("x")[0].alias("want"))
    both = lines.join(found, "name", "full_outer")
    fault = F.when(F.col("want").isNull(), "unlisted").when(F.col("got").isNull(), "missing").when(F.col("want") != F.col("got"), "changed")
    return [(r["fault"], r["name"]) for r in both.withColumn("fault", fault).where("fault IS NOT NULL").orderBy("fault", "name").collect()]


def _order(version: str) -> tuple | None:
    m = SEMVER.fullmatch(version)
    if not m:
        return None
    pre = [(0, int(x), "") if x.isdigit() else (1, 0, x) for x in m[4].split(".")] if m[4] else []
    return (*(int(x) for x in m.groups()[:3]), not pre, pre)


def transition(before: str | None, after: str, published: bool) -> str | None:
    """Why a release may not follow another one, or None."""
    new = _order(after)
    old = _order(before) if before is not None else None
    if new is None or before is not None and old is None:
        return "not a version"
    if old is None or new > old:
        return None
    if new < old:
        return "downgrade"
    return "published is immutable" if published else None
