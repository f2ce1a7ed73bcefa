"""Certificates of total colourings: strict documents that are bound to a graph by its fingerprint."""

from __future__ import annotations

import hashlib
import json
import re

from .strict_json import StrictJsonError, loads

# The version, the kind and the keys of a certificate.
VERSION, KIND = "total-coloring.certificate.v1", "total-coloring"
KEYS = {"schema_version", "kind", "graph_fingerprint", "palette_size", "vertex_colors", "edge_colors"}


class CertificateError(ValueError):
    pass


def _whole(x: object) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and x >= 0


def checked(document: object) -> dict:
    """The document, if it has exactly the keys and only colours of its palette."""
    if not isinstance(document, dict):
        raise CertificateError("not an object")
    if document.keys() != KEYS:
        raise CertificateError(f"missing keys {sorted(KEYS - document.keys())}, unknown keys {sorted(document.keys() - KEYS)}")
    if (document["schema_version"], document["kind"]) != (VERSION, KIND):
        raise CertificateError("unsupported version or kind")
    if not isinstance(document["graph_fingerprint"], str) or not re.fullmatch("[0-9a-f]{64}", document["graph_fingerprint"]):
        raise CertificateError("graph_fingerprint isn't a lower-case SHA-256")
    if not _whole(document["palette_size"]):
        raise CertificateError("palette_size isn't a nonnegative integer")
    for name in ("vertex_colors", "edge_colors"):
        colors = document[name]
        if not isinstance(colors, list) or not all(_whole(c) and c < document["palette_size"] for c in colors):
            raise CertificateError(f"{name} isn't an array of colours of the palette")
    return document


def parse(text: str) -> dict:
    try:
        return checked(loads(text))
    except StrictJsonError as e:
        raise CertificateError(str(e)) from None


def text_of(certificate: dict) -> str:
    """The canonical text: sorted keys, no spaces, no newline."""
    return json.dumps(checked(certificate), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def fingerprint(certificate: dict) -> str:
    return hashlib.sha256(text_of(certificate).encode()).hexdigest()


def make(graph_fingerprint: str, palette_size: int, vertex_colors: list[int], edge_colors: list[int]) -> dict:
    return checked({"schema_version": VERSION, "kind": KIND, "graph_fingerprint": graph_fingerprint, "palette_size": palette_size, "vertex_colors": vertex_colors, "edge_colors": edge_colors})
