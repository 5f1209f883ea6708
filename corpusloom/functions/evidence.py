"""Evidence documents: deterministic JSON, statements and predicates, digests and reports."""

from __future__ import annotations

import base64
import datetime
import hashlib
import json
from typing import Any

from corpusloom.functions.blake3 import digest

STATEMENT_TYPE = "https://in-toto.io/Statement/v1"
BOUNDARIES = {"interior": (True, True), "before_first": (False, True), "after_last": (True, False)}


def deterministic_json(value: Any) -> str:
    """Compact JSON with all keys sorted and arrays in their order; NaN and infinity are errors."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def canonicalize(value: Any, sentinels: dict[str, Any], path: str = "") -> Any:
    """The value with what stands under the listed dotted paths replaced, so that documents compare without it."""
    if path in sentinels:
        return sentinels[path]
    if isinstance(value, dict):
        return {k: canonicalize(v, sentinels, f"{path}.{k}" if path else k) for k, v in value.items()}
    return [canonicalize(v, sentinels, f"{path}[]") for v in value] if isinstance(value, list) else value


def digests(data: bytes) -> dict[str, str]:
    return {"blake3": digest(data).hex(), "sha256": hashlib.sha256(data).hexdigest()}


def _digest_map(found: dict[str, str]) -> dict[str, str]:
    for name, value in found.items():
        if len(value) != 64 or set(value) - set("0123456789abcdef"):
            raise ValueError(f"{name} must be 64 lower-case hex digits")
    return found


def statement(name: str, digest_map: dict[str, str], predicate_type: str, predicate: dict[str, Any]) -> dict[str, Any]:
    if not name or not digest_map or not predicate_type:
        raise ValueError("a statement needs a named subject with a digest and a predicate type")
    return {"_type": STATEMENT_TYPE, "subject": [{"name": name, "digest": _digest_map(digest_map)}], "predicateType": predicate_type, "predicate": predicate}


def inclusion_predicate(corpus: dict[str, Any], leaf_index: int, tree_size: int, path: list[str], matched_by: str, confidence: float) -> dict[str, Any]:
    if not 0 <= leaf_index < tree_size:
        raise ValueError("the leaf lies outside the tree")
    if not 0 <= confidence <= 1:
        raise ValueError("confidence must be between 0 and 1")
    return {"corpus": corpus, "leafIndex": leaf_index, "treeSize": tree_size, "auditPath": path, "match": {"kind": matched_by, "confidence": confidence}}


def non_inclusion_predicate(corpus: dict[str, Any], target: str, boundary: str, before: dict[str, Any] | None, after: dict[str, Any] | None) -> dict[str, Any]:
    """The neighbours must be the ones that the boundary case calls for, next to each other and around the target."""
    if boundary not in BOUNDARIES or (before is not None, after is not None) != BOUNDARIES[boundary]:
        raise ValueError("the neighbours do not fit the boundary case")
    if before and not before["document_id"] < target or after and not target < after["document_id"]:
        raise ValueError("the target does not lie between its neighbours")
    if before and after and after["leafIndex"] != before["leafIndex"] + 1:
        raise ValueError("the neighbours are not adjacent")
    return {"corpus": corpus, "target": target, "boundaryCase": boundary, "predecessor": before, "successor": after}


def corpus_predicate(totals: dict[str, int], root: str, coverage: list[dict[str, Any]], licences: list[dict[str, Any]]) -> dict[str, Any]:
    return {
        "merkleRoot": root, "leafCount": totals["documents"], "totalBytes": totals["total_bytes"],
        "signalCoverage": {c["signal"]: c["coverage_ppm"] for c in coverage}, "licenseInventory": sorted(licences, key=lambda x: x["license_spdx"]),
    }


def binding_predicate(model: dict[str, str], attestations: list[dict[str, Any]]) -> dict[str, Any]:
    if not attestations:
        raise ValueError("a model is bound to at least one corpus")
    return {"model": _digest_map(model), "corpora": attestations}


def statement_digest(statement_: dict[str, Any]) -> dict[str, str]:
    """Digests of a statement's canonical JSON."""
    return digests(deterministic_json(statement_).encode())


def statement_of_bundle(bundle: dict[str, Any]) -> dict[str, Any]:
    """The statement inside a signed envelope."""
    return json.loads(base64.b64decode(bundle["dsseEnvelope"]["payload"]))


def pre_authentication_encoding(kind: str, payload: bytes) -> bytes:
    return b" ".join([b"DSSEv1", str(len(kind)).encode(), kind.encode(), str(len(payload)).encode(), payload])


def rfc3339(epoch: int) -> str:
    return datetime.datetime.fromtimestamp(epoch, datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def markdown_table(rows: list[dict[str, Any]], columns: list[str]) -> str:
    """Rows of a small report as a table."""
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(str(r.get(c, "")) for c in columns) + " |" for r in rows]) + "\n"


def croissant(name: str, totals: dict[str, int], root: str, licences: list[dict[str, Any]], url: str) -> dict[str, Any]:
    """Dataset description in the Croissant vocabulary."""
    return {
        "@context": {"@vocab": "https://schema.org/", "cr": "http://mlcommons.org/croissant/"}, "@type": "Dataset", "name": name, "url": url, "license": [x["license_spdx"] for x in licences],
        "distribution": [{"@type": "cr:FileObject", "name": "manifest", "encodingFormat": "application/vnd.apache.parquet", "contentSize": f"{totals['total_bytes']} B", "identifier": root}],
    }


def cyclonedx(name: str, totals: dict[str, int], root: str, epoch: int) -> dict[str, Any]:
    """Bill of materials with the corpus as one data component."""
    return {
        "bomFormat": "CycloneDX", "specVersion": "1.6", "version": 1, "metadata": {"timestamp": rfc3339(epoch)},
        "components": [{"type": "data", "name": name, "properties": [{"name": "merkleRoot", "value": root}, {"name": "documents", "value": str(totals["documents"])}]}],
    }


def dataset_card(name: str, totals: dict[str, int], root: str, size: str, composition: list[dict[str, Any]]) -> str:
    head = f"---\nsize_categories:\n- {size}\n---\n\n# {name}\n\nMerkle root: `{root}`\n\n"
    return head + markdown_table([totals], list(totals)) + "\n" + markdown_table(composition, ["dimension", "label", "documents", "bytes"])
