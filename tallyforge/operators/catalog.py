"""Catalog rows out of library source files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from tallyforge.session import ship_package

from tallyforge.sources.schemas import CATALOG

_DECLARATION = re.compile(
    r"(?P<module>module(?:\s*\(.*?\))?\s+(?P<module_name>\w+)\s*\{)"
    r"|(?P<type>type\s+(?P<type_name>\w+)\s+(?P<base>\w+))"
    r"|(?P<entry>(?:extern\s+)?(?P<kind>func|event)(?:\s*\((?P<header>.*?)\))?\s+(?P<entry_name>\w+)\s*\{)")
_ROWS_PER_BATCH = 10000
_DOC = re.compile(r'\s*doc\s*:\s*"([^"]*)"\s*$')


def _entries(text: str) -> Iterator[dict]:
    """Functions and events of one file with module path, types in scope and body.

    An entry's body runs from its header line to the line that brings the brace depth
    back to where it was; everything inside belongs to it.
    """
    scopes: list[tuple[str, list[str]]] = []
    entry, body, depth = None, [], 0
    for raw in text.splitlines():
        line = raw.strip()
        if entry is None:
            found = _DECLARATION.match(line)
            if found and found["module"]:
                scopes.append((found["module_name"], []))
                continue
            if found and found["type"] and scopes:
                scopes[-1][1].append(f"type {found['type_name']} {found['base']}")
                continue
            if not (found and found["entry"]):
                if line == "}" and scopes:
                    scopes.pop()
                continue
            path = ".".join(name for name, _ in scopes)
            doc = _DOC.match(found["header"] or "") if line.startswith("extern") else None
            entry = {
                "type": "function" if found["kind"] == "func" else "event",
                "function_name": f"{path}.{found['entry_name']}" if path else found["entry_name"],
                "module_path": path, "doc": doc[1] if doc else "",
                "types": "\n".join(t for _, types in scopes for t in types)}
            # The header line always opens the entry, even if it closes on the same line.
            body, depth = [raw], 1
            continue
        body.append(raw)
        depth += line.count("{") - line.count("}")
        if depth <= 0:
            yield {**entry, "body": "\n".join(body).strip()}
            entry = None
    if entry is not None:
        yield {**entry, "body": ""}


def extract_catalog(files: DataFrame) -> DataFrame:
    """Rows of all library files (columns ``path, text``); one file is the unit of work."""
    ship_package(files.sparkSession)
    columns = [c.split()[0] for c in CATALOG.split(", ")] + ["path", "position"]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: list[dict] = []
            for path, text in zip(batch["path"], batch["text"]):
                found += [{**e, "path": path, "position": i} for i, e in enumerate(_entries(text or ""), 1)]
                if len(found) >= _ROWS_PER_BATCH:
                    yield pd.DataFrame(found, columns=columns)
                    found = []
            yield pd.DataFrame(found, columns=columns)

    return files.select("path", "text").mapInPandas(rows, f"{CATALOG}, path string, position int")
