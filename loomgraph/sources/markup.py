"""XML and XAML files as records: attributes for the rule language, and the types that markup uses.

Files are parsed whole, one at a time, on the executors; a file that cannot be parsed gives no rows.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from io import StringIO

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The namespace of x:Class, and the forms of references to types in attribute values.
XAML = "http://schemas.microsoft.com/winfx/2006/xaml"
_NAME = r"[A-Za-z_][A-Za-z0-9_]*"
_STATIC = re.compile(rf"\{{x:Static\s+({_NAME}:{_NAME})(?:\.{_NAME})?\}}")
_TYPE = re.compile(rf"\{{x:Type\s+({_NAME}:{_NAME})\}}")


def _local(name: str) -> str:
    return name.rpartition("}")[2]


def _space(name: str) -> str:
    return name[1:].partition("}")[0] if name.startswith("{") else ""


def _file(path: str) -> str:
    return re.split(r"[/\\]", path)[-1]


def _parsed(text: str) -> tuple[ET.Element, dict[str, str]] | None:
    """The root and the prefixes that it declares; None if the text is no XML."""
    prefixes: dict[str, str] = {}
    root = None
    try:
        for event, item in ET.iterparse(StringIO((text or "").lstrip("﻿")), ("start-ns", "start")):
            if event == "start":
                root = item if root is None else root
            elif root is None:
                prefixes[item[0]] = item[1]
    except (ET.ParseError, ValueError):
        return None
    return None if root is None else (root, prefixes)


def attribute_records(files: DataFrame) -> DataFrame:
    """(source_type, rec) for each attribute of each element of (file_path, text), as the rule language reads them.

    The class of a document is its root's attribute named Class, in whatever namespace; its key is always there, with null
    where there is none.  Declarations of namespaces are no attributes.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = []
            for path, text in zip(df["file_path"], df["text"]):
                found = _parsed(text)
                if found is None:
                    continue
                root = found[0]
                owner = next((v for k, v in root.attrib.items() if _local(k) == "Class"), None)
                for e in root.iter():
                    for k, v in e.attrib.items():
                        fqn = f"xaml::{owner or _file(path)}::{_local(e.tag)}::{_local(k)}"
                        rows.append((_local(k), v, path, owner, _local(e.tag), fqn))
            yield pd.DataFrame(rows, columns=["name", "value", "path", "owner", "element", "fqn"])

    got = files.select("file_path", "text").mapInPandas(run, "name string, value string, path string, owner string, element string, fqn string")
    cells = {"name": "name", "value": "value", "document.path": "path", "document.x_class": "owner", "element.name": "element", "fqn": "fqn"}
    return got.select(F.lit("xml_attribute").alias("source_type"), F.create_map(*[x for k, c in cells.items() for x in (F.lit(k), F.col(c))]).alias("rec"))


def _mapped(prefixes: dict[str, str]) -> dict[str, str]:
    """The program namespace of each prefix that declares one."""
    out = {}
    for prefix, uri in prefixes.items():
        for start in ("clr-namespace:", "using:"):
            if uri.startswith(start):
                out[prefix] = uri[len(start) :].split(";")[0].strip()
    return {k: v for k, v in out.items() if v}


def _reference(text: str, spaces: dict[str, str]) -> str | None:
    prefix, _, name = text.partition(":")
    return f"{spaces[prefix]}.{name}" if prefix in spaces and name.strip() and "." not in name else None


def type_references(name: str, value: str, spaces: dict[str, str]) -> str | None:
    """The type that an attribute's value refers to: by a static member, by its type, or as a data type."""
    value = value.strip()
    for pattern in (_STATIC, _TYPE):
        m = pattern.fullmatch(value)
        if m and (found := _reference(m[1], spaces)):
            return found
    return _reference(value, spaces) if name.lower().endswith("datatype") else None


def documents(files: DataFrame) -> DataFrame:
    """(file_path, x_class, fqn, target, type) of (file_path, text): a row for the class behind each XAML document
    (xaml_codebehind) and one for each use of a type in it (xaml_type_usage).  A document without x:Class has none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = []
            for path, text in zip(df["file_path"], df["text"]):
                found = _parsed(text)
                if found is None:
                    continue
                root, prefixes = found
                owner = next((v for k, v in root.attrib.items() if _local(k) == "Class" and _space(k) == XAML), None)
                if not (owner or "").strip():
                    continue
                fqn, spaces = f"xaml::{owner}::{_file(path)}", _mapped(prefixes)
                by_uri = {uri: spaces[p] for p, uri in prefixes.items() if p in spaces}
                rows.append((path, owner, fqn, owner, "xaml_codebehind"))
                for e in root.iter():
                    tag = _local(e.tag)
                    if _space(e.tag) in by_uri and "." not in tag:
                        rows.append((path, owner, fqn, f"{by_uri[_space(e.tag)]}.{tag}", "xaml_type_usage"))
                    for k, v in e.attrib.items():
                        if target := type_references(_local(k), v, spaces):
                            rows.append((path, owner, fqn, target, "xaml_type_usage"))
            yield pd.DataFrame(rows, columns=["file_path", "x_class", "fqn", "target", "type"])

    return files.select("file_path", "text").mapInPandas(run, "file_path string, x_class string, fqn string, target string, type string")


def symbols(found: DataFrame) -> DataFrame:
    """The symbol of each document of `documents`."""
    one = found.where("type = 'xaml_codebehind'").dropDuplicates(["fqn"])
    return one.select("fqn", F.substring_index("fqn", "::", -1).alias("name"), F.lit("xaml").alias("kind"), F.col("x_class").alias("containing_type"), "file_path", F.lower("fqn").alias("__low")).withColumn("id", F.sha2("__low", 256)).drop("__low")


def attribute_pairs(pages: DataFrame) -> DataFrame:
    """(page_id, ordinal, attribute, value) of name="value" pairs in markup that need not be well-formed."""
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('[A-Za-z:-]+="[^"]*"'), F.lit(0))).alias("ordinal", "pair"))
    return found.select("page_id", "ordinal", F.substring_index("pair", "=", 1).alias("attribute"), F.expr("substr(pair, instr(pair, '=') + 2, length(pair) - instr(pair, '=') - 2)").alias("value"))
