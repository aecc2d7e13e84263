"""Readers of Turtle and RDF/XML files, one file a row, to triples (``s``, ``p``, ``o``, ``literal``).

Turtle: prefixes and base, ``a``, lists with ``;`` and ``,``, labelled and anonymous blank nodes, collections, literals with
language or type, long strings, numbers and booleans. Names stay as written in the file where their prefix isn't
known. RDF/XML: descriptions and typed nodes with ``about``, ``ID`` or ``nodeID``, nested nodes, ``resource``
and ``parseType="Collection"``. A file that can't be read so raises an error that names it; an empty file has no
triples.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
SCHEMA = "s string, p string, o string, literal boolean"
_TOKEN = re.compile(
    r"""(?P<comment>\#[^\n]*)|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<long>\"{3}(?:[^"\\]|\\.|"(?!""))*\"{3})|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
    r"""|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)|(?P<number>[+-]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?(?![\w:]))|(?P<blank>_:[\w.-]*[\w-])"""
    r"""|(?P<name>[\w.-]*:(?:[\w:%-]|\.(?=[\w:%-]))*|[A-Za-z]+)|(?P<mark>[.;,\[\]()])""",
    re.S,
)


class Turtle:
    """One document."""

    def __init__(self, text: str, name: str):
        self.tokens = [(m.lastgroup, m.group()) for m in self._scan(text, name) if m.lastgroup != "comment"]
        self.at, self.prefixes, self.base, self.out, self.blanks, self.name = 0, {}, "", [], 0, name

    @staticmethod
    def _scan(text, name):
        at = 0
        while at < len(text):
            if text[at].isspace():
                at += 1
                continue
            m = _TOKEN.match(text, at)
            if m is None:
                raise ValueError(f"{name}: can't read at character {at}")
            yield m
            at = m.end()

    def next(self):
        if self.at >= len(self.tokens):
            raise ValueError(f"{self.name}: ends in the middle of a statement")
        self.at += 1
        return self.tokens[self.at - 1]

    def see(self, mark: str) -> bool:
        if self.at < len(self.tokens) and self.tokens[self.at] == ("mark", mark):
            self.at += 1
            return True
        return False

    def fresh(self) -> str:
        self.blanks += 1
        return f"_:{self.name}.{self.blanks}"

    def full(self, kind: str, value: str) -> str:
        if kind == "iri":
            return value[1:-1] if ":" in value else self.base + value[1:-1]
        if kind == "blank":
            return f"_:{self.name}.{value[2:]}"
        if value == "a":
            return RDF + "type"
        prefix, _, local = value.partition(":")
        return self.prefixes.get(prefix, prefix + ":") + local

    def node(self) -> tuple[str, bool]:
        kind, value = self.next()
        if kind in ("string", "long"):
            raw = value[3:-3] if kind == "long" else value[1:-1]
            text = re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), raw, flags=re.S)
            if self.at < len(self.tokens) and self.tokens[self.at][0] == "lang":
                self.at += 1
            elif self.at < len(self.tokens) and self.tokens[self.at][0] == "type":
                self.at += 2
            return text, True
        if kind == "number" or value in ("true", "false"):
            return value, True
        if (kind, value) == ("mark", "["):
            own = self.fresh()
            if not self.see("]"):
                self.facts(own)
                if not self.see("]"):
                    raise ValueError(f"{self.name}: a bracket isn't closed")
            return own, False
        if (kind, value) == ("mark", "("):
            first, last = RDF + "nil", None
            while not self.see(")"):
                cell = self.fresh()
                self.out.append((cell, RDF + "first", *self.node()))
                if last is None:
                    first = cell
                else:
                    self.out.append((last, RDF + "rest", cell, False))
                last = cell
            if last is not None:
                self.out.append((last, RDF + "rest", RDF + "nil", False))
            return first, False
        if kind in ("iri", "name", "blank"):
            return self.full(kind, value), False
        raise ValueError(f"{self.name}: {value!r} stands where a node should")

    def facts(self, s: str) -> None:
        while True:
            p = self.node()[0]
            while True:
                self.out.append((s, p, *self.node()))
                if not self.see(","):
                    break
            if not self.see(";"):
                return
            while self.see(";"):
                pass
            if self.at < len(self.tokens) and self.tokens[self.at] in (("mark", "."), ("mark", "]")):
                return

    def triples(self) -> list[tuple]:
        while self.at < len(self.tokens):
            kind, value = self.tokens[self.at]
            if value in ("@prefix", "@base") or value.upper() in ("PREFIX", "BASE"):
                self.at += 1
                if value.lower().endswith("prefix"):
                    prefix = self.next()[1].rstrip(":")
                    self.prefixes[prefix] = self.next()[1][1:-1]
                else:
                    self.base = self.next()[1][1:-1]
                self.see(".")
                continue
            s = self.node()[0]
            if (kind, value) != ("mark", "[") or not self.see("."):
                self.facts(s)
                if not self.see("."):
                    raise ValueError(f"{self.name}: a statement doesn't end")
        return self.out


def rdf_xml(text: str, name: str) -> list[tuple]:
    out, count = [], 0

    def fresh():
        nonlocal count
        count += 1
        return f"_:{name}.x{count}"

    def bare(tag):
        return tag[1:].replace("}", "") if tag.startswith("{") else tag

    def node(e) -> str:
        get = lambda k: e.get(f"{{{RDF}}}{k}")
        s = get("about") or (get("ID") and "#" + get("ID")) or (get("nodeID") and f"_:{name}.{get('nodeID')}") or fresh()
        if bare(e.tag) != RDF + "Description":
            out.append((s, RDF + "type", bare(e.tag), False))
        out.extend((s, bare(k), v, True) for k, v in e.attrib.items() if not k.startswith(f"{{{RDF}}}") and k.startswith("{") and "XML/1998" not in k)
        for c in e:
            p, at = bare(c.tag), (lambda k, c=c: c.get(f"{{{RDF}}}{k}"))
            if at("resource") is not None:
                out.append((s, p, at("resource"), False))
            elif at("nodeID") is not None:
                out.append((s, p, f"_:{name}.{at('nodeID')}", False))
            elif at("parseType") == "Collection":
                cells = [fresh() for _ in c]
                out.append((s, p, cells[0] if cells else RDF + "nil", False))
                for i, x in enumerate(c):
                    out.append((cells[i], RDF + "first", node(x), False))
                    out.append((cells[i], RDF + "rest", cells[i + 1] if i + 1 < len(cells) else RDF + "nil", False))
            elif len(c):
                out.append((s, p, node(c[0]), False))
            else:
                out.append((s, p, c.text or "", True))
        return s

    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        raise ValueError(f"{name}: {e}") from e
    for e in root if bare(root.tag) == RDF + "RDF" else [root]:
        node(e)
    return out


def graph(spark: SparkSession, path: str) -> DataFrame:
    """Distinct triples of the ``.ttl``, ``.nt``, ``.rdf``, ``.owl`` and ``.xml`` files at a path."""

    def run(frames):
        for pdf in frames:
            for file, text in zip(pdf["file"], pdf["text"], strict=True):
                if text.strip():
                    name = re.sub(r"\W", "_", file)
                    rows = rdf_xml(text, name) if text.lstrip().startswith("<?xml") or file.endswith((".rdf", ".owl", ".xml")) else Turtle(text, name).triples()
                    yield pd.DataFrame(rows, columns=["s", "p", "o", "literal"])

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    return files.mapInPandas(run, SCHEMA).distinct()


def shortened(triples: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """Triples with namespaces as short prefixes (``{"rdf:": "http://..."}``)."""
    def short(c):
        out = F.col(c)
        for prefix, space in prefixes.items():
            out = F.when(F.startswith(F.col(c), F.lit(space)), F.concat(F.lit(prefix), F.substring(F.col(c), F.lit(len(space) + 1), F.length(c)))).otherwise(out)
        return out

    return triples.select(short("s").alias("s"), short("p").alias("p"), F.when(F.col("literal"), F.col("o")).otherwise(short("o")).alias("o"), "literal")
