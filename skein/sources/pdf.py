"""Plain text of PDF files: the strings that content streams show, page by page. A parser with layout is the caller's; this is what
stands where there is none."""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]+>|\b(?:Tj|TJ|Td|TD|T\*|Tm|ET)\b|['\"](?=\s)", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1].strip() == b"" else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")


def page_text(content: bytes) -> str:
    """The text that a page's content shows; moves to another line are line ends."""
    out, pending = [], []
    for m in _SHOWN.finditer(content):
        token = m[0]
        if token[:1] in (b"(", b"<"):
            pending.append(_string(token))
        elif token in (b"Tj", b"TJ", b"'", b'"'):
            out.append(("\n" if token in (b"'", b'"') else "") + "".join(pending))
            pending = []
        else:
            out.append("\n")
            pending = []
    return re.sub(r"\n+", "\n", "".join(out)).strip("\n")


def pdf_pages(data: bytes) -> list[str]:
    """Text of each page in the order of the file; pages without text are empty. What is no PDF has no pages."""
    if data[:5] != b"%PDF-":
        return []
    streams, pages = {}, []
    for number, body in _OBJECT.findall(data):
        if m := _STREAM.search(body):
            raw = m[1]
            if b"/FlateDecode" in body[: m.start()]:
                try:
                    raw = zlib.decompressobj().decompress(raw)
                except zlib.error:
                    raw = b""
            streams[int(number)] = raw
        elif re.search(rb"/Type\s*/Page\b(?!s)", body):
            refs = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
            pages.append([int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", refs[1])] if refs else [])
    return [page_text(b"\n".join(streams.get(n, b"") for n in ns)) for ns in pages]


def uploads(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Uploaded files: path, document_hash of the bytes, content. PDF files give their pages, each followed by a line end; all others
    are decoded as UTF-8 with replacement."""

    @F.pandas_udf("string")
    def text(data: pd.Series) -> pd.Series:
        return data.map(lambda b: "".join(p + "\n" for p in pdf_pages(b)))

    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    is_pdf = F.lower("path").endswith(".pdf")
    plain = F.make_valid_utf8(F.col("content").cast("string"))
    cols = lambda df, c: df.select("path", F.sha2("content", 256).alias("document_hash"), "length", c.alias("content"))
    return cols(raw.where(~is_pdf), plain).unionByName(cols(raw.where(is_pdf), text("content")))
