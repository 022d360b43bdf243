"""HTML, JSON and office files as elements, parsed with the standard library in Arrow batches.

Office files are zip archives of XML. PDF and raster images need libraries that are not here: their elements come in as a
table (see sidecar.py).
"""

import io
import json
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tags that end a block of text. Fixed values.
BLOCK_TAGS = {"p", "div", "li", "ul", "ol", "table", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "br", "body", "title", "nav", "blockquote", "pre"}
SILENT = {"script", "style"}
FANCY = str.maketrans({"\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"', "\u00a0": " "})


def tidy(text) -> str:
    return re.sub(r"\s+", " ", str(text).translate(FANCY)).strip()


class Blocks(HTMLParser):
    """Collects the text between block tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.parts, self.quiet = [], [], 0

    def flush(self):
        text = re.sub(r"\s+([.,;:])", r"\1", tidy("".join(self.parts)))
        if text:
            self.blocks.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        self.quiet += tag in SILENT
        if tag in BLOCK_TAGS:
            self.flush()

    def handle_endtag(self, tag):
        if tag in SILENT and self.quiet:
            self.quiet -= 1
        if tag in BLOCK_TAGS:
            self.flush()

    def handle_data(self, data):
        if not self.quiet:
            self.parts.append(data)


def blocks_of(html: str | None) -> list[str]:
    parser = Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.blocks


def html_blocks(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, el_ord, text): a row for each block."""

    @F.pandas_udf("array<string>")
    def split(html: pd.Series) -> pd.Series:
        return html.map(blocks_of)

    return pages.select(F.col(id_col), F.posexplode(split(F.col(html_col))).alias("el_ord", "text"))


def leaves_of(value, path: str = "") -> list[dict]:
    """Leaves of nested objects; lists are leaves."""
    if isinstance(value, dict):
        return [leaf for k, v in value.items() for leaf in leaves_of(v, f"{path}.{k}" if path else k)]
    return [{"json_path": path, "value": None if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False), "text": f"{path} = {json.dumps(value, ensure_ascii=False)}"}]


def json_leaves(rows: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, el_ord, json_path, value, text) of objects of any depth."""

    @F.pandas_udf("array<struct<json_path: string, value: string, text: string>>")
    def split(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [] if x is None else leaves_of(json.loads(x)))

    return rows.select(F.col(id_col), F.posexplode(split(F.col(json_col))).alias("el_ord", "leaf")).select(id_col, "el_ord", "leaf.*")


def _texts(node, tag: str) -> str:
    return "".join(x.text or "" for x in node.iter() if x.tag.endswith(tag))


def docx_elements(data: bytes) -> list[dict]:
    """Paragraphs, then table rows without each table's first."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    body = next(x for x in root if x.tag.endswith("}body"))
    out = [{"kind": "paragraph", "text": t, "cell_list": None} for p in body if p.tag.endswith("}p") and (t := tidy(_texts(p, "}t")))]
    for table in (x for x in body if x.tag.endswith("}tbl")):
        rows = [[tidy(_texts(c, "}t")) for c in r if c.tag.endswith("}tc")] for r in table if r.tag.endswith("}tr")]
        out += [{"kind": "row", "text": " | ".join(r), "cell_list": r} for r in rows[1:]]
    return out


def pptx_elements(data: bytes) -> list[dict]:
    """Text frames and table rows (without each table's first) of slides in order."""
    z = zipfile.ZipFile(io.BytesIO(data))
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
    out = []
    for i, name in enumerate(slides, 1):
        root = ElementTree.fromstring(z.read(name))
        for shape in root.iter():
            if shape.tag.endswith("}sp") and (t := tidy(" ".join(_texts(p, "}t") for p in shape.iter() if p.tag.endswith("}p")))):
                out.append({"kind": "slide_text", "text": t, "cell_list": None, "slide": i})
            elif shape.tag.endswith("}tbl"):
                rows = [[tidy(_texts(c, "}t")) for c in r if c.tag.endswith("}tc")] for r in shape if r.tag.endswith("}tr")]
                out += [{"kind": "row", "text": " | ".join(r), "cell_list": r, "slide": i} for r in rows[1:]]
    return out


def xlsx_elements(data: bytes) -> list[dict]:
    """Rows below the header of each sheet, all values text."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = [_texts(x, "}t") for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
    out = []
    for name in sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
        rows = []
        for r in (x for x in ElementTree.fromstring(z.read(name)).iter() if x.tag.endswith("}row")):
            cells = {}
            for c in r:
                column = re.sub(r"\d", "", c.get("r", ""))
                v = next((x.text or "" for x in c if x.tag.endswith("}v")), "")
                cells[column] = tidy(shared[int(v)] if c.get("t") == "s" and v else _texts(c, "}t") if c.get("t") == "inlineStr" else v)
            rows.append(cells)
        if rows:
            header = rows[0]
            for r in rows[1:]:
                named = {h: r.get(col, "") for col, h in header.items() if h}
                out.append({"kind": "row", "text": " | ".join(f"{h}: {v}" for h, v in named.items()), "cells": named})
    return out


READERS = {"docx": docx_elements, "pptx": pptx_elements, "xlsx": xlsx_elements}


def office_elements(files: DataFrame) -> DataFrame:
    """(doc_id, el_ord, kind, text, slide, cells, cell_list) of .docx, .pptx and .xlsx files (doc_id, content)."""
    schema = "doc_id string, el_ord long, kind string, text string, slide int, cells map<string,string>, cell_list array<string>"

    def run(batches):
        for pdf in batches:
            rows = []
            for doc, content in zip(pdf["doc_id"], pdf["content"]):
                for i, e in enumerate(READERS[doc.rsplit(".", 1)[-1].lower()](bytes(content))):
                    rows.append((doc, i, e["kind"], e["text"], e.get("slide"), e.get("cells"), e.get("cell_list")))
            yield pd.DataFrame(rows, columns=["doc_id", "el_ord", "kind", "text", "slide", "cells", "cell_list"]).astype({"slide": "Int32"})

    return files.filter(F.lower("doc_id").rlike(r"\.(docx|pptx|xlsx)$")).select("doc_id", "content").mapInPandas(run, schema)
