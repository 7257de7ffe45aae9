"""Word documents (.docx) as tables of runs, paragraphs, table rows, sections and XML markers."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SCHEMA = "path string, kind string, item int, sub int, text string, font string, size string, bold boolean, numbered boolean, width_cm double, height_cm double, margins_cm array<double>"
_CM = 2.54 / 1440  # a twentieth of a point


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(_W + "t"))


def _on(node) -> bool:
    return node is not None and node.get(_W + "val", "true") not in ("0", "false")


def parse(path: str, raw: bytes) -> list[dict]:
    """Rows of one document: kinds paragraph, run, row (cells joined by ' | '), section and marker (item: count)."""
    archive = zipfile.ZipFile(io.BytesIO(raw))
    xml = archive.read("word/document.xml").decode(errors="replace")
    body = ElementTree.fromstring(xml).find(_W + "body")
    out = []

    def add(kind: str, item: int, sub: int = 0, **more) -> None:
        out.append(dict.fromkeys(("text", "font", "size", "bold", "numbered", "width_cm", "height_cm", "margins_cm")) | {"path": path, "kind": kind, "item": item, "sub": sub} | more)

    for i, p in enumerate(body.findall(_W + "p")):
        add("paragraph", i, text=_text(p), numbered=p.find(f"{_W}pPr/{_W}numPr") is not None)
        for k, r in enumerate(p.findall(_W + "r")):
            fonts, size = r.find(f"{_W}rPr/{_W}rFonts"), r.find(f"{_W}rPr/{_W}sz")
            font = None if fonts is None else fonts.get(_W + "ascii") or fonts.get(_W + "eastAsia")
            add("run", i, k, text=_text(r), font=font or "(style/default)", size=str(int(size.get(_W + "val")) / 2) if size is not None else "(style/default)", bold=_on(r.find(f"{_W}rPr/{_W}b")))
    for i, t in enumerate(body.findall(_W + "tbl")):
        for k, row in enumerate(t.findall(_W + "tr")):
            cells = ["\n".join(_text(p) for p in c.findall(_W + "p")) for c in row.findall(_W + "tc")]
            add("row", i, k, text=" | ".join(c.replace("\n", " / ")[:250] for c in cells))
    for i, s in enumerate(body.iter(_W + "sectPr")):
        size, margin = s.find(_W + "pgSz"), s.find(_W + "pgMar")
        cm = lambda n, k: round(int(n.get(_W + k, 0)) * _CM, 2) if n is not None else None
        add("section", i, width_cm=cm(size, "w"), height_cm=cm(size, "h"), margins_cm=[cm(margin, k) for k in ("top", "right", "bottom", "left", "header", "footer")] if margin is not None else None)
    low = xml.lower()
    for name, n in (("fields", xml.count("w:instrText")), ("zotero", low.count("zotero")), ("mendeley", low.count("mendeley")), ("insertions", xml.count("<w:ins")), ("deletions", xml.count("<w:del")), ("comments_part", int("word/comments.xml" in archive.namelist()))):
        add("marker", n, text=name)
    return out


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """All .docx files under ``path``; runs feed ``texts.weighted_counts``, paragraphs the other text audits."""

    def run(batches):
        import pandas as pd

        for b in batches:
            for p, raw in zip(b["path"], b["content"], strict=True):
                yield pd.DataFrame(parse(p, raw), columns=[f.split()[0] for f in SCHEMA.split(", ")])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def document(paragraphs: list[list[tuple[str, str | None]]]) -> bytes:
    """A .docx file of paragraphs, each a list of runs (text, font or None). Characters that XML can't hold are left out."""
    from xml.sax.saxutils import escape, quoteattr

    def clean(text: str) -> str:
        return escape("".join(c for c in text if c in "\t\n\r" or " " <= c <= "\ud7ff" or "\ue000" <= c <= "\ufffd" or c > "\uffff"))

    def run(text: str, font: str | None) -> str:
        look = f"<w:rPr><w:rFonts w:ascii={quoteattr(font)}/></w:rPr>" if font else ""
        return f'<w:r>{look}<w:t xml:space="preserve">{clean(text)}</w:t></w:r>'

    body = "".join(f"<w:p>{''.join(run(*r) for r in p)}</w:p>" for p in paragraphs)
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_W[1:-1]}"><w:body>{body}</w:body></w:document>')
    return raw.getvalue()
