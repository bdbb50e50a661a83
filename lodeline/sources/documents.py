"""Parsers of document files on the standard library: one file in, one record out, and never an exception.

PDF and old binary spreadsheets need libraries that aren't at hand; they come out as ``unsupported``.
"""

from __future__ import annotations

import io
import os
import re
import struct
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree as E

Record = tuple[str, str, str, str | None, str, int, str | None]

# XML names of the office formats.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
X = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
TITLE = "{http://purl.org/dc/elements/1.1/}title"


class _Html(HTMLParser):
    SKIP = frozenset(("script", "style", "noscript", "template"))
    BLOCK = frozenset(("p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "table", "ul", "ol", "section", "article"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.title: list[str] = []
        self.deep, self.in_title, self.tables = 0, False, 0

    def handle_starttag(self, tag, attrs):
        self.deep += tag in self.SKIP
        self.in_title = self.in_title or tag == "title"
        self.tables += tag == "table"
        if tag in self.BLOCK:
            self.out.append("\n")
        elif tag in ("td", "th"):
            self.out.append(" | ")

    def handle_endtag(self, tag):
        self.deep = max(0, self.deep - (tag in self.SKIP))
        if tag == "title":
            self.in_title = False
        if tag in self.BLOCK:
            self.out.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.deep:
            self.out.append(data)


def html_text(source: str) -> tuple[str, str | None, int]:
    """Visible text of a page, its title, and how many tables it has."""
    p = _Html()
    p.feed(source)
    p.close()
    lines = (re.sub(r"\s+", " ", x).strip(" |") for x in "".join(p.out).split("\n"))
    return "\n".join(x for x in lines if x), " ".join("".join(p.title).split()) or None, p.tables


def _office_title(z: zipfile.ZipFile) -> str | None:
    if "docProps/core.xml" not in z.namelist():
        return None
    t = E.fromstring(z.read("docProps/core.xml")).find(f".//{TITLE}")
    return (t.text or "").strip() or None if t is not None else None


def docx(content: bytes) -> tuple[str, str | None, int]:
    """Paragraphs in order, table rows as cells with bars."""
    z = zipfile.ZipFile(io.BytesIO(content))
    body = E.fromstring(z.read("word/document.xml")).find(f"{W}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{W}t"))
    out, tables = [], 0
    for e in body if body is not None else ():
        if e.tag == f"{W}p":
            out.append(text(e))
        elif e.tag == f"{W}tbl":
            tables += 1
            out += [" | ".join(text(c) for c in row.iter(f"{W}tc")) for row in e.iter(f"{W}tr")]
    return "\n".join(x for x in out if x.strip()), _office_title(z), tables


def pptx(content: bytes) -> tuple[str, str | None, int]:
    """Slides with their notes, each under a marker."""
    z = zipfile.ZipFile(io.BytesIO(content))
    out, tables = [], 0
    n = lambda x: int(re.search(r"(\d+)\.xml$", x).group(1))
    for name in sorted((x for x in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", x)), key=n):
        root = E.fromstring(z.read(name))
        tables += sum(1 for _ in root.iter(f"{A}tbl"))
        out.append(f"--- SLIDE {n(name)} ---")
        out += [t for p in root.iter(f"{A}p") if (t := "".join(x.text or "" for x in p.iter(f"{A}t")).strip())]
        notes = f"ppt/notesSlides/notesSlide{n(name)}.xml"
        if notes in z.namelist():
            out += [t for p in E.fromstring(z.read(notes)).iter(f"{A}p") if (t := "".join(x.text or "" for x in p.iter(f"{A}t")).strip())]
    return "\n".join(out), _office_title(z), tables


def xlsx_rows(content: bytes) -> list[tuple[str, int, list[str]]]:
    """(sheet, row number, cells) of a workbook; whole numbers without a fraction part."""
    z = zipfile.ZipFile(io.BytesIO(content))
    names = z.namelist()
    shared = ["".join(t.text or "" for t in s.iter(f"{X}t")) for s in E.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{X}si")] if "xl/sharedStrings.xml" in names else []
    sheets = [s.get("name") or "" for s in E.fromstring(z.read("xl/workbook.xml")).iter(f"{X}sheet")]
    n = lambda x: int(re.search(r"(\d+)\.xml$", x).group(1))
    out = []
    for i, name in enumerate(sorted((x for x in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", x)), key=n)):
        for row in E.fromstring(z.read(name)).iter(f"{X}row"):
            cells: list[str] = []
            for c in row.iter(f"{X}c"):
                at = 0
                for ch in re.match(r"[A-Z]*", c.get("r") or "").group():
                    at = at * 26 + ord(ch) - 64
                cells += [""] * (at - 1 - len(cells))
                v = c.find(f"{X}v")
                raw = (v.text or "") if v is not None else "".join(t.text or "" for t in c.iter(f"{X}t"))
                kind = c.get("t")
                cells.append(shared[int(raw)] if kind == "s" and raw else ("TRUE" if raw == "1" else "FALSE") if kind == "b" else re.sub(r"\.0+$", "", raw) if kind is None else raw)
            if any(cells):
                out.append((sheets[i] if i < len(sheets) else name, int(row.get("r") or 0), cells))
    return out


def rtf(content: bytes) -> str:
    """Text of a rich-text file: control words and groups that hold no text are left out."""
    s = content.decode("latin-1")
    s = re.sub(r"\{\\\*[^{}]*\}|\{\\(?:fonttbl|colortbl|stylesheet|info|pict)(?:[^{}]|\{[^{}]*\})*\}", "", s)
    s = re.sub(r"\\par[d]?\b ?|\\line\b ?", "\n", s)
    s = re.sub(r"\\u(-?\d+) ?\??", lambda m: chr(int(m.group(1)) % 65536), s)
    s = re.sub(r"(?:\\'[0-9a-fA-F]{2})+", lambda m: bytes.fromhex(m.group().replace("\\'", "")).decode("cp1251", "replace"), s)
    s = re.sub(r"\\[a-zA-Z]+-?\d* ?|[{}]", "", s)
    return "\n".join(x.strip() for x in s.replace("\\~", " ").split("\n") if x.strip())


def carve(content: bytes, least: int = 24) -> str:
    """Text runs of an unknown binary file under several decodings, each once, in order."""
    out: dict[str, None] = {}
    for enc, skip in (("utf-16-le", 0), ("utf-16-le", 1), ("cp1251", 0), ("cp1252", 0)):
        for run in re.findall(r"[\w\s.,;:()«»\"'%/+-]{%d,}" % least, content[skip:].decode(enc, "ignore")):
            x = " ".join(run.split())
            if len(x) < least or len(set(x)) < 8 or sum(map(str.isalnum, x)) / len(x) < 0.35:
                continue
            if max(x.count(ch) for ch in set(x)) / len(x) <= 0.35 and re.search(r"[A-Za-zА-Яа-яё]{4}", x):
                out.setdefault(x)
    return "\n".join(out)


def image(content: bytes) -> tuple[str, int, int] | None:
    """(format, width, height) of a GIF, BMP or PNG by its header."""
    if content[:6] in (b"GIF87a", b"GIF89a") and len(content) >= 10:
        return ("gif", *struct.unpack("<HH", content[6:10]))
    if content[:2] == b"BM" and len(content) >= 26:
        w, h = struct.unpack("<ii", content[18:26])
        return "bmp", w, abs(h)
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return ("png", *struct.unpack(">II", content[16:24]))
    return None


def parse(path: str, content: bytes | None) -> Record:
    """(extension, parser, status, title, text, tables, error) of one file."""
    ext = os.path.splitext(path)[1].lower()
    content = content or b""
    try:
        if (im := image(content)) is not None:
            return ext, "image", "ok", None, f"{im[0]} {im[1]}x{im[2]}", 0, None
        if ext in (".docx", ".docm"):
            text, title, n = docx(content)
        elif ext == ".pptx":
            text, title, n = pptx(content)
        elif ext == ".xlsx":
            rows = xlsx_rows(content)
            text, title, n = "\n".join(" | ".join(c) for _, _, c in rows), None, len({s for s, _, _ in rows})
        elif ext in (".html", ".htm"):
            text, title, n = html_text(content.decode("utf-8", "replace"))
        elif ext == ".rtf" or content[:5] == b"{\\rtf":
            text, title, n = rtf(content), None, 0
        elif ext == ".doc":
            text, title, n = carve(content), None, 0
        elif ext in (".txt", ".md", ".csv", ".json", ".jsonl", ".xml"):
            text, title, n = content.decode("utf-8-sig", "replace"), None, 0
        else:
            return ext, "none", "unsupported", None, "", 0, None
        return ext, ext.strip("."), "ok" if text.strip() else "empty", title, text, n, None
    except Exception as e:  # a broken file is a row, not a failed job
        return ext, ext.strip("."), "failed", None, "", 0, f"{type(e).__name__}: {e}"[:300]
