"""Files and pages to text: routing by extension, decoding, Markdown."""

from __future__ import annotations

import html as html_lib
import io
import json
import re
import zipfile
from html.parser import HTMLParser
from xml.dom import minidom
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as text_functions

#: Extensions by converter.
ROUTES = {
    "html": ["html", "htm"],
    "text": ["txt", "md", "csv", "tsv", "log", "rst"],
    "json": ["json"],
    "xml": ["xml"],
    "workbook": ["xlsx", "xlsm"],
    "code": ["py", "js", "ts", "tsx", "jsx", "java", "go", "rs", "c", "h", "cpp", "cs", "rb", "php", "swift", "kt", "scala", "sql", "sh"],
}
MOST_HTML_REPLACEMENTS = 100


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def route(name: Column, crawl_url: Column | None = None) -> Column:
    """Converter of a file; null for what none can read."""
    ext = extension(name)
    out = F.when(crawl_url.isNotNull(), "web") if crawl_url is not None else F.when(F.lit(False), "web")
    for kind, names in ROUTES.items():
        out = out.when(ext.isin(names), kind)
    return out


def supported_code(files: DataFrame, name: str = "path") -> DataFrame:
    """Code files in a language that can be chunked; those of others are left out."""
    return files.where(extension(F.col(name)).isin(ROUTES["code"]))


class _Markdown(HTMLParser):
    """Headings, lists, links, emphasis and paragraphs; scripts and styles are left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0
        self.link: str | None = None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head"):
            self.hidden += 1
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "section", "article", "table", "ul", "ol", "blockquote"):
            self.out.append("\n\n")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag in ("br", "tr"):
            self.out.append("\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag == "a":
            self.link = dict(attrs).get("href")
            self.out.append("[")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head"):
            self.hidden = max(self.hidden - 1, 0)
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag == "a":
            self.out.append(f"]({self.link})" if self.link else "]")
            self.link = None
        elif re.fullmatch("h[1-6]|p", tag):
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(re.sub(r"\s+", " ", data))


def to_markdown(source: str | None) -> str | None:
    if source is None or source.count(text_functions.REPLACEMENT) > MOST_HTML_REPLACEMENTS:
        return None
    reader = _Markdown()
    reader.feed(source)
    reader.close()
    lines = "".join(reader.out).split("\n")
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x.strip() for x in lines)).strip()


def html_to_markdown(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages with `markdown`, in Arrow batches."""

    @F.pandas_udf("string")
    def run(sources: pd.Series) -> pd.Series:
        return pd.Series([to_markdown(s) for s in sources], dtype=object)

    return pages.withColumn("markdown", run(column))


_CELL = re.compile(r"([A-Z]+)(\d+)")
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(name: str) -> int:
    out = 0
    for c in name:
        out = 26 * out + ord(c) - 64
    return out


def _sheet_rows(source: bytes, shared: list[str]) -> list[list[str]]:
    """Cells of a sheet as text, all rows as long as the longest; a formula is shown as it is written."""
    cells: dict[tuple[int, int], str] = {}
    for cell in ElementTree.fromstring(source).iter(f"{_MAIN}c"):
        place = _CELL.fullmatch(cell.get("r", ""))
        formula, value = cell.findtext(f"{_MAIN}f"), cell.findtext(f"{_MAIN}v")
        if cell.get("t") == "inlineStr":
            value = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
        elif cell.get("t") == "s" and value is not None:
            value = shared[int(value)]
        elif cell.get("t") == "b" and value is not None:
            value = "True" if value == "1" else "False"
        if place is not None and (formula or value):
            cells[int(place[2]), _column(place[1])] = f"={formula}" if formula else value
    if not cells:
        return []
    height, width = max(r for r, _ in cells), max(c for _, c in cells)
    return [[cells.get((r, c), "") for c in range(1, width + 1)] for r in range(1, height + 1)]


def workbook_to_markdown(content: bytes) -> str | None:
    """A heading and a table for each sheet of an .xlsx file, a list for a sheet of one row; null if there is nothing."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in x.iter(f"{_MAIN}t")) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        targets = {x.get("Id"): x.get("Target", "") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = targets.get(sheet.get(_LINK), "").lstrip("/")
            rows = _sheet_rows(book.read(target if target.startswith("xl/") else f"xl/{target}"), shared)
            if not rows:
                continue
            out.append(f"## Sheet: {sheet.get('name')}\n")
            if len(rows) == 1:
                out += [f"- {v}" for v in rows[0] if v]
            else:
                out += [f"| {' | '.join(r)} |" for r in (rows[0], ["---"] * len(rows[0]), *rows[1:])]
            out.append("")
    return "\n".join(out) or None


def decode(content: bytes | None) -> str | None:
    """UTF-8, else a single-byte reading if it leaves few control characters, else with replacements; unreadable: null."""
    if content is None:
        return None
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        pass
    guess = content[:100_000].decode("cp1252", "replace")
    if sum(c == "�" or (ord(c) < 32 and c not in "\t\r\n") for c in guess) <= 0.01 * max(len(guess), 1):
        return content.decode("cp1252", "replace")
    found = content.decode("utf-8", "replace")
    bad = found.count("�")
    return None if bad > text_functions.MOST_REPLACEMENTS or bad > text_functions.MOST_REPLACEMENT_SHARE * len(found) else found


def convert(kind: str | None, content: bytes | None) -> str | None:
    """Text of one file by its converter; null where it fails, so that the row is skipped."""
    if content is None or kind is None:
        return None
    if kind == "workbook":
        try:
            return workbook_to_markdown(content)
        except Exception:  # noqa: BLE001  any fault of the file: the row is skipped
            return None
    if kind == "code":
        try:
            return content.decode("utf-8")
        except UnicodeDecodeError:
            return None
    found = decode(content)
    if found is None:
        return None
    if kind == "html":
        return to_markdown(found)
    if kind == "json":
        try:
            return "```json\n" + json.dumps(json.loads(found), indent=2, ensure_ascii=False) + "\n```"
        except ValueError:
            return None
    if kind == "xml":
        try:
            return "```xml\n" + minidom.parseString(found).toprettyxml(indent="  ").strip() + "\n```"
        except Exception:  # noqa: BLE001  any fault of the file: it is shown as it is
            return "```xml\n" + found + "\n```"
    return html_lib.unescape(found) if kind == "web" else found


def convert_files(files: DataFrame) -> DataFrame:
    """files (path, content) with `kind` and `text`; unsupported and failing ones are dropped.

    Plain text and code in UTF-8 are read natively; only the rest goes through Python.
    """

    @F.pandas_udf("string")
    def run(kinds: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([convert(k, c) for k, c in zip(kinds, contents, strict=True)], dtype=object)

    known = files.withColumn("kind", route(F.col("path"))).where(F.col("kind").isNotNull() & F.col("content").isNotNull())
    native = F.col("kind").isin("text", "code") & F.is_valid_utf8(F.col("content").cast("string"))
    plain = known.where(native).withColumn("text", text_functions.decoded(F.col("content")))
    others = known.where(~native).withColumn("text", run("kind", "content"))
    return plain.unionByName(others).where(F.length(F.trim("text")) > 0)
