"""Office packages to text, with the standard library only and within stated limits.

A package is checked before anything is inflated: its directory, names, sizes, overlaps and methods.
Selected XML parts are inflated up to a cap, their checksums compared, document types and entities
refused. External targets are noted and never fetched; media is noted and never inflated. A failure
raises `Failure` with a code; callers turn it into error columns.

`EXTRACTORS` maps an extension to a function (package, report) and is open to more formats, such as PDF,
for which no library is at hand here.
"""

from __future__ import annotations

import posixpath
import re
import struct
import time
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta
from urllib.parse import unquote
from xml.etree import ElementTree


@dataclass(frozen=True)
class Limits:
    file_bytes: int = 50 << 20
    text_chars: int = 100_000
    entries: int = 10_000
    expanded: int = 150 << 20
    part_bytes: int = 8 << 20
    xml_bytes: int = 32 << 20
    nodes: int = 300_000
    sheets: int = 200
    slides: int = 200
    seconds: float = 30.0


# Flag bits of a ZIP entry (encrypted in any way; sizes in a descriptor) and extra fields that are refused (64-bit sizes, encryption).
ENCRYPTED, DESCRIPTOR, REFUSED_EXTRAS = 0x2041, 0x0008, (0x0001, 0x9901)


class Failure(ValueError):
    def __init__(self, code: str) -> None:
        super().__init__(code)
        self.code = code


class Report:
    """Text sections, warnings and counts of one file."""

    def __init__(self, limits: Limits) -> None:
        self.limits, self.parts, self.size = limits, [], 0
        self.warnings: dict[str, None] = {}
        self.counts = dict.fromkeys(("slides", "pages", "sheets", "hidden", "notes", "comments"), 0)

    def warn(self, code: str) -> None:
        self.warnings[code] = None

    def section(self, label: str, text: str) -> None:
        text = re.sub(r"[ \t]+\n", "\n", text).strip("\n")
        if text.strip():
            self.parts.append(f"[{label}]\n{text}")
            self.size += len(self.parts[-1]) + 2
            if self.size > self.limits.text_chars:
                raise Failure("text_large")

    def text(self) -> str:
        return "\n\n".join(self.parts)


class Package:
    """A checked ZIP archive; parts are read on demand."""

    def __init__(self, raw: bytes, limits: Limits) -> None:
        self.raw, self.limits, self.used, self.nodes = raw, limits, 0, 0
        self.deadline = time.monotonic() + limits.seconds
        self.entries = self._directory()

    def _directory(self) -> dict[str, tuple[int, int, int, int, int]]:
        """name -> (place of the data, packed size, size, CRC, method); every claim of the directory is checked against the file."""
        end = self._end_record()
        disk, first, here, total, size, begin = struct.unpack_from("<4H2I", self.raw, end + 4)
        if disk or first or here != total or total == 0xFFFF or begin + size != end:
            raise Failure("file_archive")
        if total > self.limits.entries:
            raise Failure("file_complex")
        out, spans, expanded, at = {}, [], 0, begin
        for _ in range(total):
            self.check_time()
            if at + 46 > end or self.raw[at : at + 4] != b"PK\x01\x02":
                raise Failure("file_archive")
            flags, method, _, crc, packed, plain, n, extra, note, on_disk, _, _, local = struct.unpack_from("<2HI3I5H2I", self.raw, at + 8)
            if at + 46 + n + extra + note > end or not n or on_disk or 0xFFFFFFFF in (local, packed, plain):
                raise Failure("file_archive")
            if flags & ENCRYPTED:
                raise Failure("file_encrypted")
            name = self._name(at + 46, n)
            if name in out or method not in (0, 8) or (method == 0 and packed != plain):
                raise Failure("file_archive")
            self._extra(at + 46 + n, extra)
            expanded += plain
            if expanded > self.limits.expanded:
                raise Failure("file_expanded_large")
            data, stop = self._local(local, begin, name, flags, method, (crc, packed, plain))
            out[name] = (data, packed, plain, crc, method)
            spans.append((local, stop))
            at += 46 + n + extra + note
        spans.sort()
        if at != end or any(a[1] > b[0] for a, b in zip(spans, spans[1:], strict=False)):
            raise Failure("file_archive")
        return out

    def _end_record(self) -> int:
        """The last place of an end record whose comment ends with the file."""
        least = max(0, len(self.raw) - 65_557)
        for found in reversed([least + m.start() for m in re.finditer(b"PK\x05\x06", self.raw[least:])]):
            if found + 22 <= len(self.raw) and found + 22 + struct.unpack_from("<H", self.raw, found + 20)[0] == len(self.raw):
                return found
        raise Failure("file_archive")

    def _name(self, at: int, n: int) -> str:
        try:
            name = self.raw[at : at + n].decode()
        except UnicodeDecodeError:
            raise Failure("file_archive") from None
        if re.search(r"[\0\\:]", name) or name.startswith("/") or {".", ".."} & {*name.split("/")}:
            raise Failure("file_archive")
        return name

    def _extra(self, at: int, n: int) -> None:
        """Refuses extra fields that change sizes or encrypt, and broken ones."""
        stop = at + n
        while at < stop:
            if at + 4 > stop:
                raise Failure("file_archive")
            kind, size = struct.unpack_from("<2H", self.raw, at)
            at += 4 + size
            if kind in REFUSED_EXTRAS or at > stop:
                raise Failure("file_archive")

    def _local(self, at: int, limit: int, name: str, flags: int, method: int, facts: tuple[int, int, int]) -> tuple[int, int]:
        """(place of an entry's data, end of the entry); its local header and its descriptor must agree with the directory."""
        if at + 30 > limit or self.raw[at : at + 4] != b"PK\x03\x04":
            raise Failure("file_archive")
        own_flags, own_method, _, *own_facts, n, extra = struct.unpack_from("<2HI3I2H", self.raw, at + 6)
        data = at + 30 + n + extra
        stop = data + facts[1]
        if (own_flags, own_method) != (flags, method) or stop > limit or self._name(at + 30, n) != name:
            raise Failure("file_archive")
        self._extra(at + 30 + n, extra)
        if flags & DESCRIPTOR:
            stop += 4 if self.raw[stop : stop + 4] == b"PK\x07\x08" else 0
            if stop + 12 > limit:
                raise Failure("file_archive")
            own_facts = struct.unpack_from("<3I", self.raw, stop)
            stop += 12
        if tuple(own_facts) != facts:
            raise Failure("file_archive")
        return data, stop

    def check_time(self) -> None:
        if time.monotonic() > self.deadline:
            raise Failure("file_timeout")

    def read(self, name: str) -> bytes:
        self.check_time()
        data, packed, plain, crc, method = self.entries[name]
        body = self.raw[data : data + packed]
        if method == 8:
            tool = zlib.decompressobj(-15)
            try:
                body = tool.decompress(body, self.limits.part_bytes + 1)
            except zlib.error:
                raise Failure("file_archive") from None
        self.used += len(body)
        if len(body) > self.limits.part_bytes or self.used > self.limits.xml_bytes:
            raise Failure("file_expanded_large")
        if len(body) != plain or zlib.crc32(body) != crc:
            raise Failure("file_archive")
        return body

    def xml(self, name: str) -> ElementTree.Element | None:
        """A part's root; None if there is no such part."""
        if name not in self.entries:
            return None
        body = self.read(name)
        probe = body if b"\0" not in body[:4] else body.replace(b"\0", b"")
        if re.search(rb"<!\s*(DOCTYPE|ENTITY)", probe, re.IGNORECASE):
            raise Failure("file_xml")
        try:
            root = ElementTree.fromstring(body)
        except ElementTree.ParseError:
            raise Failure("file_xml") from None
        self.nodes += sum(1 for _ in root.iter())
        if self.nodes > self.limits.nodes:
            raise Failure("file_complex")
        return root

    def links(self, part: str, report: Report) -> list[tuple[str, str, str]]:
        """(id, kind, target part) of a part's relationships; external ones are only noted."""
        root = self.xml(posixpath.join(posixpath.dirname(part), "_rels", posixpath.basename(part) + ".rels"))
        out, seen = [], set()
        for r in root if root is not None else ():
            if not r.get("Id") or r.get("Id") in seen:
                raise Failure("file_archive")
            seen.add(r.get("Id"))
            target = unquote(r.get("Target", ""))
            if r.get("TargetMode") == "External":
                report.warn("import_external")
                continue
            if re.search(r"[?#\\]|^[a-zA-Z][a-zA-Z0-9+.-]*:", target):
                raise Failure("file_archive")
            whole = posixpath.normpath(target[1:] if target.startswith("/") else posixpath.join(posixpath.dirname(part), target))
            if whole.startswith(".."):
                raise Failure("file_archive")
            out.append((r.get("Id", ""), r.get("Type", "").rsplit("/", 1)[-1], whole))
        return out


def tag(node: ElementTree.Element) -> str:
    return node.tag.rsplit("}", 1)[-1] if isinstance(node.tag, str) else ""


def attr(node: ElementTree.Element, name: str, default: str = "") -> str:
    return next((v for k, v in node.attrib.items() if k.rsplit("}", 1)[-1] == name), default)


# Element names after which a line or a cell ends, and attributes that people write in.
LINE_AFTER = {"p", "h", "row", "tr", "annotation", "cm", "comment", "table-row"}
CELL_AFTER = {"tc", "table-cell", "c"}
SAID = ("descr", "title", "author", "userId", "email")


def walk(root: ElementTree.Element, report: Report, every_text: bool) -> str:
    """The readable text below a node, without recursion. every_text: all character data (ODF), else that of text runs."""
    out: list[str] = []
    todo: list[tuple[ElementTree.Element, bool]] = [(root, False)]
    while todo:
        node, left = todo.pop()
        name = tag(node)
        if left:
            if name in LINE_AFTER:
                out.append("\n")
            elif name in CELL_AFTER:
                out.append("\t")
            if every_text and node is not root and node.tail:
                out.append(node.tail)
            continue
        out += [attr(node, a) + "\n" for a in SAID if attr(node, a)]
        if name in ("br", "line-break"):
            out.append("\n")
        elif name == "tab":
            out.append("\t")
        elif every_text and name == "s":
            count = attr(node, "c", "1")
            if not count.isdigit() or int(count) > 10_000:
                raise Failure("file_complex")
            out.append(" " * int(count))
        for a, most in (("number-rows-repeated", 1_048_576), ("number-columns-repeated", 16_384)):
            times = attr(node, a, "1")
            if not times.isdigit() or not 1 <= int(times) <= most:
                raise Failure("file_complex")
            if int(times) > 1 and "".join(node.itertext()).strip():
                report.warn("import_repeated")
        if node.text and (every_text or name in ("t", "instrText", "delText", "text", "v", "f")):
            out.append(node.text)
        todo.append((node, True))
        todo += [(child, False) for child in reversed(node)]
    return "".join(out)


def _leftovers(package: Package, report: Report, seen: set[str], wanted: str, every_text: bool = False) -> None:
    """Parts that nothing referred to, document properties, and a note about media."""
    for name in sorted(package.entries):
        if name not in seen and re.search(wanted, name):
            seen.add(name)
            root = package.xml(name)
            report.section(name, walk(root, report, every_text) if not name.startswith("docProps") and name != "meta.xml" else "\n".join(f"{tag(n)}: {n.text.strip()}" for n in root.iter() if n.text and n.text.strip()))
    if any(re.search(r"(?i)(^|/)(media|embeddings|pictures|object)[ /]|vbaProject", n) for n in package.entries):
        report.warn("import_media")


def _more(package: Package, report: Report, part: str, seen: set[str], kinds: dict[str, str]) -> None:
    """Parts that belong to another one: notes, comments, charts and so on."""
    for _, kind, target in package.links(part, report):
        label = next((v for k, v in kinds.items() if k in kind), None)
        if label and target in package.entries and target not in seen:
            seen.add(target)
            root = package.xml(target)
            if label in report.counts:
                report.counts[label] += 1 if label == "notes" else sum(tag(n) in ("comment", "cm", "threadedComment") for n in root.iter())
            report.section(target, walk(root, report, False))


def pptx(package: Package, report: Report) -> None:
    main, seen = "ppt/presentation.xml", {"ppt/presentation.xml"}
    root = package.xml(main)
    if root is None:
        raise Failure("file_archive")
    at = {i: t for i, kind, t in package.links(main, report) if kind == "slide"}
    order = [at[attr(n, "id") if attr(n, "id") in at else next((v for v in n.attrib.values() if v in at), "")] for n in root.iter() if tag(n) == "sldId" and any(v in at for v in n.attrib.values())]
    if len(order) > report.limits.slides:
        raise Failure("file_slide_pages")
    for k, part in enumerate(order, 1):
        slide = package.xml(part)
        if slide is None:
            raise Failure("file_archive")
        seen.add(part)
        hidden = attr(slide, "show") in ("0", "false")
        report.counts["slides"] += 1
        report.counts["hidden"] += hidden
        report.section(f"slide {k}" + " hidden" * hidden, walk(slide, report, False))
        _more(package, report, part, seen, {"notesSlide": "notes", "comments": "comments", "chart": "chart", "diagramData": "diagram"})
    report.warn("import_slides")
    _leftovers(package, report, seen, r"^(docProps/.*|ppt/(slideMasters|slideLayouts|commentAuthors|authors)[^_]*)\.xml$")


def docx(package: Package, report: Report) -> None:
    main, seen = "word/document.xml", {"word/document.xml"}
    root = package.xml(main)
    if root is None:
        raise Failure("file_archive")
    report.section("document", walk(root, report, False))
    _more(package, report, main, seen, {"header": "header", "footer": "footer", "footnotes": "notes", "endnotes": "notes", "comments": "comments", "people": "people"})
    report.warn("import_document")
    _leftovers(package, report, seen, r"^(docProps/.*|word/(header|footer|footnotes|endnotes|comments|people)[^/]*)\.xml$")


DATE_IDS = {*range(14, 23), *range(27, 37), 45, 46, 47, *range(50, 59)}


def iso_serial(value: float, from_1904: bool) -> str | None:
    """ISO text of a spreadsheet serial, as functions.dates.excel_date gives it."""
    if not 0 <= value <= 2_958_465:
        return None
    day, seconds = int(value), round((value - int(value)) * 86_400)
    day, seconds = (day + 1, 0) if seconds == 86_400 else (day, seconds)
    if not from_1904 and day == 60:
        out = "1900-02-29"
    else:
        try:
            out = (date(1904, 1, 1) + timedelta(day) if from_1904 else date(1899, 12, 31) + timedelta(day - (day > 60))).isoformat()
        except OverflowError:
            return None
    return out if not seconds else f"{out}T{seconds // 3600:02}:{seconds % 3600 // 60:02}:{seconds % 60:02}"


def _date_styles(package: Package) -> set[int]:
    root = package.xml("xl/styles.xml")
    if root is None:
        return set()
    formats = {attr(n, "numFmtId"): attr(n, "formatCode") for n in root.iter() if tag(n) == "numFmt"}
    cells = next((n for n in root if tag(n) == "cellXfs"), ())
    dated = lambda i: (i.isdigit() and int(i) in DATE_IDS) or bool(re.search("[ymdhs]", re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", formats.get(i, "")), re.IGNORECASE))
    return {k for k, n in enumerate(cells) if dated(attr(n, "numFmtId", "0"))}


def _rows(sheet: ElementTree.Element, shared: list[str], dates: set[int], from_1904: bool, report: Report) -> Iterator[str]:
    for row in (n for n in sheet.iter() if tag(n) == "row"):
        line = []
        for c in row:
            value = next((n.text or "" for n in c if tag(n) == "v"), "")
            formula = next((n.text for n in c if tag(n) == "f" and n.text), None)
            kind = attr(c, "t")
            if kind == "s":
                if not value.isdigit() or int(value) >= len(shared):
                    raise Failure("file_xml")
                value = shared[int(value)]
            elif kind == "inlineStr":
                value = walk(c, report, False).strip()
            elif kind in ("", "n") and attr(c, "s", "0").isdigit() and int(attr(c, "s", "0")) in dates:
                try:
                    value = iso_serial(float(value), from_1904) or value
                except ValueError:
                    pass
            line.append(value + (f" [Formula: {formula}]" if formula else ""))
        yield "\t".join(line)


def xlsx(package: Package, report: Report) -> None:
    main, seen = "xl/workbook.xml", {"xl/workbook.xml"}
    root = package.xml(main)
    if root is None:
        raise Failure("file_archive")
    at = {i: t for i, kind, t in package.links(main, report) if kind == "worksheet"}
    strings = package.xml("xl/sharedStrings.xml")
    shared = [walk(n, report, False).strip("\n") for n in strings if tag(n) == "si"] if strings is not None else []
    dates = _date_styles(package)
    from_1904 = any(tag(n) == "workbookPr" and attr(n, "date1904") in ("1", "true") for n in root.iter())
    sheets = [n for n in root.iter() if tag(n) == "sheet"]
    if len(sheets) > report.limits.sheets:
        raise Failure("file_complex")
    for n in sheets:
        part = next((at[v] for v in n.attrib.values() if v in at), "")
        sheet = package.xml(part)
        if sheet is None:
            raise Failure("file_archive")
        seen.add(part)
        hidden = attr(n, "state") in ("hidden", "veryHidden")
        report.counts["sheets"] += 1
        report.counts["hidden"] += hidden
        report.section(f"sheet {attr(n, 'name')}" + " hidden" * hidden, "\n".join(_rows(sheet, shared, dates, from_1904, report)))
        _more(package, report, part, seen, {"comments": "comments", "threadedComment": "comments", "drawing": "drawing", "chart": "chart"})
    report.warn("import_spreadsheet")
    _leftovers(package, report, seen, r"^(docProps/.*|xl/(comments|threadedComments|persons)[^_]*)\.xml$")


def odf(package: Package, report: Report) -> None:
    root = package.xml("content.xml")
    if root is None:
        raise Failure("file_archive")
    styles = package.xml("styles.xml")
    own = {attr(n, "name"): n for r in (styles, root) if r is not None for n in r.iter() if tag(n) == "style"}

    def hidden(name: str) -> bool:
        passed: set[str] = set()
        while name in own and name not in passed:
            passed.add(name)
            for n in own[name].iter():
                if attr(n, "visibility") == "hidden" or (tag(n) == "table-properties" and attr(n, "display")):
                    return attr(n, "visibility") == "hidden" or attr(n, "display") == "false"
            name = attr(own[name], "parent-style-name")
        return False

    body = next((n for n in root.iter() if tag(n) == "body"), root)
    for kind, count, node in (("page", "slides", "presentation"), ("table", "sheets", "spreadsheet")):
        holder = next((n for n in body if tag(n) == node), None)
        for k, part in enumerate((n for n in holder if tag(n) == kind) if holder is not None else (), 1):
            out = hidden(attr(part, "style-name")) or attr(part, "display") == "false"
            report.counts[count] += 1
            report.counts["hidden"] += out
            if report.counts[count] > report.limits.slides:
                raise Failure("file_slide_pages" if count == "slides" else "file_complex")
            report.counts["notes"] += sum(tag(n) == "notes" for n in part.iter())
            report.section(f"{kind} {attr(part, 'name') or k}" + " hidden" * out, walk(part, report, True))
        if holder is not None:
            report.warn({"slides": "import_slides", "sheets": "import_spreadsheet"}[count])
    report.counts["comments"] += sum(tag(n) == "annotation" for n in body.iter())
    prose = next((n for n in body if tag(n) == "text"), None)
    if prose is not None:
        report.section("document", walk(prose, report, True))
        report.warn("import_document")
    for n in styles.iter() if styles is not None else ():
        if tag(n) in ("header", "footer"):
            report.section(tag(n), walk(n, report, True))
    _leftovers(package, report, {"content.xml", "styles.xml"}, r"^meta\.xml$", True)


EXTRACTORS: dict[str, Callable[[Package, Report], None]] = {"docx": docx, "xlsx": xlsx, "pptx": pptx, "odt": odf, "ods": odf, "odp": odf}


def extract(raw: bytes, kind: str, limits: Limits = Limits()) -> tuple[str, list[str], dict[str, int]]:
    """(text, warnings, counts) of a package."""
    report = Report(limits)
    EXTRACTORS[kind](Package(raw, limits), report)
    return report.text(), sorted(report.warnings), report.counts
