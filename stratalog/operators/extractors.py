"""Built-in extractors over file contents: headings, keys and declarations with their spans, import edges, diagnostics.

The scanners walk a text once each, in Arrow batches; which scanner a path gets is a column expression. A registry takes
further extractors by name.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Suffixes of each extractor, and the declaration patterns of the script scanner.
DOCUMENT_SUFFIXES = (".md", ".markdown", ".json", ".yaml", ".yml", ".toml")
SCRIPT_SUFFIXES = (".ts", ".tsx", ".js", ".jsx")
DECLARATIONS = (
    ("function", rb"(?m)^\s*(export\s+)?(async\s+)?function\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*\("),
    ("class", rb"(?m)^\s*(export\s+)?(default\s+)?class\s+([A-Za-z_$][A-Za-z0-9_$]*)"),
    ("variable", rb"(?m)^\s*(export\s+)?(const|let)\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*(:[^=]+)?="),
)
IMPORTS = rb"""(?m)^\s*import\s+(?:[^'"]+\s+from\s+)?['"]([^'"]+)['"]"""

#: name, kind, signature, start and end byte, confidence; and for edges the target.
Found = tuple[str, str, str, str | None, int, int, float]
_KEY = re.compile(r"[\w.\-]+\Z")


def provider_for(path: Column) -> Column:
    low = F.lower(path)
    ends = lambda suffixes: low.rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")
    return F.when(ends(DOCUMENT_SUFFIXES), "document_config").when(ends(SCRIPT_SUFFIXES), "structural_script").otherwise("text_fallback")


def _lines(data: bytes) -> Iterator[tuple[int, bytes, str]]:
    """(offset, line without its end, the same as text)."""
    at = 0
    for line in data.split(b"\n"):
        body = line.rstrip(b"\r")
        yield at, body, body.decode("utf-8", "replace")
        at += len(line) + 1


def headings(data: bytes) -> Iterator[Found]:
    for at, body, text in _lines(data):
        bare = text.lstrip()
        level = len(bare) - len(bare.lstrip("#"))
        if 1 <= level <= 6 and bare[level : level + 1] == " ":
            indent = len(text[: len(text) - len(bare)].encode())
            yield "symbol", "heading", bare[level:].strip(), f"h{level}", at + indent, at + len(body), 0.9


_JSON = re.compile(rb'"(?:\\.|[^"\\])*("|\Z)|[{}\[\],]', re.S)


def json_keys(data: bytes) -> Iterator[Found]:
    """Strings right after `{` or `,` at depth 1, in texts that need not be valid."""
    depth, wanted = 0, False
    for token in _JSON.finditer(data):
        c = token[0][:1]
        if c == b'"':
            if depth == 1 and wanted and token[1] == b'"':
                yield "symbol", "config_key", token[0][1:-1].decode("utf-8", "replace"), None, token.start(), token.end(), 0.85
            wanted = False
        elif c in b"{[":
            depth += 1
            wanted = c == b"{" and depth == 1
        elif c in b"}]":
            depth -= 1
            wanted = False
        elif depth == 1:
            wanted = True


def yaml_keys(data: bytes) -> Iterator[Found]:
    for at, body, text in _lines(data):
        key, colon, _ = text.partition(":")
        if colon and not text.startswith((" ", "\t")) and not text.lstrip().startswith(("#", "-")) and _KEY.match(key.strip()):
            yield "symbol", "config_key", key.strip(), None, at, at + len(key.encode()), 0.8


def toml_keys(data: bytes) -> Iterator[Found]:
    for at, body, text in _lines(data):
        bare = text.lstrip()
        if bare.startswith("["):
            if "]" in bare:
                yield "symbol", "config_section", bare[1 : bare.index("]")].strip(), None, at, at + len(body), 0.9
        elif bare and not bare.startswith("#"):
            key, equals, _ = bare.partition("=")
            if equals and _KEY.match(key.strip()):
                yield "symbol", "config_key", key.strip(), None, at, at + len(key.encode()), 0.85


_TOKENS = re.compile(rb"""(?P<text>"(?:\\.|[^"\\])*(?:"|\Z)|'(?:\\.|[^'\\])*(?:'|\Z)|`(?:\\.|[^`\\])*(?:`|\Z))|[(){}\[\];\n]""", re.S)


def _block_end(data: bytes, start: int) -> int:
    """Past the brace that closes the first one; the text's end if none does."""
    first = data.find(b"{", start)
    if first < 0:
        return len(data)
    depth = 0
    for token in _TOKENS.finditer(data, first):
        if token["text"] is None and token[0] in b"{}":
            depth += 1 if token[0] == b"{" else -1
            if depth == 0:
                return token.end()
    return len(data)


def _statement_end(data: bytes, start: int) -> int:
    """Past the first semicolon, or at the first line end, that is inside no bracket."""
    depth = 0
    for token in _TOKENS.finditer(data, start):
        if token["text"] is not None:
            continue
        if token[0] in b"({[":
            depth += 1
        elif token[0] in b")}]":
            depth -= 1
        elif depth <= 0:
            return token.end() if token[0] == b";" else token.start()
    return len(data)


def declarations(data: bytes) -> Iterator[Found]:
    for kind, pattern in DECLARATIONS:
        for m in re.finditer(pattern, data):
            end = _statement_end(data, m.start()) if kind == "variable" else _block_end(data, m.start())
            yield "symbol", kind, m[3].decode(), None, m.start(), end, 0.7
    for m in re.finditer(IMPORTS, data):
        yield "relationship", "imports", m[1].decode("utf-8", "replace"), None, m.start(), m.end(), 0.7


def fallback(data: bytes) -> Iterator[Found]:
    yield "diagnostic", "no_structural_provider", "", None, 0, len(data), 0.0


#: Extractors by suffix, longest first; others may be added with `register`.
SCANNERS: dict[str, Callable[[bytes], Iterator[Found]]] = {
    ".md": headings, ".markdown": headings, ".json": json_keys, ".yaml": yaml_keys, ".yml": yaml_keys, ".toml": toml_keys, **dict.fromkeys(SCRIPT_SUFFIXES, declarations),
}


def register(suffix: str, scanner: Callable[[bytes], Iterator[Found]]) -> None:
    SCANNERS[suffix.lower()] = scanner


def scan(path: str, data: bytes, scanners: dict[str, Callable[[bytes], Iterator[Found]]] = SCANNERS) -> list[Found]:
    low = path.lower()
    scanner = next((s for suffix, s in sorted(scanners.items(), key=lambda x: -len(x[0])) if low.endswith(suffix)), fallback)
    found = list(scanner(data))
    if not found and scanner is declarations:
        found = [("diagnostic", "no_declarations", "", None, 0, len(data), 0.0)]
    return found


FACTS = "path string, record string, kind string, name string, signature string, start_byte long, end_byte long, confidence double, start_line long, start_column long, end_line long"


def extract(files: DataFrame) -> DataFrame:
    """FACTS of files (path, content string): symbols, `relationship` rows from the path to an external name, diagnostics."""
    scanners = dict(SCANNERS)

    def run(batches):
        for batch in batches:
            rows: list[list] = [[] for _ in range(11)]
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").cast(pa.binary()).to_pylist(), strict=True):
                data = data or b""
                for record, kind, name, signature, start, end, confidence in scan(path, data, scanners):
                    line = data.count(b"\n", 0, start) + 1
                    column = len(data[data.rfind(b"\n", 0, start) + 1 : start].decode("utf-8", "replace")) + 1
                    last = line if kind in ("heading", "config_key", "config_section") else data.count(b"\n", 0, end) + 1
                    for out, value in zip(rows, (path, record, kind, name, signature, start, end, confidence, line, column, last), strict=True):
                        out.append(value)
            kinds = [pa.string()] * 5 + [pa.int64()] * 2 + [pa.float64()] + [pa.int64()] * 3
            names = [f.split()[0] for f in FACTS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names=names)

    return files.select("path", "content").mapInArrow(run, FACTS)


def file_symbol(files: DataFrame) -> DataFrame:
    """One declared `file` symbol for each file."""
    return files.select(F.concat(F.lit("file:"), "path").alias("symbol_key"), F.lit("file").alias("kind"), F.element_at(F.split("path", "/"), -1).alias("name"), F.octet_length("content").cast("long").alias("end_byte"))


def line_and_column(text: Column, offset: Column) -> tuple[Column, Column]:
    """1-based line and column (characters) of a byte offset."""
    head = F.decode(F.substring(F.encode(text, "UTF-8"), F.lit(1), offset.cast("int")), "UTF-8")
    line = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1
    return line.cast("long"), (F.length(F.substring_index(head, "\n", -1)) + 1).cast("long")


def line_range(text: Column, first: int, last: int) -> Column:
    """Lines first to last (1-based, both included, clamped) with their line ends; nothing where `first` is past the end."""
    lines = F.split(text, r"(?<=\n)")
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(1)))).otherwise(lines)
    start = max(first, 1)
    return F.when(F.size(lines) < start, F.lit("")).otherwise(F.array_join(F.slice(lines, start, max(last - start + 1, 0)), ""))


def byte_offset(text: Column, line: Column, character: Column, encoding: str) -> Column:
    """Byte offset of (line from 0, character), which counts units of `utf-8`, `utf-16` or `utf-32`."""
    lines = F.split(text, "\n")
    body = F.get(lines, line.cast("int"))
    before = F.when(line > 0, F.octet_length(F.array_join(F.slice(lines, F.lit(1), line.cast("int")), "\n")) + 1).otherwise(0)
    if encoding == "utf-8":
        inside = F.least(character, F.octet_length(body))
    elif encoding == "utf-16":
        inside = F.octet_length(F.decode(F.substring(F.encode(body, "UTF-16LE"), F.lit(1), (character * 2).cast("int")), "UTF-16LE"))
    else:
        inside = F.octet_length(F.substring(body, F.lit(1), character.cast("int")))
    return (before + inside).cast("long")
