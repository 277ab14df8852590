"""Language of a file, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sextant.functions.text import basename, extension

# Extensions of the file scanner (strict) and of the chunker (full), and the
# texts that tell C++ from C.
STRICT = {".py": "python", ".go": "go", ".md": "markdown", ".txt": "text", ".rst": "rst"}
FULL = {
    ".go": "go", ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".java": "java", ".rs": "rust", ".rb": "ruby", ".php": "php", ".scala": "scala", ".cpp": "cpp", ".cc": "cpp",
    ".cxx": "cpp", ".hpp": "cpp", ".hxx": "cpp",
}
CPP_MARKERS = (
    "class ", "namespace ", "template<", "::", "std::", "public:", "private:", "protected:", "typename ",
    "constexpr ", "nullptr", "virtual ", "override", "final", "delete", " new ",
)
C_MARKERS = ("struct ", "typedef ", "void ", "int ", "char ", "#include <")


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


def has_cpp_markers(text: Column) -> Column:
    return _any(text, CPP_MARKERS)


def only_c_markers(text: Column) -> Column:
    return _any(text, C_MARKERS) & ~has_cpp_markers(text)


def detect_language(path: Column, content: Column) -> Column:
    """Language by extension; ``.c`` and ``.h`` by what the content holds; else ``unknown``."""
    ext, text = extension(path), F.coalesce(content, F.lit(""))
    out = F.when(ext == ".c", F.when(has_cpp_markers(text), "cpp").otherwise("c"))
    out = out.when(ext == ".h", F.when(only_c_markers(text), "c").otherwise("cpp"))
    for e, name in FULL.items():
        out = out.when(ext == e, name)
    return out.otherwise("unknown")


def scanner_language(path: Column, table: dict[str, str] = STRICT) -> Column:
    """Language by the case-sensitive extension; null for files that are not indexed."""
    ext = F.regexp_extract(path, r"(\.[^./]*)$", 1)
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), ext)


def is_hidden(relative: Column) -> Column:
    """True if a folder or the file itself begins with a dot, below the root."""
    return F.exists(F.split(relative, "/"), lambda s: s.startswith("."))


__all__ = ["basename", "detect_language", "has_cpp_markers", "is_hidden", "only_c_markers", "scanner_language"]
