"""Table schemas and closed vocabularies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SYMBOL = (
    "name string, kind string, line int, col int, def_keyword string, doc_comment string, signature string, visibility string, container string, depth int, scope_end_line int, type_text string"
)
PARSED = f"file_id bigint, symbol_idx int, {SYMBOL}"
OCCURRENCE = "file_id bigint, word string, word_hash bigint, line int, col int, len int, role string"

# Fixed values.
FAMILY_CODE = {"rust": 1, "clike": 2, "go": 3, "python": 4, "jsts": 5, "javacsharp": 6, "ruby": 7}
FAMILY_OF = {
    "rs": "rust", "c": "clike", "h": "clike", "cpp": "clike", "cc": "clike", "cxx": "clike", "hpp": "clike", "hxx": "clike", "go": "go", "py": "python", "pyi": "python",
    "js": "jsts", "jsx": "jsts", "ts": "jsts", "tsx": "jsts", "mjs": "jsts", "cjs": "jsts", "mts": "jsts", "java": "javacsharp", "cs": "javacsharp", "rb": "ruby",
}
SKIP_DIRS = ["target", "node_modules", ".git", ".hg", ".svn", "__pycache__", ".venv", "venv", ".env", "env", "build", "dist", ".next", ".nuxt", "vendor", ".idea", ".vscode"]
KIND_OF_KEYWORD = {
    "fn": "Function", "func": "Function", "function": "Function", "def": "Function", "class": "Class", "record": "Class", "struct": "Struct", "union": "Struct", "enum": "Enum",
    "interface": "Interface", "trait": "Trait", "type": "TypeAlias", "typedef": "TypeAlias", "const": "Constant", "static": "Constant", "let": "Variable", "var": "Variable",
    "val": "Variable", "mod": "Module", "module": "Module", "namespace": "Module",
}
KIND_OF_CAPTURE = {
    "function": "Function", "method": "Method", "class": "Class", "struct": "Struct", "enum": "Enum", "interface": "Interface", "trait": "Trait", "type": "TypeAlias",
    "constant": "Constant", "variable": "Variable", "module": "Module", "macro": "Function", "field": "Variable", "variant": "Constant", "constructor": "Function",
    "local": "Variable", "parameter": "Variable",
}
PROTOCOL_KIND = {
    "Function": "FUNCTION", "Method": "METHOD", "Class": "CLASS", "Struct": "STRUCT", "Enum": "ENUM", "Interface": "INTERFACE", "Constant": "CONSTANT", "Variable": "VARIABLE",
    "Module": "MODULE", "TypeAlias": "TYPE_PARAMETER", "Trait": "INTERFACE", "Unknown": "NULL",
}
VISIBILITY_RANK = {"Public": 2, "Unknown": 1, "Private": 0}
LOCAL_KEYWORDS = ["variable", "parameter", "field"]
NOISE_WORDS = {
    "jsts": ["async", "export", "default", "abstract", "static", "readonly", "declare", "new"],
    "rust": ["pub", "crate", "super", "self", "unsafe", "async", "mut", "ref", "dyn"],
    "clike": ["static", "inline", "extern", "volatile", "const", "unsigned", "signed", "long", "short"],
    "go": ["chan", "map", "error"],
    "python": ["async"],
    "javacsharp": ["public", "private", "protected", "static", "final", "abstract", "sealed", "partial", "virtual", "override", "new"],
    "ruby": ["self"],
}
DEF_KEYWORDS = {
    "rust": ["fn", "struct", "enum", "trait", "type", "const", "static", "mod"],
    "clike": ["struct", "enum", "class", "union", "typedef", "namespace"],
    "go": ["func", "type", "var", "const"],
    "python": ["def", "class"],
    "jsts": ["function", "class", "const", "let", "var", "interface", "type", "enum"],
    "javacsharp": ["class", "interface", "enum", "record", "struct"],
    "ruby": ["def", "class", "module"],
}
SCOPE_OPENERS = {
    "rust": ["impl", "struct", "enum", "trait", "mod"],
    "clike": ["class", "struct", "enum", "namespace"],
    "go": [],
    "python": ["class"],
    "jsts": ["class", "interface", "enum", "namespace"],
    "javacsharp": ["class", "interface", "enum"],
    "ruby": ["class", "module"],
}


def lookup(values: dict, key: Column) -> Column:
    """The value of a key in a small constant table; null where there is none."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def sql_case(values: dict, key: str) -> str:
    """The same as SQL."""
    quote = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"case {key} " + " ".join(f"when {quote(k)} then {quote(v)}" for k, v in values.items()) + " end"


def sql_list(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"
