"""The language registry and the projects that its markers show."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_JS = (("function_declaration", "function"), ("function_expression", "function"), ("arrow_function", "function"), ("generator_function_declaration", "function"), ("method_definition", "method"), ("class_declaration", "type"), ("export_statement", "other"))
_JAVA = ("class_declaration", "interface_declaration", "enum_declaration")

#: name: (extensions, (node kind, meta type) pairs, container kinds, project markers, server command)
LANGUAGES: dict[str, tuple[tuple[str, ...], tuple[tuple[str, str], ...], tuple[str, ...], tuple[str, ...], str | None]] = {
    "swift": (("swift",), (("function_declaration", "function"), ("class_declaration", "type"), ("struct_declaration", "type"), ("enum_declaration", "type"), ("protocol_declaration", "type")), ("class_declaration", "struct_declaration", "enum_declaration", "protocol_declaration", "extension_declaration"), ("Package.swift", "*.xcodeproj", "*.xcworkspace"), "sourcekit-lsp"),
    "rust": (("rs",), (("function_item", "function"), ("struct_item", "type"), ("enum_item", "type"), ("trait_item", "type"), ("type_item", "type"), ("impl_item", "other"), ("mod_item", "other"), ("const_item", "other"), ("static_item", "other"), ("macro_definition", "other")), ("impl_item", "mod_item", "trait_item"), ("Cargo.toml",), "rust-analyzer"),
    "python": (("py",), (("function_definition", "function"), ("class_definition", "type"), ("decorated_definition", "other")), ("class_definition",), ("pyproject.toml", "setup.py"), "pyright-langserver"),
    "typescript": (("ts",), _JS, ("class_declaration",), ("package.json",), "typescript-language-server"),
    "tsx": (("tsx",), _JS, ("class_declaration",), ("package.json",), "typescript-language-server"),
    "javascript": (("js",), _JS, ("class_declaration",), ("package.json",), "typescript-language-server"),
    "go": (("go",), (("function_declaration", "function"), ("method_declaration", "method"), ("type_declaration", "type"), ("type_spec", "type")), (), ("go.mod",), "gopls"),
    "c": (("c", "h"), (("function_definition", "function"), ("struct_specifier", "type"), ("enum_specifier", "type")), (), ("CMakeLists.txt", "Makefile"), "clangd"),
    "cpp": (("cpp", "cc", "cxx", "hpp", "hxx"), (("function_definition", "function"), ("struct_specifier", "type"), ("enum_specifier", "type"), ("class_specifier", "type"), ("namespace_definition", "other")), ("namespace_definition", "class_specifier", "struct_specifier"), ("CMakeLists.txt", "Makefile"), "clangd"),
    "java": (("java",), (("method_declaration", "method"), ("constructor_declaration", "method"), *((k, "type") for k in _JAVA)), _JAVA, ("pom.xml", "build.gradle", "build.gradle.kts"), "jdtls"),
    "csharp": (("cs",), (("method_declaration", "method"), ("constructor_declaration", "method"), *((k, "type") for k in (*_JAVA, "struct_declaration", "record_declaration", "delegate_declaration"))), ("class_declaration", "interface_declaration", "struct_declaration", "namespace_declaration"), ("*.csproj", "*.sln"), "omnisharp"),
    "php": (("php",), (("function_definition", "function"), ("method_declaration", "method"), ("class_declaration", "type"), ("interface_declaration", "type"), ("trait_declaration", "type")), ("class_declaration", "interface_declaration", "trait_declaration"), ("composer.json",), "intelephense"),
    "sql": (("sql",), (), (), (), None),
    "json": (("json", "jsonc"), (("pair", "other"),), ("object",), (), None),
    "yaml": (("yaml", "yml"), (("block_mapping_pair", "other"), ("flow_pair", "other")), ("block_mapping", "flow_mapping"), (), None),
    "markdown": (("md", "markdown", "mdx"), (("section", "other"),), ("section",), (), None),
    "bash": (("sh", "bash", "zsh"), (("function_definition", "function"),), (), (), None),
}

EXTENSIONS = {e: name for name, (exts, *_) in LANGUAGES.items() for e in exts}


def extensions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(EXTENSIONS.items()), "extension string, language string")


def markers(spark: SparkSession) -> DataFrame:
    """position, language, marker and command, in registry order."""
    rows = [(k, name, m, server) for k, (name, (_, _, _, ms, server)) in enumerate(LANGUAGES.items()) for m in ms]
    return spark.createDataFrame(rows, "position int, language string, marker string, command string")


def language_of(path):
    """The language of a path's extension; null if unknown."""
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.element_at(table, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def detect_projects(entries: DataFrame) -> DataFrame:
    """(dir, language) of the directories with an entry (dir, name) that a marker matches, exactly or as a suffix."""
    m = markers(entries.sparkSession)
    hit = (F.col("name") == F.col("marker")) | (F.startswith("marker", F.lit("*")) & F.endswith(F.col("name"), F.expr("substring(marker, 2)")))
    return entries.join(F.broadcast(m), hit).select("dir", "language").distinct().orderBy("dir", "language")


def server_specs(projects: DataFrame) -> DataFrame:
    """The commands of the languages found: the first in registry order for each command."""
    m = markers(projects.sparkSession).select("position", "language", "command").distinct().filter("command IS NOT NULL")
    used = m.join(projects.select("language").distinct(), "language", "left_semi")
    w = Window.partitionBy("command").orderBy("position")
    return used.withColumn("n", F.row_number().over(w)).filter("n = 1").select("position", "language", "command").orderBy("position")
