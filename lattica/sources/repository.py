"""Source files: normalised text, languages, census of repositories, and what changed between two trees."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.latest import sync_counts

# Languages of whole file names, and of extensions.
FILE_NAMES = {
    "make": ["Makefile", "GNUmakefile"],
    "dockerfile": ["Dockerfile"],
    "ruby": ["Vagrantfile", "Rakefile", "Gemfile"],
    "cmake": ["CMakeLists.txt"],
    "gitconfig": [".gitignore", ".gitattributes", ".gitmodules"],
    "ini": [".editorconfig"],
}
EXTENSIONS = {
    "rust": ["rs"],
    "go": ["go"],
    "c": ["c", "h"],
    "markdown": ["md", "markdown"],
    "python": ["py", "pyw", "pyi"],
    "javascript": ["js", "mjs", "cjs"],
    "typescript": ["ts", "mts", "cts"],
    "jsx": ["jsx"],
    "tsx": ["tsx"],
    "ruby": ["rb"],
    "php": ["php"],
    "perl": ["pl", "pm"],
    "lua": ["lua"],
    "r": ["r"],
    "julia": ["jl"],
    "elixir": ["ex", "exs"],
    "erlang": ["erl", "hrl"],
    "java": ["java"],
    "kotlin": ["kt", "kts"],
    "scala": ["scala", "sc"],
    "swift": ["swift"],
    "csharp": ["cs"],
    "cpp": ["cpp", "cc", "cxx", "hpp", "hxx", "hh"],
    "zig": ["zig"],
    "nim": ["nim"],
    "d": ["d"],
    "haskell": ["hs", "lhs"],
    "ocaml": ["ml", "mli"],
    "fsharp": ["fs", "fsx", "fsi"],
    "clojure": ["clj", "cljs", "cljc"],
    "dart": ["dart"],
    "shell": ["sh", "bash", "zsh"],
    "fish": ["fish"],
    "powershell": ["ps1", "psm1", "psd1"],
    "batch": ["bat", "cmd"],
    "yaml": ["yaml", "yml"],
    "json": ["json", "jsonc"],
    "toml": ["toml"],
    "xml": ["xml", "xsl", "xsd"],
    "ini": ["ini", "cfg"],
    "csv": ["csv", "tsv"],
    "sql": ["sql"],
    "graphql": ["graphql", "gql"],
    "protobuf": ["proto"],
    "html": ["html", "htm", "xhtml"],
    "css": ["css"],
    "scss": ["scss", "sass"],
    "less": ["less"],
    "vue": ["vue"],
    "svelte": ["svelte"],
    "text": ["txt", "text"],
    "rst": ["rst"],
    "asciidoc": ["adoc", "asciidoc"],
    "latex": ["tex", "latex"],
    "org": ["org"],
    "log": ["log"],
    "cmake": ["cmake"],
    "gradle": ["gradle"],
    "lockfile": ["lock"],
    "dotenv": ["env"],
    "diff": ["diff", "patch"],
}
# Extensions of binary files.
BINARY_EXTENSIONS = [
    "png", "jpg", "jpeg", "gif", "bmp", "ico", "webp", "svg", "tiff", "tif", "pdf", "doc", "docx", "xls", "xlsx",
    "ppt", "pptx", "odt", "zip", "tar", "gz", "bz2", "xz", "7z", "rar", "zst", "exe", "dll", "so", "dylib", "a",
    "lib", "o", "obj", "pyc", "pyo", "class", "wasm", "bin", "dat", "ttf", "otf", "woff", "woff2", "eot", "mp3",
    "mp4", "wav", "ogg", "flac", "avi", "mkv", "mov", "webm", "db", "sqlite", "sqlite3",
]
# Folders of what is built, which discovery leaves out.
SKIPPED = ("target",)
# Languages that are parsed.
PARSED = ("rust", "go", "c", "markdown")
#: Bytes in which a null byte makes a file binary.
SAMPLE_BYTES = 8192
# Fixed value: bytes of opaque text beyond which a file counts as binary.
TEXT_BYTES = 1024 * 1024


def normalized(text: Column) -> Column:
    """Without byte order mark and carriage returns, lines stripped at the end, runs of blank lines as one, one newline last."""
    out = F.regexp_replace(text, "^﻿", "")
    out = F.regexp_replace(out, "\r\n?", "\n")
    out = F.regexp_replace(out, r"[ \t\f\x0B]+(?=\n|$)", "")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return F.concat(F.regexp_replace(out, r"^\n+|\n+$", ""), F.lit("\n"))


def _lookup(table: dict[str, list[str]], key: Column) -> Column:
    pairs = [F.lit(x) for language, names in table.items() for name in names for x in (name, language)]
    return F.create_map(*pairs)[key]


def language(path: Column, content: Column | None = None) -> Column:
    """The language of a file by name, then by extension; null for binary files.

    Names that neither knows are text, or binary if ``content`` (bytes) has a null byte among its first.
    """
    name = F.substring_index(path, "/", -1)
    extension = F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1)))
    null_byte = F.lit(False)
    if content is not None:
        sample = F.decode(F.substring(content, 1, SAMPLE_BYTES), "ISO-8859-1")
        null_byte = F.coalesce(F.contains(sample, F.lit("\0")), F.lit(False))
    known = F.coalesce(_lookup(FILE_NAMES, name), _lookup(EXTENSIONS, extension))
    binary = F.coalesce(extension.isin(*BINARY_EXTENSIONS), F.lit(False))
    return F.when(known.isNotNull(), known).when(~binary & ~null_byte, F.lit("text"))


def line_count(text: Column) -> Column:
    """Lines of a text, as an editor counts them: a newline at the end opens none."""
    ends = F.regexp_count(text, F.lit("\n"))
    return F.coalesce(ends + F.when((text != "") & ~F.endswith(text, F.lit("\n")), 1).otherwise(0), F.lit(0)).cast("long")


def discovered(spark: SparkSession, folder: str, name: str = "*", skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """(path, content) of the files below ``folder`` whose names match a glob, for :func:`files` and other readers of files.

    Paths are relative to the folder. Folders of the names in ``skipped``, and hidden ones, aren't entered: their files
    are pruned by path before they are read. Spark's file readers know no empty files and nothing whose name begins with an
    underscore, so these are missing. A file is one value.
    """
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toUri().toString()
    plain = re.sub("^[A-Za-z][A-Za-z0-9+.-]*:/+", "/", root).rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(folder)
    relative = F.substring(F.regexp_replace("_metadata.file_path", "^[A-Za-z][A-Za-z0-9+.-]*:/+", "/"), len(plain) + 2, 1 << 30)
    unwanted = "(^|/)(" + "|".join([r"\.[^/]*", *map(re.escape, skipped)]) + ")/"
    chosen = rows.filter(~relative.rlike(unwanted) & ~F.startswith(F.substring_index(relative, "/", -1), F.lit(".")))
    return chosen.select(F.url_decode(F.replace(relative, F.lit("+"), F.lit("%2B"))).alias("path"), "content")


def files(rows: DataFrame) -> DataFrame:
    """Nodes of files (repo, path, content): repo, path, kind, language, content, line_count, bytes, sha.

    Languages that are parsed have kind ``file``, other text ``repo_opaque_text``, the rest and text of over TEXT_BYTES
    ``repo_opaque_binary``. Texts keep their whole content. Null content is empty.
    """
    content = F.coalesce(F.col("content").cast("binary"), F.lit(b""))
    rows = rows.select("repo", "path", content.alias("content")).withColumn("language", language(F.col("path"), F.col("content")))
    size = F.octet_length("content")
    parsed = F.coalesce(F.col("language").isin(*PARSED), F.lit(False))
    text = F.col("language").isNotNull() & (size <= TEXT_BYTES)
    kind = F.when(parsed, "file").when(text, "repo_opaque_text").otherwise("repo_opaque_binary")
    decoded = F.when(kind != "repo_opaque_binary", F.col("content").cast("string"))
    return rows.select(
        "repo", "path", kind.alias("kind"), F.when(kind != "repo_opaque_binary", F.col("language")).alias("language"),
        decoded.alias("content"), line_count(decoded).alias("line_count"),
        size.cast("long").alias("bytes"), F.sha2("content", 256).alias("sha"),
    )


def census(nodes: DataFrame) -> DataFrame:
    """(repo, language, files, lines) per language, binary files as ``binary``."""
    named = F.when(F.col("kind") == "repo_opaque_binary", "binary").otherwise(F.coalesce("language", F.lit("unknown")))
    counted = nodes.groupBy("repo", named.alias("language"))
    return counted.agg(F.count("*").alias("files"), F.sum("line_count").alias("lines"))


def tree_changes(new: DataFrame, old: DataFrame) -> DataFrame:
    """(path, change): what an incremental mirror adds, updates or deletes, by the digests of two trees (path, sha)."""
    return sync_counts(new, old, "path", "sha").select("path", "change")
