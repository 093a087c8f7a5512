"""Path predicates over project-relative posix paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File kinds and directory names.
CODE_EXTENSIONS = (".py", ".js", ".jsx", ".ts", ".tsx")
SOURCE_EXTENSIONS = (*CODE_EXTENSIONS, ".json", ".yaml", ".yml", ".html")
ARTIFACT_EXTENSIONS = (".js", ".mjs", ".cjs", ".css", ".html", ".json", ".map", ".txt")
DOTENV_NAMES = (".env", ".env.local", ".env.development", ".env.production")
SKIPPED_DIRECTORIES = (".git", ".venv", "__pycache__", "node_modules")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Lower-case extension; a leading or trailing dot does not start one."""
    return F.lower(F.regexp_extract(base_name(path), r"(?s)\A.+(\.[^.]+)\z", 1))


def is_dotenv_file(path: Column) -> Column:
    return base_name(path).isin(*DOTENV_NAMES)


def is_code_file(path: Column) -> Column:
    return suffix(path).isin(*CODE_EXTENSIONS)


def is_supported_file(path: Column) -> Column:
    return suffix(path).isin(*SOURCE_EXTENSIONS) | is_dotenv_file(path)


def is_artifact_file(path: Column) -> Column:
    return suffix(path).isin(*ARTIFACT_EXTENSIONS)


def is_artifact_path(path: Column) -> Column:
    """Inside build output: ``dist``, ``build`` or ``.next/static``."""
    return path.rlike(r"\A(?:dist|build|\.next/static)(?:/|\z)")


def in_skipped_directory(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in SKIPPED_DIRECTORIES]))


def _fold(path: Column) -> Column:
    """Segments after folding ``.`` and ``..``; null when ``..`` leaves the start."""

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 0, F.slice(done, F.lit(1), F.size(done) - 1))
        return (
            F.when(done.isNull() | part.isin("", "."), done)
            .when(part == "..", up)
            .otherwise(F.concat(done, F.array(part)))
        )

    return F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)


def relative_path(path: Column, root: Column | None = None) -> Column:
    """Lexical path below the root; links are not resolved, outside gives null.

    Clean relative paths, the usual case, pass through without being split.
    """
    if root is not None:
        rooted = F.when(F.startswith(path, F.lit("/")), path).otherwise(
            F.concat(root, F.lit("/"), path)
        )
        full, base = F.array_join(_fold(rooted), "/"), F.array_join(_fold(root), "/")
        below = F.startswith(full, F.concat(base, F.lit("/")))
        return (
            F.when(full == base, F.lit(""))
            .when(base == "", full)
            .when(below, F.substr(full, F.length(base) + 2))
        )
    untidy = path.rlike(r"(?:^|/)\.{0,2}(?:/|$)")
    folded = F.when(~F.startswith(path, F.lit("/")), F.array_join(_fold(path), "/"))
    return F.when(untidy, folded).otherwise(path)
