"""Heterogeneous sources as units: paragraphs, sections, JSON leaves, transcript windows, files."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_DEPTH, MAX_UNITS = 4, 500
MAX_FILE_BYTES = 5 * 1024 * 1024
WINDOW_MS = 90_000
MAX_FILES, MAX_REPO_FILE, MAX_REPO_TOTAL = 400, 512 * 1024, 16 * 1024 * 1024
# What a repository scan keeps, and names of agents' configuration, in lower case.
KEPT_SUFFIXES = (".md", ".markdown", ".txt", ".rst", ".adoc", ".json", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".py", ".js", ".ts", ".sql", ".sh")
AGENT_CONFIG = ("claude.md", "agents.md", "agent.md", ".cursorrules", "copilot-instructions.md")
ROUTES = {".md": "markdown", ".markdown": "markdown", ".txt": "text", ".json": "json", ".pdf": "pdf", ".docx": "docx", ".docm": "refused_macro", ".dotm": "refused_macro"}


def paragraphs(docs: DataFrame, separator: str = r"\n\s*\n") -> DataFrame:
    """A row for each paragraph that is not blank, numbered from 1 after blank ones are gone."""
    kept = F.filter(F.transform(F.split("text", separator), lambda p: F.btrim(p, F.lit(" \t\r\n"))), lambda p: p != "")
    rest = [c for c in docs.columns if c != "text"]
    return docs.select(*rest, F.posexplode(kept).alias("n", "text")).withColumn("n", F.col("n") + 1)


def sections(docs: DataFrame) -> DataFrame:
    """Markdown sections: what stands before the first heading, then each heading with its body; sections without a body go."""
    marked = F.regexp_replace(F.col("text"), r"(?m)^(#{1,6} )", "\u0001$1")
    parts = F.split(marked, "\u0001")
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(*rest, F.posexplode(parts).alias("n", "part"))
    heading = F.regexp_extract("part", r"^#{1,6} ([^\n]*)", 1)
    body = F.btrim(F.regexp_replace("part", r"^#{1,6} [^\n]*\n?", ""), F.lit(" \t\r\n"))
    return rows.select(*rest, "n", heading.alias("heading"), body.alias("text")).where("text <> ''")


def flatten(text: str | None, max_depth: int | None = None, max_units: int | None = None, keys: bool = False) -> list[tuple[str, str, str]]:
    """(path, kind, value) of the leaves of a JSON text, keys sorted; below max_depth values stay JSON text; keys: also key names."""
    try:
        root = json.loads(text) if text is not None else None
    except (ValueError, RecursionError):
        return []
    out: list[tuple[str, str, str]] = []
    todo: list[tuple[str, object, int]] = [("", root, 0)]
    while todo:
        path, value, depth = todo.pop()
        if isinstance(value, (dict, list)) and (max_depth is None or depth < max_depth):
            pairs = sorted(value.items()) if isinstance(value, dict) else enumerate(value)
            below = [(f"{path}.{k}" if path else str(k), v) if isinstance(value, dict) else (f"{path}[{k}]", v) for k, v in pairs]
            if keys and isinstance(value, dict):
                out += [(p, "key", p.rsplit(".", 1)[-1]) for p, _ in below]
            todo += [(p, v, depth + 1) for p, v in reversed(below)]
        elif value is not None:
            kind = "string" if isinstance(value, str) else "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "json"
            out.append((path, kind, value if isinstance(value, str) else json.dumps(value, sort_keys=True, ensure_ascii=False)))
        if max_units is not None and len(out) >= max_units:
            return out[:max_units]
    return out


def json_leaves(docs: DataFrame, column: str, max_depth: int | None = None, max_units: int | None = None, keys: bool = False) -> DataFrame:
    """The leaves of a JSON column, one row each, beside the other columns. Arrow batches: built-in functions do not recurse."""
    rest = [c for c in docs.columns if c != column]
    schema = docs.select(*rest).schema.add("path", "string").add("kind", "string").add("value", "string")

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [flatten(t, max_depth, max_units, keys) for t in batch[column]]
            out = batch[rest].loc[batch.index.repeat([len(f) for f in found])].reset_index(drop=True)
            flat = [x for f in found for x in f]
            for k, c in enumerate(("path", "kind", "value")):
                out[c] = pd.Series([x[k] for x in flat], dtype=object)  # a batch without leaves has columns of strings as well
            yield out

    return docs.mapInPandas(leaves, schema)


def flat_leaves(docs: DataFrame, column: str) -> DataFrame:
    """As json_leaves for flat objects, inside the JVM."""
    rest = [c for c in docs.columns if c != column]
    return docs.select(*rest, F.explode(F.from_json(column, "map<string,string>")).alias("path", "value"))


def windows(segments: DataFrame, key: str, span_ms: int = WINDOW_MS) -> DataFrame:
    """segments(key, n, start_ms, end_ms, text): greedy windows, a new one when a segment ends more than span_ms after the window's start.

    The start of a window depends on the one before, so a key's segments are read in order by one task, in batches.
    """
    ordered = segments.repartition(F.col(key)).sortWithinPartitions(key, "n")

    def group(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple | None = None  # key, number, start, end, first n, count, texts
        for batch in batches:
            out = []
            for k, n, start, end, text in zip(batch[key], batch["n"], batch["start_ms"], batch["end_ms"], batch["text"], strict=True):
                if held is not None and held[0] == k and end - held[2] <= span_ms:
                    held = (*held[:3], max(held[3], end), held[4], held[5] + 1, [*held[6], text or ""])
                    continue
                if held is not None:
                    out.append((*held[:6], " ".join(held[6])))
                held = (k, held[1] + 1 if held is not None and held[0] == k else 1, start, end, n, 1, [text or ""])
            yield pd.DataFrame(out, columns=[key, "window", "start_ms", "end_ms", "first_n", "n_segments", "text"])
        if held is not None:
            yield pd.DataFrame([(*held[:6], " ".join(held[6]))], columns=[key, "window", "start_ms", "end_ms", "first_n", "n_segments", "text"])

    kind = segments.schema[key].dataType.simpleString()
    return ordered.select(key, "n", "start_ms", "end_ms", "text").mapInPandas(group, f"{key} {kind}, window int, start_ms long, end_ms long, first_n long, n_segments int, text string")


def files(spark: SparkSession, folder: str, pattern: str = "*.json", max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(path, sha256, content, parse_error): files that are too large are rows with an error, and their content is never read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    small = found.where(F.col("length") <= max_bytes).select("path", F.sha2("content", 256).alias("sha256"), F.col("content").cast("string").alias("content"))
    large = found.where(F.col("length") > max_bytes).select("path", F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("string").alias("content"))
    root = F.call_function("try_parse_json", F.col("content"))
    shape = F.call_function("schema_of_variant", root)
    error = F.when(F.col("content").isNull(), "too large").when(root.isNull(), "invalid JSON").when(~F.startswith(shape, F.lit("OBJECT")), "not an object")
    return small.unionByName(large).withColumn("parse_error", error)


def route(path: Column) -> Column:
    """What reads a file, by its suffix."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    known = F.create_map(*[F.lit(x) for kv in ROUTES.items() for x in kv])
    return F.coalesce(known[suffix], F.lit("unsupported"))


def safe_relative(path: Column) -> Column:
    """Relative, without `..` and not empty."""
    return (path != "") & ~F.startswith(path, F.lit("/")) & ~F.array_contains(F.split(path, "/"), "..") & ~F.contains(path, F.lit("\\"))


def repository_files(listing: DataFrame, max_files: int = MAX_FILES) -> DataFrame:
    """listing(repo, path, length, head binary, is_link) -> kept and reason; budgets of a repository are spent in path order."""
    from pyspark.sql import Window

    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    binary = F.contains(F.hex("head"), F.lit("00")) & F.col("head").cast("string").rlike("\u0000") | ~F.call_function("is_valid_utf8", F.col("head").cast("string"))
    reason = (
        F.when(F.col("path").rlike(r"(^|/)\.git"), "git").when(F.col("is_link"), "symlink").when(~safe_relative(F.col("path")), "escape")
        .when(~suffix.isin(*KEPT_SUFFIXES), "suffix").when(F.col("length") > MAX_REPO_FILE, "too large").when(binary, "binary")
    )
    order = Window.partitionBy("repo").orderBy("path").rowsBetween(Window.unboundedPreceding, 0)
    rows = listing.withColumn("reason", reason)
    rows = rows.withColumn("spent", F.sum(F.when(F.col("reason").isNull(), F.col("length")).otherwise(0)).over(order)).withColumn("kept_so_far", F.count_if(F.col("reason").isNull()).over(order))
    budget = F.when(F.col("kept_so_far") > max_files, "file budget").when(F.col("spent") > MAX_REPO_TOTAL, "byte budget")
    reason = F.coalesce("reason", budget)
    return rows.select("repo", "path", reason.isNull().alias("kept"), reason.alias("reason"))


def repository_units(files: DataFrame) -> DataFrame:
    """files(path, text) of a repository -> title, text, locator_kind, status and knowledge_type of their units.

    What a file says is declared, never observed; agents' configuration is a warning with no authority. Blank files give no unit.
    """
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    return files.where(F.btrim("text", F.lit(" \t\r\n")) != "").select(
        F.col("path").alias("title"), "text", F.lit("REPO_FILE").alias("locator_kind"), F.substring("path", 1, 200).alias("locator"),
        F.lit("DECLARED").alias("epistemic_status"), F.when(name.isin(*AGENT_CONFIG), "WARNING").otherwise("CONCEPT").alias("knowledge_type"),
    )


def docx_sections(found: DataFrame) -> DataFrame:
    """(path, content) of DOCX files -> (path, n, heading, text, refused): sections by heading style; macros are refused."""
    name = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def read(path: str, content: bytes) -> list[tuple]:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as held:
                if any(n.endswith("vbaProject.bin") for n in held.namelist()):
                    return [(path, 0, None, None, "macro")]
                body = ElementTree.fromstring(held.read("word/document.xml"))
        except (KeyError, zipfile.BadZipFile, ElementTree.ParseError):
            return [(path, 0, None, None, "unreadable")]
        out: list[list] = [[None, []]]
        for p in body.iter(f"{name}p"):
            text = "".join(t.text or "" for t in p.iter(f"{name}t"))
            style = p.find(f"{name}pPr/{name}pStyle")
            if style is not None and re.match("Heading|Title", style.get(f"{name}val", "")):
                out.append([text, []])
            elif text.strip():
                out[-1][1].append(text)
        return [(path, n, h, "\n".join(lines), None) for n, (h, lines) in enumerate(out) if lines]

    def sections_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [x for p, c in zip(batch["path"], batch["content"], strict=True) for x in read(p, c)]
            yield pd.DataFrame(rows, columns=["path", "n", "heading", "text", "refused"])

    return found.select("path", "content").mapInPandas(sections_of, "path string, n int, heading string, text string, refused string")
