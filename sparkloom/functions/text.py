"""Scalar and text functions. Column functions stay in the JVM; plain Python ones are for arguments."""

from __future__ import annotations

import fnmatch
import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Separators of qualified names.
SEPARATORS = ("::", ".", "\\")


def git_sha(content: Column) -> Column:
    """Git's blob id of binary content."""
    head = F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8")
    return F.sha1(F.concat(head, F.lit(b"\x00"), content))


def git_sha_of(data: bytes) -> str:
    return hashlib.sha1(b"blob %d\x00" % len(data) + data).hexdigest()


def config_hash(files: dict[str, bytes]) -> str:
    """Of configuration files by path: sha1 over path, NUL, bytes, NUL, in order of paths."""
    h = hashlib.sha1()
    for path in sorted(files):
        h.update(path.encode() + b"\x00" + files[path] + b"\x00")
    return h.hexdigest()


def language_of(parser_id: Column) -> Column:
    """A ``tree-sitter-`` parser's id without that prefix and what follows an at sign; any other id as it is."""
    return F.when(parser_id.startswith("tree-sitter-"), F.split(F.substring(parser_id, 13, 1 << 30), "@")[0]).otherwise(parser_id)


#: A run of Unicode white space.
SPACES = r"\p{IsWhite_Space}+"


def collapse_space(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(text, SPACES, " "))


def truncate_bytes(text: str, most: int) -> str:
    """Cut to so many UTF-8 bytes at a character's border, with an ellipsis where something is cut."""
    data = text.encode()
    return text if len(data) <= most else data[:most].decode(errors="ignore") + "…"


def normalize_qualified(name: Column) -> Column:
    """For comparisons: white space collapsed, without leading ``::``. Separators stay as they are."""
    return F.regexp_replace(collapse_space(name), "^(::)+", "")


def is_qualified(symbol: str) -> bool:
    return any(s in symbol for s in SEPARATORS)


def is_qualified_column(symbol: Column) -> Column:
    return symbol.contains("::") | symbol.contains(".") | symbol.contains("\\")


def bare_name(symbol: str) -> str:
    """After the right-most separator; a single colon is none."""
    return max((symbol.rpartition(s)[2] for s in SEPARATORS if s in symbol), key=lambda rest: -len(rest), default=symbol)


def bare_name_column(symbol: Column) -> Column:
    return F.regexp_extract(symbol, r"(?s)^(?:.*(?:::|\.|\\))?(.*)$", 1)


def fold_ascii(text: Column) -> Column:
    """A-Z in lower case, and nothing else: the case rule of the prefix filters."""
    return F.translate(text, UPPER, LOWER)


def like_prefix(column: Column, prefix: str) -> Column:
    """Starts with ``prefix``, whose percent and underscore signs are wild, without regard to ASCII case."""
    return F.like(fold_ascii(column), F.lit(prefix.translate(str.maketrans(UPPER, LOWER)) + "%"), F.lit("\x01"))


def module_of(path: Column) -> Column:
    """The Python module of a ``.py`` file: packages by directory, ``__init__`` stands for its directory. Null of other files and of a root ``__init__.py``."""
    bare = F.regexp_replace(path, r"(/__init__)?\.py$", "")
    return F.when(path.endswith(".py") & (path != "__init__.py"), F.translate(bare, "/", "."))


def matches_pattern(path: str, patterns: list[str]) -> bool:
    """Whether a base name matches ``*.ext`` or a literal name."""
    base = path.rpartition("/")[2]
    return any(base == p or (p.startswith("*.") and fnmatch.fnmatchcase(base, p)) for p in patterns)


def shebang_language(content: Column) -> Column:
    """Of scripts without a known extension: by the interpreter in the first 256 bytes' first line."""
    line = F.split(F.decode(F.substring(content, 1, 256), "ISO-8859-1"), "\n")[0]
    named = F.when(line.contains("python"), "python").when(line.contains("ruby"), "ruby").when(line.contains("php"), "php").when(line.contains("node"), "javascript")
    return F.when(line.startswith("#!"), named)


def rfc3339(ns: Column) -> Column:
    """Epoch nanoseconds as text in UTC, to the second."""
    return F.date_format(F.timestamp_micros(F.floor(ns / 1000)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def backoff_ns(failures: Column, base_ns: int = 5_000_000_000, most_ns: int = 600_000_000_000) -> Column:
    """base * 2 ** min(failures - 1, 20), at most ``most_ns``."""
    shift = F.least(F.greatest(failures - 1, F.lit(0)), F.lit(20)).cast("int")
    return F.least((F.lit(base_ns) * F.pow(F.lit(2.0), shift)).cast("long"), F.lit(most_ns).cast("long"))


def reason_code(status: Column, error: Column) -> Column:
    """Why an analyzer's run that did not succeed did not: from its status, and of skipped ones from the error text."""
    e = F.translate(error, UPPER, LOWER)
    # fixed values: words of error texts and the reasons they stand for
    skipped = (
        F.when(error.isNull(), "unknown")
        .when(e.contains("binary") & (e.contains("missing") | e.contains("not available")), "binary_not_found")
        .when(e.contains("no matching files"), "no_matching_files")
        .when(e.contains("workspace unsuitable") | e.contains("gemfile without gemfile.lock"), "workspace_unsuitable")
        .when(e.contains("stalled") | e.contains("timed out"), "timed_out")
        .otherwise("unknown")
    )
    done = F.when(status.isin("succeeded", "queued", "running"), F.lit(None).cast("string")).when(status == "skipped", skipped)
    return done.when(status == "timed_out", "timed_out").when(status == "failed", "analyzer_failed").otherwise("unknown")


def version_parts(version: Column) -> Column:
    """major, minor and patch of a version without its pre-release and build parts; null if they are not three numbers of 64 bits."""
    core = F.split(F.split(version, r"\+")[0], "-")[0]
    parts = F.transform(F.split(core, r"\."), lambda x: F.when(x.rlike("^[0-9]+$"), F.regexp_replace(x, "^0+(?=.)", "")))
    fits = F.forall(parts, lambda x: x.isNotNull() & (F.length(x) <= 20) & ((F.length(x) < 20) | (x <= "18446744073709551615")))
    return F.when((F.size(parts) == 3) & fits, parts)


def version_class(own: Column, other: Column) -> Column:
    """How two versions go together."""
    a, b = version_parts(own), version_parts(other)
    # fixed values: the classes
    first = F.when(a.isNull() | b.isNull(), "unparseable").when(a[0] != b[0], "major_mismatch")
    return first.when(a[1] != b[1], "minor_mismatch").when(a[2] != b[2], "patch_mismatch").otherwise("same_patch")


def anchor_kind(name: Column) -> Column:
    kind = F.when(name == "HEAD", "head").when(name.startswith("branch/"), "branch").when(name.startswith("tag/"), "tag")
    return kind.when(name.rlike("^tentative/[0-9]+$"), "tentative")


def anchor_rank(name: Column) -> Column:
    """HEAD, branches, tags, tentative snapshots, others."""
    return F.when(name == "HEAD", 0).when(name.startswith("branch/"), 1).when(name.startswith("tag/"), 2).when(name.startswith("tentative/"), 3).otherwise(4)


def anchor_key(name: Column) -> Column:
    """Within a rank: branches by their own name, HEAD by none, others by the whole name."""
    return F.when(name == "HEAD", "").when(name.startswith("branch/"), F.substring(name, 8, 1 << 30)).otherwise(name)


def location(repo: Column, anchor: Column, path: Column, line: Column) -> Column:
    return F.concat_ws(":", repo, anchor, path, line.cast("string"))


def without_return(line: Column) -> Column:
    """A line without the carriage returns at its end."""
    return F.regexp_replace(line, r"\r+$", "")
