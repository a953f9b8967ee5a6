"""Column functions on strings, paths and addresses."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

EXTENSIONS = ("md", "txt", "docx", "pdf", "pptx", "xlsx", "html")
# Hosts that aren't public addresses.
PRIVATE_HOST = (
    r"^(localhost|.*\.localhost|::1|\[::1\]|(0|10|127)\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}|192\.168\.[0-9]{1,3}\.[0-9]{1,3}|"
    r"169\.254\.[0-9]{1,3}\.[0-9]{1,3}|172\.(1[6-9]|2[0-9]|3[01])\.[0-9]{1,3}\.[0-9]{1,3})$"
)
# Names of files, and folders, that hold keys or passwords.
SENSITIVE_NAME = (
    r"(?i)\.env|id_rsa|id_ed25519|credential|password|passwd|secret|private[_-]?key|access[_-]?token|keychain|wallet|钥匙串|密码|口令|密钥|凭据"
)
SENSITIVE_FOLDER = r"(?i)(^|[/\\])(\.ssh|\.gnupg|\.aws|\.kube|credentials)([/\\]|$)"


def trimmed(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"^[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}\x{FEFF}]+|[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}\x{FEFF}]+\z", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def file_label(ext: Column) -> Column:
    return (
        F.when(ext == "md", "Markdown").when(ext == "txt", "Text").when(ext == "pdf", "PDF").when(ext == "docx", "Word").otherwise("File")
    )


def sensitive_path(path: Column) -> Column:
    """Files that hold keys or passwords, and folders of such files."""
    return F.regexp_extract(path, r"[^/]*$", 0).rlike(SENSITIVE_NAME) | path.rlike(SENSITIVE_FOLDER)


def library_name(name: Column) -> Column:
    """The name in compatibility form without outer white space; null if nothing is left or it has
    control characters."""
    clean = trimmed(normalized(name))
    return F.when((clean != "") & ~clean.rlike(r"[\x00-\x1F\x7F]"), clean)


@F.pandas_udf(StringType())
def normalized(values: pd.Series) -> pd.Series:
    """Compatibility composition (NFKC); Spark has no built-in function for it."""
    return values.str.normalize("NFKC")


def library_id(name: Column) -> Column:
    """A safe library_name() as it is, any other as kb- and a digest; null for no name."""
    name = library_name(name)
    safe = name.rlike(r"^[A-Za-z0-9][A-Za-z0-9_-]{0,63}$")
    return F.when(safe, name).otherwise(F.concat(F.lit("kb-"), F.substring(F.sha2(F.encode(name, "utf-8"), 256), 1, 16)))


def fingerprint(index: dict, provider: str, model: str, dimensions: int = 0) -> str | None:
    """Why vectors of an embedding service don't compare with those of an index; None if they do.

    An index that names no model is empty and fits any service (answer "empty"); unknown dimensions fit.
    """
    if not index.get("model"):
        return "empty"
    if (index.get("model"), index.get("provider", "")) != (model, provider):
        return "model differs"
    known = int(index.get("dimensions") or 0)
    return "dimensions differ" if dimensions and known and dimensions != known else None


def url_host(url: Column) -> Column:
    """Host of an address in small letters, without user and port; '' if there is none. Any text will do, an address of
    other letters or invisible characters too, which parse_url() refuses with an error or null."""
    return F.lower(F.regexp_extract(url, r"^[a-z]+://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/:?#]+)", 1))


def private_host(host: Column) -> Column:
    """Is it an address of the own machine or network? A missing host counts as one."""
    low = F.lower(host)
    return F.coalesce((low == "") | low.rlike(PRIVATE_HOST), F.lit(True))


def page_file_name(title: Column, url: Column) -> Column:
    """Title without path signs, at most 40 characters, and a digest of the address."""
    slug = F.trim(F.regexp_replace(F.regexp_replace(title, r'[\\/:*?"<>|]', ""), r"\s+", " "))
    slug = F.substring(F.when(slug == "", "page").otherwise(slug), 1, 40)
    return F.concat(slug, F.lit("-"), F.substring(F.sha2(F.encode(url, "utf-8"), 256), 1, 8), F.lit(".md"))


def error_reason(message: Column) -> Column:
    """What the user is told about an error: an undeclared service, a service that can't be reached,
    missing settings of the embedding service, or the message itself."""
    return (
        F.when(message.isNull(), F.lit(None).cast("string"))
        .when(message.contains("not declared in manifest"), "service not allowed")
        .when(message.contains("fetch failed") | message.contains("ENOTFOUND"), "service unreachable")
        .when(message.rlike("(?i)embedding|api key|config"), "embedding not configured")
        .otherwise(message)
    )
