"""Predicates that decide what may enter a corpus."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Licenses that may and may not be trained on.
ALLOWED = (
    "mit", "mit-0", "apache-2.0", "apache-2", "bsd-3-clause", "bsd-2-clause", "isc", "unlicense", "cc0-1.0", "mpl-2.0",
    "lgpl-2.1", "lgpl-2.1-only", "lgpl-2.1-or-later", "python-2.0", "zlib", "postgresql",
)
BLOCKED = ("agpl-3.0", "agpl-3.0-only", "agpl-3.0-or-later", "sspl-1.0", "business-source", "busl-1.1", "elastic-2.0")
# Path components and endings that are never collected.
EXCLUDED_NAMES = (
    ".env", ".env.", "node_modules", "vendor", "build", "dist", "target", "__pycache__", ".git", ".idea", ".gradle",
    ".cache", "venv", ".venv",
)
EXCLUDED_SUFFIXES = (
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".pdf", ".zip", ".gz", ".tar", ".jar", ".class", ".so", ".dll",
    ".dylib", ".exe", ".bin", ".woff", ".woff2", ".ttf", ".eot", ".ipynb_checkpoints",
)


# Folders and endings that ingestion leaves out.
INGEST_NAMES = ("node_modules", "vendor", "build", "dist", "target", "__pycache__", ".git", ".idea", ".gradle", ".venv", "venv", ".cache", "repos")
INGEST_SUFFIXES = (
    ".png", ".jpg", ".jpeg", ".gif", ".pdf", ".zip", ".gz", ".tar", ".jar", ".class", ".so", ".dll", ".exe", ".woff",
    ".woff2", ".ico",
)
# Lock files, folders of evaluations, licenses of the public domain and types of sources.
LOCK_FILES = r"(requirements.*\.lock|package-lock\.json|yarn\.lock|Pipfile\.lock|poetry\.lock)$"
EVALUATION = {"benchmarks/baselines": "evaluation-baseline", "benchmarks/hidden_tests": "hidden-test"}
PUBLIC_DOMAIN = ("unlicense", "cc0-1.0", "public-domain")
SOURCE_TYPES = ("dataset", "repository")


def license_class(license_id: Column) -> Column:
    """unknown, permissive, restricted or unrecognized."""
    norm = F.lower(F.trim(license_id))
    return F.when(F.coalesce(license_id, F.lit("")) == "", "unknown").when(norm.isin(*ALLOWED), "permissive").when(norm.isin(*BLOCKED), "restricted").otherwise("unrecognized")


def trainable(license_id: Column, verified: Column) -> Column:
    """Permissive licenses, and whatever is verified."""
    return (license_class(license_id) == "permissive") | F.coalesce(verified, F.lit(False))


def redistributable(license_id: Column, verified: Column) -> Column:
    """Permissive licenses that are verified."""
    return (license_class(license_id) == "permissive") & F.coalesce(verified, F.lit(False))


def public_domain(license_id: Column) -> Column:
    return F.coalesce(F.lower(F.trim(license_id)).isin(*PUBLIC_DOMAIN), F.lit(False))


def source_gate(license_id: Column, verified: Column, source_type: Column) -> Column:
    """ok, or why a source isn't collected: its license, else its type."""
    return F.when(~trainable(license_id, verified), license_class(license_id)).when(~F.coalesce(source_type.isin(*SOURCE_TYPES), F.lit(False)), "unsupported source_type").otherwise("ok")


def components(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda c: ~c.isin("", "."))


def suffix(path: Column) -> Column:
    """The last dot of a file's name and what follows, in lower case; names that begin with their only dot have none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)/*$", 1))


def skip_reason(path: Column) -> Column:
    """Why a path isn't collected; null if it is. The first rule that matches counts."""
    plain = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^[./]+", "")
    out = F.when(path.rlike(LOCK_FILES), "lockfile")
    out = F.when(suffix(path).isin(*EXCLUDED_SUFFIXES), "binary-like-suffix").otherwise(out)
    out = F.when(path.rlike(r"(^|/)\.env(\.|$)"), "env-file").otherwise(out)
    out = F.when(F.exists(components(path), lambda c: c.isin(*EXCLUDED_NAMES)), "excluded-name").otherwise(out)
    for folder, reason in reversed(EVALUATION.items()):
        out = F.when((plain == folder) | plain.startswith(folder + "/"), reason).otherwise(out)
    return out


def ingested(path: Column) -> Column:
    """Whether repository ingestion takes a path: no excluded folder, no binary, environment or key file."""
    return ~(F.exists(F.split(path, "/"), lambda c: c.isin(*INGEST_NAMES)) | suffix(path).isin(*INGEST_SUFFIXES) | path.startswith(".env") | path.endswith(".pem") | path.endswith(".key"))
