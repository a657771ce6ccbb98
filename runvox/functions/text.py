"""Column expressions for names, ids, paths and log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def case_name(source: Column, case_id: Column) -> Column:
    """The case's global name: the case itself if it already starts with its source, else source_case."""
    return F.when(F.startswith(F.lower(case_id), source), case_id).otherwise(F.concat_ws("_", source, case_id))


def scoring_source(name: Column) -> Column:
    """In scoring, the source is whatever precedes the first underscore."""
    return F.substring_index(name, "_", 1)


def eval_case_id(dataset: Column, scan: Column) -> Column:
    """Evaluation-case id of a scan file name; null where the name has not the dataset's form."""
    stem = F.regexp_replace(scan, r"\.nii\.gz$", "")
    return (F.when((dataset == "BTCV") & stem.startswith("img"), F.concat(F.lit("btcv_label"), F.substring(stem, 4, 1 << 20)))
            .when((dataset == "FLARE") & stem.endswith("_0000"), F.regexp_replace(stem, "_0000$", ""))
            .when((dataset == "AMOS") & stem.startswith("amos_"), stem))


def gold_name(dataset: Column, path: Column) -> Column:
    """File name of a gold scan; its folder where scans are named by folder."""
    parts = F.split(path, "/")
    return F.when(dataset == "RAOS", F.element_at(parts, -2)).otherwise(F.element_at(parts, -1))


def parent_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def group_name(folder: Column, prefix: str = "raos") -> Column:
    """``…(Set2)…`` → ``raos2``; null without a set number."""
    n = F.regexp_extract(folder, r"\(Set(\d)", 1)
    return F.when(n != "", F.concat(F.lit(prefix), n))


def dashed(name: Column) -> Column:
    return F.translate(name, ".", "-")


def canonical_key(name: Column) -> Column:
    """Lower case, singular vertebra, words sorted: the same organ under any spelling of the list."""
    words = F.split(F.trim(F.replace(F.regexp_replace(F.lower(name), r"[_\s]+", " "), F.lit("vertebrae"),
                                     F.lit("vertebra"))), " ")
    return F.array_join(F.array_sort(F.filter(words, lambda w: w != "")), " ")


def unsafe_name(name: Column) -> Column:
    """Not a plain relative path: empty, absolute, ``.`` or ``..`` parts, doubled or trailing slash, ``\\`` or ``:``."""
    bad = name.rlike(r"^/|(^|/)\.\.?(/|$)|//|/$|\\|:")
    return F.coalesce((name == "") | (bad & (name != ".")), F.lit(True))


def full_match(value: Column, pattern: str) -> Column:
    return F.coalesce(value.rlike(f"^(?:{pattern})\\z"), F.lit(False))


def eol_hashes(content: Column) -> Column:
    """sha256 of a text as stored and with CRLF turned to LF; either counts as the same file."""
    return F.array(F.sha2(content, 256), F.sha2(F.replace(content, F.lit("\r\n"), F.lit("\n")), 256))


def redact(line: Column, token: str = "hf_[A-Za-z0-9]+", length: int = 800) -> Column:
    """Tokens replaced, then only the last ``length`` characters."""
    clean = F.regexp_replace(line, token, "[redacted]")
    return F.right(clean, F.lit(length))
