"""Content keys of prompts, documents and runs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, functions as F


def prompt_hash(prompt: Column) -> Column:
    """SHA-1 of the UTF-8 text of a prompt."""
    return F.sha1(prompt)


def hash_prefix(key: Column) -> Column:
    """First two characters of a key: the store's partition column."""
    return F.substring(key, 1, 2)


def prompt_path(key: Column) -> Column:
    """Path of a prompt inside an exported store."""
    return F.concat(F.lit("cache/"), hash_prefix(key), F.lit("/"), key, F.lit("/prompt.txt"))


def doc_hash(text: Column) -> Column:
    """Key of a document or a query text."""
    return F.md5(text)


def run_hash(cache_prefix: str, args: Mapping[str, Any]) -> str:
    """Key of a run: module prefix and MD5 of its arguments with sorted names."""
    text = json.dumps(args, sort_keys=True)
    return f"{cache_prefix}_{hashlib.md5(text.encode()).hexdigest()}"
