"""BLAKE2b keys and canonical JSON, which SQL lacks; over columns by Arrow batches."""

from __future__ import annotations

import json
from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_hex(*parts: object, size: int = 8) -> str:
    """The hex digest of parts joined by a bar."""
    return blake2b("|".join(map(str, parts)).encode(), digest_size=size).hexdigest()


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def content_hash(value: object) -> str:
    """Of a document, a configuration or a list of records."""
    return blake2b(canonical_json(value).encode(), digest_size=16).hexdigest()


def blake2b_hex(text: Column, size: int = 8) -> Column:
    """The hex digest, whose order is the digest's order."""

    @F.pandas_udf("string")
    def digest(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else blake2b(t.encode(), digest_size=size).hexdigest())

    return digest(text)


def query_id(text: Column) -> Column:
    """A query's id, from its text."""
    return F.concat(F.lit("q"), F.substring(blake2b_hex(text), 1, 12))


def label_key(query_text: Column, doc_id: Column, doc_hash: Column, model: str, prompt: str) -> Column:
    """The key of one judgment."""
    return blake2b_hex(F.concat_ws("|", query_text, doc_id.cast("string"), doc_hash, F.lit(model), F.lit(prompt)))


def mock_grade(key: Column) -> Column:
    """A stand-in for a judge: the first byte of the key's digest, modulo 4."""
    return (F.conv(F.substring(blake2b_hex(F.concat(F.lit("mock|"), key)), 1, 2), 16, 10).cast("int") % 4).cast("int")
