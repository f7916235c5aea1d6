"""Fill-in-middle transformation of whole texts.

A text is cut, left to right, into units: a word with the white space before it, or white space at the end. Arrow batches
reach pandas UDFs; in each, ``finditer`` collects the units' ends (in code points) in a compact array, two lookups in it
give the ends of prefix and middle, and the text is sliced there. Seeds are the first four groups of eight hex digits of
the SHA-256 of ``seed:id``, so a row's outcome hangs on its own id and text only, however the rows lie, and lost tasks
give the same rows again. No shuffle; a worker holds one batch and four bytes a unit of one text.

Forms: ``plain``, the text as it is, if it is empty, holds a sentinel, or is not drawn (``rate`` of 100 are); else
``spm`` (``spm_rate`` of 100) or ``psm``.

Defined results: a null text counts as empty, a null id has no digits; an id may be of any type, its text as Spark casts
it; repeated rows each get their own, equal result; very long texts are taken whole; an empty table stays empty; extra
columns stay, but a column with the name of a result is replaced.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A word with the white space before it, or white space that ends the text.
UNIT = regex.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
RATE, SPM_RATE, SEED = 50, 80, 42
RESULT = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"
RESTORED = "restored string, restored_sha256 string"


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def draws(key: str) -> tuple[int, ...]:
    """Four 32-bit numbers of a key."""
    digits = hashlib.sha256(key.encode()).hexdigest()
    return tuple(int(digits[i : i + 8], 16) for i in range(0, 32, 8))


def unit_ends(text: str) -> array:
    """Where each unit ends, in code points; the units follow each other without gaps."""
    return array("Q", (m.end() for m in UNIT.finditer(text)))


def arranged(text: str, ident: str, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> tuple:
    """n, form, prefix_chars, middle_chars and output of a text."""
    ends = unit_ends(text)
    n = len(ends)
    first, second, drawn, kind = draws(f"{seed}:{ident}")
    if not text or any(s in text for s in SENTINELS) or drawn % 100 >= rate:
        return n, "plain", None, None, text
    low, high = sorted((first % (n + 1), second % (n + 1)))
    a, b = ends[low - 1] if low else 0, ends[high - 1] if high else 0
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if kind % 100 < spm_rate:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def rebuilt(output: str, form: str) -> str:
    """The text that ``arranged`` made ``output`` from; other forms than its own, or sentinels out of place, fail."""
    if form == "plain":
        return output
    first, second = {"psm": (PREFIX, SUFFIX), "spm": (SUFFIX, PREFIX)}[form]
    if not output.startswith(first):
        raise ValueError(f"output of form {form} does not start with {first}")
    one, rest = output.removeprefix(first).split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    return one + middle + two if form == "psm" else two + middle + one


def transform(docs: DataFrame, id_column: str = "doc_id", rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """``docs`` (with ``text`` and the id) with n, form, prefix_chars, middle_chars, output and output_sha256."""

    @F.pandas_udf(RESULT)
    def arrange(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [arranged(t, i, rate, spm_rate, seed) for i, t in zip(ids, texts, strict=True)]
        columns = [pd.Series(list(c), dtype=d) for c, d in zip(zip(*rows, strict=True), ("int64", object, "Int64", "Int64", object), strict=True)] if rows else [[]] * 5
        names = [x.split()[0] for x in RESULT.split(", ")]
        return pd.DataFrame(dict(zip(names, [*columns, [sha256(r[4]) for r in rows]], strict=True)))

    made = arrange(F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    names = [x.split()[0] for x in RESULT.split(", ")]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return docs.select(*kept, made.alias("__made")).select(*kept, *[F.col(f"__made.{c}") for c in names])


def restore(rows: DataFrame) -> DataFrame:
    """``rows`` (output, form) with the exact text, ``restored``, and its ``restored_sha256``."""

    @F.pandas_udf(RESTORED)
    def rebuild(outputs: pd.Series, forms: pd.Series) -> pd.DataFrame:
        texts = [rebuilt(o, f) for o, f in zip(outputs, forms, strict=True)]
        return pd.DataFrame({"restored": pd.Series(texts, dtype=object), "restored_sha256": pd.Series(map(sha256, texts), dtype=object)})

    names = [x.split()[0] for x in RESTORED.split(", ")]
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in names]
    return rows.select(*kept, rebuild("output", "form").alias("__made")).select(*kept, *[F.col(f"__made.{c}") for c in names])


#: The digests of the contract in DuckDB.
SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS units,
  CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p"""
