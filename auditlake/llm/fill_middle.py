"""Fill-in-middle transformation: texts are cut at two seeded places and put together with the middle at the end.

A pandas UDF over Arrow batches: the regex library's finditer gives the units of a
text, whose end offsets go into a compact array; two lookups there slice the text.
hashlib computes the seeds, from the row's id, and the digests.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One code point, of any kind.
CODE_POINT = r"(?s)."
MARKERS = ("<P>", "<S>", "<M>")
#: Of 100 texts, by the third and fourth number: how many are transformed, and how many of these put the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
RESULT = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


def seeds(key: str) -> list[int]:
    """The first four groups of eight hex digits of the key's SHA-256, as numbers."""
    digits = hashlib.sha256(key.encode()).hexdigest()
    return [int(digits[k : k + 8], 16) for k in range(0, 32, 8)]


def transform(text: str, key: str, unit: regex.Pattern, markers: tuple[str, str, str] = MARKERS) -> tuple[int, str, int | None, int | None, str]:
    """The number of units, the form, the code points of prefix and middle, and the text in that form."""
    ends = array("I", (m.end() for m in unit.finditer(text)))
    n = len(ends)
    h1, h2, h3, h4 = seeds(key)
    if not text or any(m in text for m in markers) or h3 % 100 >= TRANSFORMED:
        return n, "plain", None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = ends[first - 1] if first else 0, ends[last - 1] if last else 0
    pre, suf, mid = markers
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SUFFIX_FIRST:
        return n, "spm", a, b - a, f"{suf}{suffix}{pre}{prefix}{mid}{middle}"
    return n, "psm", a, b - a, f"{pre}{prefix}{suf}{suffix}{mid}{middle}"


def restore(output: str, form: str, markers: tuple[str, str, str] = MARKERS) -> str:
    """The text that output was made of. No marker stands in a part, and none overlaps itself or another, so each is found where it was put."""
    if form == "plain":
        return output
    pre, suf, mid = markers
    head, tail = (suf, pre) if form == "spm" else (pre, suf)
    at = output.index(tail, len(head))
    to = output.index(mid, at + len(tail))
    one, two, middle = output[len(head) : at], output[at + len(tail) : to], output[to + len(mid) :]
    return two + middle + one if form == "spm" else one + middle + two


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = CODE_POINT, seed: str = "1:") -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars, output, output_sha256 and restored_sha256 (of the text rebuilt from output and form).

    A null text is empty; an empty one, or one that holds a marker, keeps its form. The
    cuts depend on the id, as decimal text behind `seed`, and on the number of units
    alone, so repeated rows give the same; a null id counts as empty text. With another
    unit (words, say) what stands before the end of a unit belongs to it, and what
    follows the last one to the suffix. All rows and columns of docs are kept, but for
    columns named as a result. Texts are handled one at a time, in memory of about
    eight times the longest; no text is shortened.
    """
    pattern = regex.compile(unit)

    @F.pandas_udf(RESULT)
    def made(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = []
        for key, text in zip(ids, texts):
            n, form, prefix, middle, output = transform(text, seed + key, pattern)
            digest = hashlib.sha256(output.encode()).hexdigest()
            rows.append((n, form, prefix, middle, output, digest, hashlib.sha256(restore(output, form).encode()).hexdigest()))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])
        return out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    names = [c.split()[0] for c in RESULT.split(", ")]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in names and c not in (id_col, text_col)])
    key, text = F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn("__made", made(key, text)).select(*docs.columns, "__made.*")
