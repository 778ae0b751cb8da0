"""Fill-in-the-middle training texts by in-place block rotation, and their exact restoration.

A text is cut twice between its units (a run of ASCII letters, or any other single character) into
prefix, middle and suffix. Sentinels are inserted into the bytearray that holds the text, which gives
``<P>prefix<M>middle<S>suffix``, and two neighbouring segments change places by a three-reversal
rotation: ``<M>middle`` with ``<S>suffix`` (form psm), or all before ``<S>`` with the rest (form spm).
Restoring finds the sentinels, rotates back and deletes them.

Cuts, the share of plain texts and the share of spm follow from the sha256 of ``salt:id``, so that a
retried task gives the same rows. Sentinels are found again for certain: a text that holds one stays
plain, and one can't arise where segments meet, because each starts with the only '<' it has.

Defined cases: a null text is the empty text and stays plain; a null id is the text 'null'; repeated
rows give repeated results; an empty table gives an empty result; other columns of the input stay
outside, whatever their names; a text of any length takes a few bytes a byte, in one task.

Scale: narrow. Texts pass through the tasks in slices of ``SLICE_BYTES``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.llm.common import id_and_text, slices

PRE, MID, SUF = b"<P>", b"<M>", b"<S>"
PLAIN_PERCENT, SPM_PERCENT = 10, 20
SALT = "1"
#: Bytes looked at together where a unit is searched for.
STRIDE = 1 << 20
_OTHER, _LETTER, _INNER = 0, 1, 2
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[0x80:0xC0] = _INNER


def scan(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The kind of each byte, and whether a unit starts at it."""
    kind = _KIND[np.frombuffer(text, dtype=np.uint8)]
    starts = kind == _OTHER
    letter = kind == _LETTER
    starts |= letter
    starts[1:] &= ~(letter[1:] & letter[:-1])
    return kind, starts


def offset_of(starts: np.ndarray, unit: int) -> int:
    """The byte at which a unit starts; the length of the text for the unit after the last."""
    for lo in range(0, len(starts), STRIDE):
        here = starts[lo:lo + STRIDE]
        n = int(np.count_nonzero(here))
        if unit < n:
            return lo + int(np.flatnonzero(here)[unit])
        unit -= n
    return len(starts)


def _reverse(v: np.ndarray, lo: int, hi: int) -> None:
    half = (hi - lo) // 2
    for at in range(0, half, STRIDE):
        n = min(STRIDE, half - at)
        left, right = v[lo + at:lo + at + n], v[hi - at - n:hi - at]
        kept = left[::-1].copy()
        left[:] = right[::-1]
        right[:] = kept


def rotate(buffer: bytearray, lo: int, mid: int, hi: int) -> None:
    """Blocks [lo, mid) and [mid, hi) change places: each is reversed, then both together."""
    v = np.frombuffer(buffer, dtype=np.uint8)
    _reverse(v, lo, mid)
    _reverse(v, mid, hi)
    _reverse(v, lo, hi)


def rearrange_text(text: bytes, key: str, salt: str = SALT, plain_percent: int = PLAIN_PERCENT,
                   spm_percent: int = SPM_PERCENT) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of the prefix, code points of the middle, output)."""
    digest = hashlib.sha256(f"{salt}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in range(0, 32, 8))
    kind, starts = scan(text)
    n = int(np.count_nonzero(starts))
    if not text or PRE in text or MID in text or SUF in text or h3 % 100 >= 100 - plain_percent:
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    i, j = offset_of(starts, first), offset_of(starts, second)
    prefix, middle = (int(np.count_nonzero(kind[lo:hi] != _INNER)) for lo, hi in ((0, i), (i, j)))
    out = bytearray(text)
    out[j:j] = SUF
    out[i:i] = MID
    out[0:0] = PRE
    at_mid, at_suf = len(PRE) + i, len(PRE) + len(MID) + j
    form = "spm" if h4 % 100 < spm_percent else "psm"
    rotate(out, 0 if form == "spm" else at_mid, at_suf, len(out))
    return n, form, prefix, middle, bytes(out)


def restore_text(output: bytes, form: str) -> bytes:
    """The text that ``output`` of this form was made of."""
    if form == "plain":
        return output
    out = bytearray(output)
    lo, mid = (0, out.find(PRE)) if form == "spm" else (out.find(SUF), out.find(MID))
    rotate(out, lo, mid, len(out))
    for sentinel in (SUF, MID, PRE):
        at = out.find(sentinel)
        del out[at:at + len(sentinel)]
    return bytes(out)


def _texts(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).view(pa.string())


def rearrange(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salt: str = SALT,
              plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: a row for each row of ``docs``."""
    rows = id_and_text(docs, id_col, text_col).select(
        "doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column(2).cast(pa.binary()).to_pylist()
            made = [rearrange_text(t, k, salt, plain_percent, spm_percent) for t, k in zip(texts, b.column(1).to_pylist())]
            n, form, prefix, middle, out = zip(*made)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                 pa.array(middle, pa.int64()), _texts(out)], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(rows: DataFrame, form_col: str = "form", output_col: str = "output") -> DataFrame:
    """``rows`` with the column restored: the text rebuilt from output and form alone."""
    keep = [c for c in rows.columns if c != "restored"]
    at_form, at_output = keep.index(form_col), keep.index(output_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, output_col):
            texts = b.column(at_output).cast(pa.binary()).to_pylist()
            back = [None if t is None else restore_text(t, f) for t, f in zip(texts, b.column(at_form).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, _texts(back)], [*keep, "restored"])

    kept = rows.select(*[F.col(f"`{c}`") for c in keep])
    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField("restored", StringType())]))


def digest(rearranged: DataFrame) -> DataFrame:
    """The columns of the query ``op11_fill_in_middle``."""
    return restore(rearranged).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))


#: DuckDB: cuts by lists of units; what is restored must be the text.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
             sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS x FROM documents),
h AS (SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2,
        CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
             WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
        least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j FROM h),
p AS (SELECT *, array_to_string(u[1:i], '') AS pre, array_to_string(u[i + 1:j], '') AS mid, array_to_string(u[j + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
