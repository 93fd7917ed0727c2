"""Fill-in-middle transformation: one numpy kernel for all texts of an Arrow batch.

The kernel works on the UTF-8 bytes of the whole batch: a table gives the class of every byte, comparing
each byte with its neighbour marks where units (lines) begin, running sums that start again at every
document count units and code points, and one binary search over the running sum finds the cuts of all
rows together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table

#: Marks before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Seed of the draws, per cent of the texts that are cut, and per cent of these whose suffix comes first.
SEED, RATE, SPM = 7, 100, 50
#: Bytes of texts that one run of the kernel takes; a longer text is a run of its own.
BLOCK_BYTES = 1 << 22

_NEWLINE, _LESS, _LETTER, _GREATER, _LEAD = 1, 2, 4, 8, 16
_CLASS = np.where((np.arange(256) & 0xC0) != 0x80, _LEAD, 0).astype(np.uint8)
_CLASS[10] |= _NEWLINE
_CLASS[ord("<")] |= _LESS
_CLASS[[ord(m[1]) for m in (PREFIX, SUFFIX, MIDDLE)]] |= _LETTER
_CLASS[ord(">")] |= _GREATER

SCHEMA = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


def _sums(mask: np.ndarray) -> np.ndarray:
    """How many are set before every place, and in all."""
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def transform(texts: pa.Array, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Units, forms (0 plain, 1 psm, 2 spm), code points of prefix and middle, and the output of every text.

    ``draws`` has four unsigned 32-bit numbers a row: the first two choose the cuts, the third whether to cut at
    all, the fourth the form.
    """
    col = pc.fill_null(texts.cast(pa.large_string()), "")
    rows = len(col)
    at = np.frombuffer(col.buffers()[1], np.int64, rows + 1, 8 * col.offset)
    size = int(at[-1] - at[0])
    raw = np.frombuffer(col.buffers()[2], np.uint8, size, int(at[0])) if size else np.zeros(0, np.uint8)
    at = at - at[0]
    begin, end = at[:-1], at[1:]

    kind = _CLASS[raw]
    opens = np.zeros(size, bool)  # bytes that begin a unit: after a newline, or first of a document
    opens[1:] = (kind[:-1] & _NEWLINE) != 0
    opens[begin[begin < end]] = True
    units = _sums(opens)
    n = units[end] - units[begin]

    marked = np.zeros(size, bool)
    if size > 2:
        marked[:-2] = ((kind[:-2] & _LESS) != 0) & ((kind[1:-1] & _LETTER) != 0) & ((kind[2:] & _GREATER) != 0)
    marks = _sums(marked)
    holds = marks[np.maximum(begin, end - 2)] > marks[begin]

    h = draws.astype(np.int64)
    form = np.where(h[:, 3] % 100 < SPM, 2, 1)
    form[(begin == end) | holds | (h[:, 2] % 100 >= RATE)] = 0
    a, b = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    # unit c of a document begins where the running sum first exceeds the units before it; unit n is where the next begins
    wanted = units[begin] + np.stack([np.minimum(a, b), np.maximum(a, b)])
    cuts = np.minimum(np.searchsorted(units[1:], wanted, "right"), end)

    chars = _sums((kind & _LEAD) != 0)
    prefix, middle = chars[cuts[0]] - chars[begin], chars[cuts[1]] - chars[cuts[0]]

    view, parts = memoryview(raw), []
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    for f, x, y, z, e in zip(form.tolist(), begin.tolist(), cuts[0].tolist(), cuts[1].tolist(), end.tolist(), strict=True):
        if f == 1:
            parts += (p, view[x:y], s, view[z:e], m, view[y:z])
        elif f == 2:
            parts += (s, view[z:e], p, view[x:y], m, view[y:z])
        else:
            parts.append(view[x:e])
    sizes = end - begin + np.where(form > 0, len(p) + len(s) + len(m), 0)
    offsets = np.zeros(rows + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    output = pa.LargeStringArray.from_buffers(rows, pa.py_buffer(offsets), pa.py_buffer(b"".join(parts)))
    return n, form, prefix, middle, output


def _blocks(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of BLOCK_BYTES of texts, or of one row."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, before + BLOCK_BYTES, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def draws_of(doc_id: Column, seed: int = SEED) -> Column:
    """The first four 8-digit groups of the sha256 of ``seed:doc_id`` as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """Adds n, form, prefix_chars, middle_chars and output to every document; the text itself is left out.

    Null and empty texts have no units and are plain, with an empty output; texts that hold one of the marks are plain
    and stay as they are; a null id draws as an empty one; repeated rows are transformed alike; texts of any length are
    cut whole; an empty table gives an empty result. Further columns pass through (those of an added one's name are
    replaced).
    """
    bounded_batches(docs.sparkSession)
    kept = docs.drop(*ADDED)
    fields = [f for f in kept.schema if f.name != "text"]
    # the draws and the text stand first, so that no column's name can clash with theirs
    sent = kept.select(draws_of(F.col("doc_id")), F.col("text").cast("string"), *[F.col(f"`{f.name}`") for f in fields])
    spec = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), SCHEMA])
    names = [*(f.name for f in fields), *ADDED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = pa.array(["plain", "psm", "spm"])
        for whole in batches:
            for batch in _blocks(whole, 1):
                drawn = np.asarray(batch.column(0).flatten(), np.int64).reshape(-1, 4)
                n, form, prefix, middle, output = transform(batch.column(1), drawn)
                plain = form == 0
                added = [
                    pa.array(n), forms.take(pa.array(form)), pa.array(prefix, mask=plain), pa.array(middle, mask=plain), output.cast(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([*batch.columns[2:], *added], names=names)

    return sent.mapInArrow(run, spec)


def restored(output: Column, form: Column) -> Column:
    """The text that :func:`fill_in_middle` has cut. Marks stand in no cut text, so each is found by its first place
    (the middle's by its last)."""
    middle = F.substring_index(output, MIDDLE, -1)
    head = F.substring_index(output, MIDDLE, 1)
    first = F.substring(head, 4, 2**31 - 1)
    psm = F.concat(F.substring_index(first, SUFFIX, 1), middle, F.substring_index(first, SUFFIX, -1))
    spm = F.concat(F.substring_index(first, PREFIX, -1), middle, F.substring_index(first, PREFIX, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: one row per document."""
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    output = F.col("output")
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(output, 256).alias("output_sha256"),
        F.sha2(restored(output, F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS pieces, sha256('7:' || doc_id) AS h FROM documents),
u AS (SELECT *, CASE WHEN t = '' THEN 0 ELSE len(pieces) - CASE WHEN pieces[len(pieces)] = '' THEN 1 ELSE 0 END END AS n,
  [CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT) FOR k IN [0, 1, 2, 3]] AS r FROM d),
c AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS c1, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS c2,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
k AS (SELECT *, CASE c1 WHEN 0 THEN 0 WHEN n THEN length(t) ELSE length(array_to_string(pieces[1:c1], chr(10))) + 1 END AS a,
  CASE c2 WHEN 0 THEN 0 WHEN n THEN length(t) ELSE length(array_to_string(pieces[1:c2], chr(10))) + 1 END AS b FROM c),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM k)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
 sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256,
 sha256(t) AS restored_sha256 FROM p"""
