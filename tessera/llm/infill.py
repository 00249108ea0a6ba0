r"""Fill-in-middle transformation as a pyarrow.compute pipeline.

A text is split into units (``[A-Za-z]+|[^A-Za-z]``), two cuts between units are drawn from a digest of the seed and the
id, and prefix, middle and suffix are written behind marks, in prefix-suffix-middle or suffix-prefix-middle order. Each
slice of a batch goes through whole-array kernels: texts become list arrays of units, these are flattened with the
index of their parent, get ordinals, are filtered by role, rebuilt as lists and joined. Rows are independent, so the
work is one pass over the table without a shuffle; memory is bounded by ``SLICE_BYTES`` of text, or one longer text.

Defined cases: a null text is an empty one; an empty text, or one that holds a mark, stays plain; a null id draws as an
empty one; repeated rows draw alike and each keep a row; an empty table gives no row; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import text_of
from tessera.llm.arrow_text import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 1, 90, 20
SLICE_BYTES = 1 << 20


def unit_lists(text: pa.StringArray) -> pa.ListArray:
    """Each text (none null) as the list of its units: where a unit begins is told from the bytes."""
    at = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, 4 * text.offset) if len(text) else np.zeros(1, np.int32)
    size = int(at[-1] - at[0])
    data = text.buffers()[2].slice(int(at[0]), size) if size else pa.py_buffer(b"")
    at = at - at[0]
    byte = pa.Array.from_buffers(pa.uint8(), size, [None, data])
    code = lambda x: pa.scalar(x, pa.uint8())
    low = pc.bit_wise_or(byte, code(0x20))
    letter = pc.and_(pc.greater_equal(low, code(ord("a"))), pc.less_equal(low, code(ord("z"))))
    before = pa.concat_arrays([pa.array([False]), letter])[:size]
    inner = pc.or_(pc.equal(pc.bit_wise_and(byte, code(0xC0)), code(0x80)), pc.and_(letter, before))
    first = np.zeros(size, bool)
    first[at[:-1][np.diff(at) > 0]] = True
    begins = pc.indices_nonzero(pc.or_(pa.array(first), pc.invert(inner))).to_numpy()
    units = pa.StringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, size).astype(np.int32)), data)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(begins, at).astype(np.int32)), units)


def _modulo(a: pa.Array, b: pa.Array | pa.Scalar) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def _joined(units: pa.Array, role: pa.Array, count: pa.Array) -> pa.Array:
    """The units of a role, joined in each text; ``count``: how many each text has of them."""
    offsets = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(count)]).cast(pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, pc.filter(units, role)), "")


def transform(text: pa.StringArray, draws: list[pa.Array], rate: int, spm_rate: int) -> list[pa.Array]:
    """[n, form, prefix_chars, middle_chars, output] of texts without nulls and their four drawn numbers each."""
    lists = unit_lists(text)
    n = pc.list_value_length(lists).cast(pa.int64())
    slots = pc.add(n, 1)
    one, two = _modulo(draws[0], slots), _modulo(draws[1], slots)
    cut, end = pc.min_element_wise(one, two), pc.max_element_wise(one, two)
    units, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    start = lists.offsets[: len(text)].cast(pa.int64())
    ordinal = pc.subtract(pa.array(np.arange(len(units))), pc.take(start, parent))
    ahead, behind = pc.less(ordinal, pc.take(cut, parent)), pc.greater_equal(ordinal, pc.take(end, parent))
    prefix, suffix = _joined(units, ahead, cut), _joined(units, behind, pc.subtract(n, end))
    middle = _joined(units, pc.invert(pc.or_(ahead, behind)), pc.subtract(end, cut))
    plain = pc.or_(pc.equal(n, 0), pc.greater_equal(_modulo(draws[2], pa.scalar(100)), rate))
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = pc.or_(plain, pc.match_substring(text, mark))
    spm = pc.less(_modulo(draws[3], pa.scalar(100)), spm_rate)
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    psm_text = pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, "")
    spm_text = pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, "")
    chars = lambda piece: pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(piece).cast(pa.int64()))
    return [n, form, chars(prefix), chars(middle), pc.if_else(plain, text, pc.if_else(spm, spm_text, psm_text))]


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each document; ``rate``: percent that is not left plain."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    drawn = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i}") for i in range(4)]
    given = docs.select("doc_id", text_of().alias("text"), digest.alias("digest")).select("doc_id", "text", *drawn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            made = transform(part.column("text"), [part.column(f"h{i}") for i in range(4)], rate, spm_rate)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *made], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return given.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from."""

    def pieces(mark: str) -> tuple[Column, Column, Column]:
        """What stands behind the first mark, behind ``mark`` (the second one) and behind the last."""
        head, last = F.substring_index(output, mark, 1), F.substring_index(output, MIDDLE, -1)
        before, behind = F.char_length(head), F.char_length(last)
        return head.substr(F.lit(4), before), output.substr(before + 4, F.char_length(output) - before - behind - 6), last

    prefix, suffix, middle = pieces(SUFFIX)
    suffix2, prefix2, middle2 = pieces(PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)


def op13(docs: DataFrame) -> DataFrame:
    digest = lambda c: F.sha2(c, 256)
    made = fill_in_middle(docs)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
    sha256(t) AS restored_sha256 FROM p
"""
