"""Documents cut for infilling: prefix, middle and suffix in an order that shows the model both sides first.

A pyarrow.compute pipeline does the cutting, a batch at once: texts are split into lists of lines, the lists are flattened
with their parents' indices, ordinals are counted within each parent, lines are filtered by role, lists are rebuilt from
the roles' sizes and joined to strings. Where a document is cut follows from a seeded hash of its id, so a repeated task
gives the same output. No shuffle takes part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import arrow_map


class Marks(NamedTuple):
    """What stands before each part. None may begin inside another, so that outputs can be taken apart again."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


#: Bytes of text taken up at once.
AT_ONCE = 4 << 20
CUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of an id: the first groups of the SHA-256 of ``seed:id``. A null id has no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def lines(texts: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """Lines with their line feeds: values, parents' indices, ordinals within a parent, and each text's number of lines."""
    lists = pc.split_pattern(texts, "\n")
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    ordinal = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    last = pa.array(ordinal == np.repeat(size, size) - 1)  # what follows the last line feed; not a line if empty
    values = pc.if_else(last, flat, pc.binary_join_element_wise(flat, pa.scalar("\n", flat.type), pa.scalar("", flat.type)))
    there = pc.or_(pc.invert(last), pc.greater(pc.binary_length(flat), 0))
    kept = there.to_numpy(zero_copy_only=False)
    n = np.bincount(parent.to_numpy(zero_copy_only=False)[kept], minlength=len(texts))
    return values.filter(there), parent.filter(there), ordinal[kept], n


def portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose texts have ``AT_ONCE`` bytes together, or of one row with a longer text."""
    ends, start = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)), 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, AT_ONCE + (ends[start - 1] if start else 0), "right")))
        yield batch.slice(start, stop - start)
        start = stop


def joined(values: pa.Array, wanted: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The wanted values as one list for each text, joined to a string."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int64())
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, values.filter(pa.array(wanted))), pa.scalar("", values.type))


def _cut(marks: Marks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole)):
            texts, form = batch.column("text").cast(pa.large_string()), batch.column("form")
            values, parent, ordinal, n = lines(texts)
            cuts = np.stack([batch.column(c).to_numpy(zero_copy_only=False) % (n + 1) for c in ("h1", "h2")])
            a, b = cuts.min(0), cuts.max(0)
            of = parent.to_numpy(zero_copy_only=False)
            prefix = joined(values, ordinal < a[of], a)
            middle = joined(values, (ordinal >= a[of]) & (ordinal < b[of]), b - a)
            suffix = joined(values, ordinal >= b[of], n - b)
            mark = {k: pa.scalar(v, pa.large_string()) for k, v in marks._asdict().items()}
            end = pa.scalar("", pa.large_string())
            psm = pc.binary_join_element_wise(mark["prefix"], prefix, mark["suffix"], suffix, mark["middle"], middle, end)
            spm = pc.binary_join_element_wise(mark["suffix"], suffix, mark["prefix"], prefix, mark["middle"], middle, end)
            plain = pc.equal(form, "plain")
            output = pc.if_else(plain, texts, pc.if_else(pc.equal(form, "psm"), psm, spm))
            chars = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(x).cast(pa.int64())) for x in (prefix, middle)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), form, *chars, output.cast(pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, suffix_first: int = 50, marks: Marks = Marks()) -> DataFrame:
    """``docs(doc_id long, text string, ...)`` -> ``doc_id, n, form, prefix_chars, middle_chars, output``, a row for each.

    ``n`` is the number of lines; the two cuts lie between lines. ``rate`` percent of the documents are cut, and of these
    ``suffix_first`` percent take the form ``spm``, the others ``psm``. Null and empty texts, and texts that hold a mark
    already, stay as they are: form ``plain``, without sizes. Rows that share an id are cut by the same draws; a null id
    draws as one without digits. Texts of any length are taken whole, an empty table gives an empty result, and other
    columns are left out, whatever their names.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    marked = F.contains("text", F.lit(marks.prefix)) | F.contains("text", F.lit(marks.suffix)) | F.contains("text", F.lit(marks.middle))
    form = F.when((F.col("text") == "") | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")
    return arrow_map(rows.select("doc_id", "text", h1.alias("h1"), h2.alias("h2"), form.alias("form")), _cut(marks), CUT)


def restored(output: Column, form: Column, marks: Marks = Marks()) -> Column:
    """The text that an output was made of. Its three marks occur once each, so the parts lie between them."""
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in marks), -1)
    back = F.transform(F.array(parts), lambda p: F.when(form == "psm", F.concat(p[1], p[3], p[2])).otherwise(F.concat(p[2], p[3], p[1])))[0]
    return F.when(form == "plain", output).otherwise(back)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    back = restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units FROM documents
), u AS (
  SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS y,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 100 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM t
), c AS (
  SELECT *, array_to_string(units[1:least(x, y)], '') AS prefix, array_to_string(units[least(x, y) + 1:greatest(x, y)], '') AS middle,
         array_to_string(units[greatest(x, y) + 1:], '') AS suffix
  FROM u
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM c
"""
