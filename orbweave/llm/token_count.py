"""Token counts of sections by offset-mapped attribution.

A document is encoded whole, once. Its tokens' spans follow from their byte lengths (byte-level tokens
concatenate to the text), and an interval join of two sorted lists, token starts and section ends, gives each
token its section. A token that crosses a section's end counts, by rule, for the section of its
first character ("start", the default) or of its last ("end"); n_crossing tells how many a section so took
that reach beyond it. Counts of a document's sections add up to the count of the whole document.

A section ends after its separator. Null or empty texts have one section, empty; a separator at the very end
opens no further section. Rows of one id are counted each for itself; ids may be null and of any type; other
columns are left out; an empty table gives an empty one. Documents of any length: no task holds more than a slice
of texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orbweave.llm.common import byte_view, col, small_batches
from orbweave.llm.encoder import encoder, sliced

SCHEMA = "section int, start long, upto long, n_tokens long, n_crossing long"


def section_counts(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text_col: str = "text", separator: str = "\n", rule: str = "start") -> DataFrame:
    """A row for each section: doc_id, section (from 0), start and upto in characters, n_tokens, n_crossing."""
    if len(separator) != 1 or not separator.isascii() or rule not in ("start", "end"):
        raise ValueError("the separator is one ASCII character; the rule is 'start' or 'end'")

    def count(batches):
        enc = encoder(tokenizer)
        for whole in batches:
            for batch in sliced(whole, "text", 4 << 20):
                raw, off = byte_view(batch.column("text"))
                raw, off = raw[off[0] : off[-1]], off - off[0]
                ids, _ = enc.encode(batch.column("text"))
                ends = np.unique(np.concatenate([np.flatnonzero(raw == ord(separator)) + 1, off[1:]]))
                ends = ends[ends > 0]
                size = enc.n_bytes[ids]
                last = np.cumsum(size)
                first = np.searchsorted(ends, last - size, side="right")
                final = np.searchsorted(ends, last - 1, side="right")
                owner = first if rule == "start" else final
                tokens = np.bincount(owner, minlength=len(ends))
                crossing = np.bincount(owner[first != final], minlength=len(ends))
                doc = np.searchsorted(off[1:], ends - 1, side="right")
                begin = np.concatenate([[0], ends[:-1]])[: len(ends)]
                chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                number = np.arange(len(ends)) - np.searchsorted(doc, doc, side="left")
                empty = np.flatnonzero(np.diff(off) == 0)
                none = np.zeros(len(empty), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(pa.array(np.concatenate([doc, empty]))),
                        pa.array(np.concatenate([number, none]).astype(np.int32)),
                        *[pa.array(np.concatenate([x, none])) for x in (chars[begin] - chars[off[doc]], chars[ends] - chars[off[doc]], tokens, crossing)],
                    ],
                    names=["id", "section", "start", "upto", "n_tokens", "n_crossing"],
                )

    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(col(doc_id).alias("id"), col(text_col).alias("text"))
    return rows.mapInArrow(count, f"id {kind}, {SCHEMA}").withColumnRenamed("id", doc_id)
