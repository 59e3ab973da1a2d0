"""Fill-in-the-middle examples, cut at code points through a sparse exception index.

Texts are handled as UTF-8 bytes. For a batch of texts only the characters of more than one byte
are recorded: the code point each one is at and the bytes it has beyond one, summed up. A cut
after ``c`` code points lies ``c`` bytes into the text plus the excess of all recorded characters
before it, which one ``searchsorted`` finds; within ASCII the conversion is plain arithmetic and
an ASCII text has no entries at all. ``ExceptionIndex`` converts both ways.

Two pseudo-random cuts per document make prefix, middle and suffix. They are taken from the SHA-256
of ``seed:doc_id``, so a document gets the same example in every run and on every cluster. The
digest is computed by Spark; only the cutting runs in Arrow batches, a few MiB of text at a time.

Defined cases: a null text counts as empty; empty texts and texts that hold a marker stay plain; a
null id counts as the empty string in the digest; equal ids with different texts are cut from the same numbers;
repeated rows give repeated rows; extra columns are ignored, whatever their names; an empty table
gives no rows. A text of any length is cut whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.llm.text import cuts, text_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
PLAIN_SHARE = 10  # percent of documents left as they are
SPM_SHARE = 20  # percent of the others with the suffix first
SEED = 1
BATCH_BYTES = 4 << 20


@dataclass
class ExceptionIndex:
    """The characters of more than one byte in some consecutive texts.

    ``points`` are their code points, ``places`` their first bytes, both counted from the first
    text on; ``excess[k]`` is the number of bytes that the first ``k`` of them have beyond one.
    """

    points: np.ndarray
    places: np.ndarray
    excess: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray) -> ExceptionIndex:
        places = np.flatnonzero(data >= 0xC0)
        lead = data[places]
        more = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        excess = np.zeros(len(places) + 1, np.int64)
        np.cumsum(more, out=excess[1:])
        return cls(places - excess[:-1], places, excess)

    def to_bytes(self, points: np.ndarray) -> np.ndarray:
        """Byte offsets of cuts given in code points."""
        return points + self.excess[np.searchsorted(self.points, points, "left")]

    def to_points(self, offsets: np.ndarray) -> np.ndarray:
        """Code points of cuts given in bytes; the bytes must lie between characters."""
        return offsets - self.excess[np.searchsorted(self.places, offsets, "left")]


def _draw(hashed: Column, part: int) -> Column:
    """The ``part``-th group of eight hexadecimal digits as an unsigned integer."""
    return F.conv(F.substring(hashed, 8 * part + 1, 8), 16, 10).cast("long")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``output`` to rows of (doc_id, text, n, form, low, high), and drops the text."""
    for whole in batches:
        for begin, size in cuts(whole.column("text"), BATCH_BYTES):
            batch = whole.slice(begin, size)
            data, bounds = text_bytes(batch.column("text"))
            index = ExceptionIndex.of(data)
            first = index.to_points(bounds[:-1])
            ends = [
                index.to_bytes(first + batch.column(name).to_numpy(zero_copy_only=False))
                for name in ("low", "high")
            ]
            raw, outputs = memoryview(data), []
            for form, start, low, high, end in zip(
                batch.column("form").to_pylist(), bounds[:-1].tolist(), *(e.tolist() for e in ends),
                bounds[1:].tolist(),
            ):
                if form == PLAIN:
                    outputs.append(bytes(raw[start:end]))
                    continue
                prefix = (PREFIX.encode(), raw[start:low])
                suffix = (SUFFIX.encode(), raw[high:end])
                parts = prefix + suffix if form == PSM else suffix + prefix
                outputs.append(b"".join(parts + (MIDDLE.encode(), raw[low:high])))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in ("doc_id", "n", "form", "low", "high")),
                 pa.array(outputs, pa.large_binary()).cast(pa.large_string())],
                ["doc_id", "n", "form", "low", "high", "output"],
            )


def fill_in_middle(
    docs: DataFrame, plain_share: int = PLAIN_SHARE, spm_share: int = SPM_SHARE, seed: int = SEED
) -> DataFrame:
    """Per document its length ``n``, the form, the sizes in code points, and the example's text."""
    text = F.coalesce("text", F.lit("")).alias("text")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = docs.select("doc_id", text, digest.alias("digest"))
    rows = rows.withColumn("n", F.char_length("text").cast("long"))
    marked = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(marker))
    plain = (F.col("n") == 0) | marked | (_draw(F.col("digest"), 2) % 100 >= 100 - plain_share)
    form = F.when(plain, PLAIN).when(_draw(F.col("digest"), 3) % 100 < spm_share, SPM).otherwise(PSM)
    one, two = (_draw(F.col("digest"), part) % (F.col("n") + 1) for part in (0, 1))
    rows = rows.select(
        "doc_id", "text", "n", form.alias("form"), F.least(one, two).alias("low"),
        F.greatest(one, two).alias("high"),
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = rows.mapInArrow(
        _cut, f"doc_id {kind}, n long, form string, low long, high long, output string"
    )
    cut = F.col("form") != PLAIN
    return made.select(
        "doc_id", "n", "form",
        F.when(cut, F.col("low")).alias("prefix_chars"),
        F.when(cut, F.col("high") - F.col("low")).alias("middle_chars"),
        "output",
    )


def restored(output: Column, form: Column) -> Column:
    """The text an example was made from.

    Cut texts hold no marker, so the three markers of the example are the only ones in it.
    """
    parts = F.split(output, "<[PSM]>")
    first, second, middle = (F.element_at(parts, at) for at in (2, 3, 4))
    return (
        F.when(form == PSM, F.concat(first, middle, second))
        .when(form == SPM, F.concat(second, middle, first))
        .otherwise(output)
    )
