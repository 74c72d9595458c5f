"""Fill-in-middle transformation: a text's lines in the order that a model needs to learn the missing middle.

The text is cut into lines, two cuts part them into prefix, middle and suffix, and marks with the parts in another order
make up the output. All of it runs on whole Arrow batches with pyarrow.compute: lines as lists, flattened with the number
of their text, told apart by their ordinals, put back together as lists of each part and joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesledger.llm.columns import fresh, quoted

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
RATE, SPM_RATE = 100, 50
"""Hundredths of the texts that are changed, and of these the ones that begin with the suffix."""

SLICE_BYTES = 8 << 20
"""Text that is worked on at once; a longer text is a slice of its own."""

ADDED = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}


def draws(seed: int, key: str = "doc_id") -> Column:
    """Four numbers from 0 to 2**32 - 1 as an array, from the digest of seed and key; a null key counts as an empty text."""
    digest = f"sha2(concat('{seed}:', coalesce(CAST({quoted(key)} AS STRING), '')), 256)"
    return F.expr(f"transform(sequence(0, 3), i -> CAST(conv(substring({digest}, 8 * i + 1, 8), 16, 10) AS BIGINT))")


def _joined(lines: pa.Array, picked: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The picked lines of all texts as one string per text, which has ``counts`` of them."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), lines.filter(pa.array(picked))), "")


def transformed(text: pa.Array, drawn: np.ndarray, rate: int, spm_rate: int) -> dict[str, pa.Array]:
    """The added columns for texts without nulls; ``drawn`` has the four numbers of each text as a row."""
    split = pc.split_pattern(text, "\n")
    pieces = pc.list_value_length(split).to_numpy().astype(np.int64)
    starts = np.cumsum(pieces) - pieces
    parent = pc.list_parent_indices(split).to_numpy()
    flat = pc.list_flatten(split)
    ordinal = np.arange(len(flat)) - starts[parent]
    # All pieces but a text's last had a line feed; a last piece without a character is no line, and adds nothing.
    ends = pc.if_else(pa.array(ordinal < pieces[parent] - 1), pa.scalar("\n"), pa.scalar(""))
    lines = pc.binary_join_element_wise(flat, ends, "")
    bare = pc.equal(pc.binary_length(flat.take(pa.array(starts + pieces - 1))), 0).to_numpy(zero_copy_only=False)
    n = pieces - bare

    cuts = drawn[:, :2] % (n + 1)[:, None]
    low, high = cuts.min(axis=1), cuts.max(axis=1)
    prefix = _joined(lines, ordinal < low[parent], low)
    middle = _joined(lines, (ordinal >= low[parent]) & (ordinal < high[parent]), high - low)
    suffix = _joined(lines, ordinal >= high[parent], pieces - high)

    marked = pc.or_(pc.or_(pc.match_substring(text, PREFIX), pc.match_substring(text, SUFFIX)), pc.match_substring(text, MIDDLE))
    plain = pc.or_(pc.or_(marked, pc.equal(pc.binary_length(text), 0)), pa.array(drawn[:, 2] % 100 >= rate))
    spm = pa.array(drawn[:, 3] % 100 < spm_rate)
    psm_text = pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, "")
    spm_text = pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, "")
    none = pa.scalar(None, pa.int64())
    return {
        "n": pa.array(n),
        "form": pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm")),
        "prefix_chars": pc.if_else(plain, none, pc.cast(pc.utf8_length(prefix), pa.int64())),
        "middle_chars": pc.if_else(plain, none, pc.cast(pc.utf8_length(middle), pa.int64())),
        "output": pc.if_else(plain, text, pc.if_else(spm, spm_text, psm_text)),
    }


def _slices(batch: pa.RecordBatch, text: pa.Array) -> Iterator[tuple[int, int]]:
    """Start and length of runs of rows with about SLICE_BYTES of text."""
    sizes = np.cumsum(pc.binary_length(text).to_numpy())
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, "right")))
        yield at, end - at
        at = end


def fill_in_middle(
    docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """``docs`` with n (lines), form (plain, psm or spm), prefix_chars, middle_chars (code points) and output.

    A null text counts as an empty one; an empty text, one that holds a mark and one that the draw leaves out are plain: their
    output is the text, their lengths are null. Cuts and form follow from seed and key alone, so rows that
    repeat a key and a text are alike and a task that runs again writes the same; rows with a null key draw alike. Texts of any
    length are read whole. Other columns pass through; existing ones with the names above are replaced.
    """
    columns = [c for c in docs.columns if c not in ADDED]
    whole, drawn = fresh("text", docs.columns), fresh("draws", docs.columns)
    given = docs.select(
        *[F.col(quoted(c)) for c in columns],
        F.expr(f"coalesce(CAST({quoted(text)} AS STRING), '')").alias(whole),
        draws(seed, key).alias(drawn),
    )
    schema = T.StructType([*given.schema.fields[:-2], *T._parse_datatype_string(", ".join(f"{c} {t}" for c, t in ADDED.items())).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows in _slices(batch, batch[whole]):
                part = batch.slice(at, rows)
                numbers = pc.list_flatten(part[drawn]).to_numpy().reshape(rows, 4)
                added = transformed(part[whole], numbers, rate, spm_rate)
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], *added.values()], [*columns, *added])

    return given.mapInArrow(run, schema)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made from: the marks stand in it once each, so it is cut at them."""
    parts = f"split({quoted(output)}, '{PREFIX}|{SUFFIX}|{MIDDLE}')"
    return F.expr(
        f"""CASE {quoted(form)} WHEN 'plain' THEN {quoted(output)}
            WHEN 'psm' THEN array_join(transform(array({parts}), p -> concat(p[1], p[3], p[2])), '')
            ELSE array_join(transform(array({parts}), p -> concat(p[2], p[3], p[1])), '') END"""
    )


def digest(made: DataFrame) -> DataFrame:
    """Digests of the outputs and of the texts rebuilt from them."""
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored().cast("binary"), 256).alias("restored_sha256"),
    )


def oracle_sql(seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> str:
    """The query's columns in DuckDB's SQL, with lists of lines; the restored text is the text itself."""
    number = "CAST('0x' || substr(h, {}, 8) AS BIGINT)"
    part = "array_to_string(u[{}:{}], '')"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u,
                      sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    r AS (SELECT *, CAST(len(u) AS BIGINT) AS n, {number.format(1)} % (len(u) + 1) AS a, {number.format(9)} % (len(u) + 1) AS b FROM d),
    p AS (SELECT doc_id, text, n,
                 CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}')
                           OR {number.format(17)} % 100 >= {rate} THEN 'plain'
                      WHEN {number.format(25)} % 100 < {spm_rate} THEN 'spm' ELSE 'psm' END AS form,
                 {part.format(1, "least(a, b)")} AS p, {part.format("least(a, b) + 1", "greatest(a, b)")} AS m,
                 {part.format("greatest(a, b) + 1", "n")} AS s FROM r)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
                       ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM p"""
