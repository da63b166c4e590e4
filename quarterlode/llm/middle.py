"""Fill-in-the-middle: texts are cut into three parts and put in another order behind markers, by pyarrow.compute.

A batch goes through one pipeline of Arrow kernels: texts are split into lists of units, the lists are flattened with the
index of their parent, each unit gets its ordinal, units are filtered by role (prefix, middle, suffix), lists are rebuilt
for each role and joined, and the joined parts are put together. Units are told apart in bytes: a mark that no UTF-8 text
holds (0xFF) is put behind each, so no text needs escaping.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterlode.llm.common import documents, small_batches

#: A run of letters, else one code point: an ASCII sign or a lead byte with what follows it.
UNIT = rb"([A-Za-z]+|[\x00-\x40\x5B-\x60\x7B-\x7F]|[\xC0-\xFD][\x80-\xBF]*)"
MARK = b"\xff"
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_FROM, SPM_BELOW = 90, 20
BATCH_BYTES = 8_000_000  # of texts that go through the pipeline at once; a longer text goes alone


def draws(doc_id: Column, seed: int = 1) -> list[Column]:
    """Four unsigned 32-bit draws from the SHA-256 of `<seed>:<doc_id>`; a null id counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def units(texts: pa.Array) -> pa.ListArray:
    """Lists of units of binary texts."""
    marked = pc.replace_substring_regex(texts, pattern=UNIT, replacement=rb"\1" + MARK)
    return pc.split_pattern(marked, pattern=MARK)


def _joined(values: pa.Array, parents: np.ndarray, keep: np.ndarray, rows: int) -> pa.Array:
    """The kept units of each row, in order, as one binary."""
    chosen = values.filter(pa.array(keep))
    ends = np.r_[0, np.cumsum(np.bincount(parents[keep], minlength=rows))]
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), chosen), pa.scalar(b"", pa.binary()))


def transform(texts: pa.Array, one: np.ndarray, two: np.ndarray, three: np.ndarray, four: np.ndarray) -> dict[str, pa.Array]:
    """n, form, prefix_chars, middle_chars, output and restored of binary texts without nulls, by four draws a text."""
    rows = len(texts)
    lists = units(texts)
    # each text ends with a mark, so its list with an empty unit; that of an empty text is this unit alone
    n = pc.subtract(pc.list_value_length(lists), 1).to_numpy(zero_copy_only=False).astype(np.int64)
    values, parents = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy().astype(np.int64)
    ordinals = np.arange(len(values)) - (np.cumsum(n + 1) - (n + 1))[parents]
    low, high = np.minimum(one % (n + 1), two % (n + 1)), np.maximum(one % (n + 1), two % (n + 1))
    prefix = _joined(values, parents, ordinals < low[parents], rows)
    middle = _joined(values, parents, (ordinals >= low[parents]) & (ordinals < high[parents]), rows)
    suffix = _joined(values, parents, ordinals >= high[parents], rows)  # the empty unit adds nothing
    marked = pc.or_(pc.or_(pc.match_substring(texts, PREFIX), pc.match_substring(texts, SUFFIX)), pc.match_substring(texts, MIDDLE)).to_numpy(zero_copy_only=False)
    plain = (n == 0) | marked | (three % 100 >= PLAIN_FROM)
    spm = ~plain & (four % 100 < SPM_BELOW)
    form = pc.if_else(pa.array(plain), "plain", pc.if_else(pa.array(spm), "spm", "psm"))
    sep = pa.scalar(b"", pa.binary())
    psm_text = pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, sep)
    spm_text = pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, sep)
    output = pc.if_else(pa.array(plain), texts, pc.if_else(pa.array(spm), spm_text, psm_text))
    chars = lambda part: pc.if_else(pa.array(plain), pa.scalar(None, pa.int64()), pc.utf8_length(part.cast(pa.string())).cast(pa.int64()))
    return {"n": pa.array(n), "form": form, "prefix_chars": chars(prefix), "middle_chars": chars(middle), "output": output, "restored": restore(output, form)}


def restore(output: pa.Array, form: pa.Array) -> pa.Array:
    """The exact texts of outputs. No marker stands in a part of a transformed text, so the first of each ends a part."""

    def parts(first: bytes, second: bytes, third: bytes) -> tuple[pa.Array, pa.Array, pa.Array]:
        """What stands behind each of three markers, in their order; of other rows something without a meaning."""
        rest = _part(output, first, 1)
        a = _part(rest, second, 0)
        rest = _part(rest, second, 1)
        return a, _part(rest, third, 0), _part(rest, third, 1)

    sep = pa.scalar(b"", pa.binary())
    prefix, suffix, middle = parts(PREFIX, SUFFIX, MIDDLE)
    psm = pc.binary_join_element_wise(prefix, middle, suffix, sep)
    suffix, prefix, middle = parts(SUFFIX, PREFIX, MIDDLE)
    spm = pc.binary_join_element_wise(prefix, middle, suffix, sep)
    return pc.if_else(pc.equal(form, "plain"), output, pc.if_else(pc.equal(form, "spm"), spm, psm))


def _part(texts: pa.Array, marker: bytes, which: int) -> pa.Array:
    """What stands before (0) or behind (1) the first marker; empty where there is none behind it."""
    lists = pc.split_pattern(texts, pattern=marker, max_splits=1)
    padded = pc.list_slice(lists, which, which + 1)
    return pc.binary_join(padded, pa.scalar(b"", pa.binary()))


def fill_in_middle(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", seed: int = 1) -> DataFrame:
    """docs with the columns n, form, prefix_chars, middle_chars, output (binary UTF-8) and restored (the same).

    Null text counts as empty and stays plain; so do texts that hold a marker. Draws go by doc_id, so rows that repeat an
    id are cut by the same draws. Rows are independent: ties and repeated rows need no care. Existing columns of the new
    names are replaced. Empty table: empty result. Memory: BATCH_BYTES of texts, or the longest text, and its units."""
    made = ["n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    names = [f"_draw{i}" for i in range(4)]
    kept = [c for c in docs.columns if c not in made]
    inner = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_in") if kept else F.lit(0).alias("_in"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("_text"), *(d.alias(x) for d, x in zip(draws(F.col(f"`{doc_id}`"), seed), names, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = np.cumsum(pc.binary_length(whole.column("_text")).to_numpy())
            at = 0
            while at < whole.num_rows:
                so_far = sizes[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(sizes, so_far + BATCH_BYTES, "right")))
                batch = whole.slice(at, end - at)
                done = transform(batch.column("_text"), *(batch.column(x).to_numpy() for x in names))
                yield pa.RecordBatch.from_arrays([batch.column("_in"), *done.values()], names=["_in", *done])
                at = end

    schema = f"_in {inner.schema['_in'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output binary, restored binary"
    done = small_batches(inner).mapInArrow(run, schema)
    return done.select(*(F.col("_in").getField(c).alias(c) for c in kept), *made)


def op13_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


OP13_SQL = """
with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
u as (select doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') as u, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d),
c as (select *, len(u) as n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) as lo, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) as hi from u),
p as (select *, array_to_string(u[1:lo], '') as pre, array_to_string(u[lo + 1:hi], '') as mid, array_to_string(u[hi + 1:], '') as suf,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(pre) end::bigint as prefix_chars, case when form <> 'plain' then length(mid) end::bigint as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(t) as restored_sha256
from p
"""
