"""Token counts by section: whole documents are encoded once, token spans are interval-joined to sections.

A document is rendered as one string of sections, each a field with its label or a part of the text. Tokens of the
whole string are byte-exact, so running token lengths give their spans. A token inside one section counts there. One
that crosses a boundary is allocated by `rule`: "most" gives it to the section that holds most of its bytes (of
equal ones the earliest), "first" to the section it begins in, "share" splits it in proportion (doubles).

Defined cases: a null field renders as empty, its label stays; an empty text has empty head and body sections with
their separators; empty sections get no tokens; counts of a document add up to its tokens; repeated rows are each
reported under a row number of their own; null ids pass through; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .runtime import ddl, shards, text_buffers, tuned
from .tokenise import BYTE_BPE, byte_encoding, vocabulary_path

RULES = ("most", "first", "share")


def document_sections(docs: DataFrame, fields: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """doc_id and parts: array of (section, text). Fields come first, then the text's first line and the rest."""
    text = F.coalesce(F.col("text"), F.lit(""))
    line = F.substring_index(text, "\n", 1)
    part = lambda name, value: F.struct(F.lit(name).alias("section"), value.alias("text"))
    parts = [part(f, F.concat(F.lit(f"{f}: "), F.coalesce(F.col(f).cast("string"), F.lit("")), F.lit("\n"))) for f in fields]
    parts += [part("head", F.concat(F.lit("\n"), line)), part("body", F.expr("substring(coalesce(text, ''), length(substring_index(coalesce(text, ''), '\n', 1)) + 1)"))]
    return docs.select("doc_id", F.array(*parts).alias("parts"))


def allocate(token: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and crossing tokens that touch it. token: n + 1 offsets; bounds: sections + 1 offsets."""
    sections = len(bounds) - 1
    a, b = token[:-1], token[1:]
    first = np.searchsorted(bounds, a, "right") - 1
    last = np.searchsorted(bounds, b - 1, "right") - 1
    count = np.zeros(sections)
    inside = first == last
    count += np.bincount(first[inside], minlength=sections)
    over = np.flatnonzero(~inside)
    section, which = B.expand(first[over], last[over] - first[over] + 1)
    held = np.minimum(b[over][which], bounds[section + 1]) - np.maximum(a[over][which], bounds[section])
    touched = np.bincount(section[held > 0], minlength=sections)
    if rule == "share":
        count += np.bincount(section, held / (b - a)[over][which], sections)
    elif len(over):
        best = first[over] if rule == "first" else section[np.lexsort((section, -held, which))[np.cumsum(np.bincount(which)) - np.bincount(which)]]
        count += np.bincount(best, minlength=sections)
    return count, touched


def attribute_tokens(sections: DataFrame, rule: str = "most", vocabulary: str = BYTE_BPE) -> DataFrame:
    """doc_id, row, position, section, start_char, end_char, n_tokens, n_crossing, doc_tokens of every section."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    tuned(sections.sparkSession)
    path = vocabulary_path(vocabulary)
    kind = pa.float64() if rule == "share" else pa.int64()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, "whole", keep="bytes"):
            encoding, size = byte_encoding(path)
            parts = shard.column("parts").combine_chunks()
            flat = parts.flatten()
            names, texts = flat.field("section"), flat.field("text")
            data, offs = text_buffers(texts)
            per_doc = np.diff(parts.offsets.to_numpy())
            doc = np.repeat(np.arange(len(per_doc)), per_doc)
            whole = shard.column("whole").to_pylist()
            lens = [size[np.array(encoding.encode_ordinary(x), np.int64)] for x in whole]
            token = np.concatenate(([0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *lens]))))
            counts, crossing = allocate(token, offs, rule)
            lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offs]
            base = lead[np.concatenate(([0], np.cumsum(per_doc)))[:-1]]
            yield from pa.table(
                {
                    "doc_id": shard.column("doc_id").combine_chunks().take(pa.array(doc)), "row": shard.column("row").combine_chunks().take(pa.array(doc)),
                    "position": pa.array((np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)).astype(np.int32)), "section": names,
                    "start_char": lead[:-1] - base[doc], "end_char": lead[1:] - base[doc], "n_tokens": pa.array(counts if rule == "share" else counts.astype(np.int64), kind), "n_crossing": crossing.astype(np.int64),
                    "doc_tokens": np.array([len(x) for x in lens], np.int64)[doc],
                }
            ).to_batches()

    whole = sections.select("doc_id", F.monotonically_increasing_id().alias("row"), F.expr("filter(coalesce(parts, array()), p -> p.text is not null)").alias("parts")).withColumn("whole", F.expr("concat_ws('', parts.text)"))
    number = "double" if rule == "share" else "bigint"
    return whole.mapInArrow(work, f"{ddl(sections, ['doc_id'])}, row bigint, position int, section string, start_char bigint, end_char bigint, n_tokens {number}, n_crossing bigint, doc_tokens bigint")
