"""Order, neighbours, gaps, carried headings and block coverage; the chunker."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _in_buckets(rows: DataFrame, ts: str, seconds: int) -> DataFrame:
    return rows.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("_b", F.floor(F.col("_us") / (seconds * 1_000_000)))


def gap_sessions(rows: DataFrame, group: str, ts: str, tie: str, gap_seconds: int, bucket_seconds: int = 86_400) -> DataFrame:
    """Adds session (from 0): a new one starts where the gap to the row before exceeds the limit.

    A group is cut into time buckets; rows are ordered inside their bucket only, and
    the buckets' own first, last and number of starts (one row a bucket) carry the
    state along the group.  So a group with very many rows is spread over tasks.
    Rows without a time or group are left out."""
    cut = _in_buckets(rows.where(F.col(ts).isNotNull() & F.col(group).isNotNull()), ts, bucket_seconds)
    inside = Window.partitionBy(group, "_b").orderBy(ts, tie)
    along = Window.partitionBy(group).orderBy("_b")
    edges = cut.groupBy(group, "_b").agg(F.max("_us").alias("_last")).select(group, "_b", F.lag("_last").over(along).alias("_before"))
    gap = F.col("_us") - F.coalesce(F.lag("_us").over(inside), F.col("_before"))
    flagged = cut.join(edges, [group, "_b"]).withColumn("_new", F.coalesce((gap > gap_seconds * 1_000_000).cast("int"), F.lit(0)))
    starts = flagged.groupBy(group, "_b").agg(F.sum("_new").alias("_n")).select(
        group, "_b", F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    running = F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return flagged.join(starts, [group, "_b"]).withColumn("session", (F.col("_base") + running).cast("int")).select(*rows.columns, "session")


def last_before(rows: DataFrame, group: str, ts: str, tie: str, value: Column, bucket_seconds: int = 86_400) -> DataFrame:
    """Adds last_value: the latest non-null ``value`` of the group strictly before the
    row in the order (ts, tie).  Cut into time buckets like :func:`gap_sessions`."""
    cut = _in_buckets(rows.where(F.col(ts).isNotNull() & F.col(group).isNotNull()), ts, bucket_seconds).withColumn("_v", value)
    inside = Window.partitionBy(group, "_b").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = cut.groupBy(group, "_b").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(ts, tie))).alias("_end")).select(
        group, "_b", F.last("_end", ignorenulls=True).over(along).alias("_carry"))
    return cut.join(ends, [group, "_b"]).withColumn("last_value", F.coalesce(F.last("_v", ignorenulls=True).over(inside), F.col("_carry"))).select(
        *rows.columns, "last_value")


def heading_score(heading: Column) -> Column:
    """How much a line looks like a heading: numbering, capitals, length, known section words."""
    h = F.coalesce(heading, F.lit(""))
    n = F.size(F.split(F.trim(h), r"\s+"))
    known = F.lower(h).rlike(r"\b(abstract|introduction|related work|method|experiments?|results?|limitations?|conclusion|references|appendix)\b")
    return (F.when(h.rlike(r"^[0-9]+(\.[0-9]+)*\.?\s"), 3.0).otherwise(0.0) + F.when((F.upper(h) == h) & h.rlike("[A-Z]"), 1.4).otherwise(0.0)
            + F.when(known, 3.2).otherwise(0.0) + F.when(n <= 8, 1.0).otherwise(0.0) - F.when(h.rlike(r"[.!?]$"), 2.0).otherwise(0.0))


def heading_confidence(score: Column) -> Column:
    return 1 / (1 + F.exp(-(score - 5.8) / 1.4))


def build_chunks(blocks: DataFrame, most: int = 1600, target: int = 1200, least: int = 250, overlap: int = 1) -> DataFrame:
    """Section-aware chunks of a document's blocks.

    ``blocks``: doc_id, block_no, section, text.  Blocks of one section are packed
    while they fit into ``most`` characters and the chunk is under ``target``; a
    block over ``most`` is cut at sentence ends, then hard; a short chunk joins the
    one before it in its section; ``overlap`` sentences of the chunk before, in the
    same section and where they fit, come first, but never into references.
    Result: doc_id, chunk_no, section, first_block, last_block, text, n_overlap.
    The state runs through a document, whose blocks come in order within one task;
    documents are spread over the cluster.  Blank blocks are left out.
    """
    schema = "doc_id string, chunk_no int, section string, first_block int, last_block int, text string, n_overlap int"

    def pack(doc: str, rows) -> list[tuple]:
        import re

        cut = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])")
        made: list[list] = []  # section, first, last, parts
        for _, block_no, in_section, raw in rows:
            text = (raw or "").strip()
            if not text:
                continue
            pieces = [text]
            if len(text) > most:
                pieces, held = [], ""
                for s in cut.split(text):
                    while len(s) > most:
                        if held:
                            pieces.append(held)
                            held = ""
                        pieces.append(s[:most])
                        s = s[most:]
                    if held and len(held) + 1 + len(s) > target:
                        pieces.append(held)
                        held = s
                    else:
                        held = f"{held} {s}".strip()
                if held:
                    pieces.append(held)
            for piece in pieces:
                if made and made[-1][0] == in_section:
                    size = sum(len(p) for p in made[-1][3]) + 2 * (len(made[-1][3]) - 1)
                    if size + 2 + len(piece) <= most and (size < target or len(piece) < least):
                        made[-1][2] = block_no
                        made[-1][3].append(piece)
                        continue
                made.append([in_section, block_no, block_no, [piece]])
        out, before = [], None
        for i, (section, first, last, parts) in enumerate(made):
            text, n = "\n\n".join(parts), 0
            if before and before[0] == section and section != "references" and overlap:
                tail = [s for s in cut.split(before[1]) if s][-overlap:]
                lead = " ".join(tail)
                if 30 <= len(lead) and len(lead) + 2 + len(text) <= most:
                    before = (section, text)
                    text, n = f"{lead}\n\n{text}", len(tail)
                else:
                    before = (section, text)
            else:
                before = (section, text)
            out.append((doc, i, section, first, last, text, n))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "chunk_no", "section", "first_block", "last_block", "text", "n_overlap"]
        rows = (r for b in batches for r in zip(b["doc_id"], b["block_no"], b["section"], b["text"]))
        made: list[tuple] = []
        for doc, own in groupby(rows, key=lambda r: r[0]):
            made += pack(doc, own)
            if len(made) >= 2000:
                yield pd.DataFrame(made, columns=names)
                made = []
        yield pd.DataFrame(made, columns=names)

    ordered = blocks.select("doc_id", "block_no", "section", "text").repartition("doc_id").sortWithinPartitions("doc_id", "block_no")
    return ordered.mapInPandas(run, schema)
