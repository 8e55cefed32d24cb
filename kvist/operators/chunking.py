"""From provisions to chunks: documents, structural units, greedy packing with overlap."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvist.functions.text import UNIT_START, strip, text
from kvist.session import spread

SIZE, OVERLAP = 800, 200
#: Separators of oversized units, the strongest first.
SEPARATORS = ["\n\n", "\n", ". ", " ", ""]


def documents_of(provisions: DataFrame) -> DataFrame:
    """(ord, source, section_id, title, chapter, text_type, text): up to two documents per provision, with a header.

    Blank texts give none; a missing section id counts as ``unknown``, missing titles as empty.
    """
    section, title = F.coalesce("section_id", F.lit("unknown")), text(F.col("title"))
    doc = lambda kind, label, body: F.struct(
        F.lit(kind).alias("text_type"), strip(text(F.col(body))).alias("body"),
        F.concat(section, F.lit(" – "), title, F.lit(f"\n({label})\n\n"), strip(text(F.col(body)))).alias("text"),
    )
    both = F.array(doc("regulation", "Forskriftstekst", "reg_text"), doc("guidance", "Veiledning", "guidance_text"))
    provisions = spread(provisions.select("_ord", "source", "section_id", "title", "chapter", "reg_text", "guidance_text"), "_ord")
    rows = provisions.select(F.col("_ord").alias("ord"), F.coalesce("source", F.lit("")).alias("source"), section.alias("section_id"), title.alias("title"), "chapter", F.explode(both).alias("d"))
    return rows.filter("d.body <> ''").select("ord", "source", "section_id", "title", "chapter", "d.text_type", "d.text")


def header_and_body(c: Column) -> tuple[Column, Column]:
    """What stands up to and with the first empty line, and the rest; no empty line: no header."""
    at = F.instr(c, "\n\n")
    return F.when(at > 0, F.substring(c, F.lit(1), at + 1)).otherwise(F.lit("")), F.when(at > 0, F.substring(c, at + 2, F.length(c))).otherwise(c)


def structural_units(body: Column) -> Column:
    """The units of a body: stripped lines, a new unit at each numbered, lettered or bulleted line.

    Guard: eight lines or more of which nearly each would be a unit stay one. Built from higher-order
    functions within the row; no shuffle.
    """
    lines = F.filter(F.transform(F.split(text(body), r"\r\n|[\n\r]"), strip), lambda x: x != "")
    return F.element_at(F.transform(F.array(lines), _units), 1)


def _units(lines: Column) -> Column:
    joined = F.aggregate(
        lines, F.array().cast("array<string>"),
        lambda acc, x: F.when((F.size(acc) == 0) | x.rlike(UNIT_START), F.concat(acc, F.array(x))).otherwise(
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.lit("\n"), x)))
        ),
    )
    one = lambda units: F.when((F.size(lines) >= 8) & (F.size(units) >= F.size(lines) - 1), F.array(F.array_join(lines, "\n"))).otherwise(units)
    return F.element_at(F.transform(F.array(joined), one), 1)


def split_large(body: str, limit: int, overlap: int, separators: list[str] = SEPARATORS) -> list[str]:
    """Parts of at most limit code points: the strongest separator first, weaker ones for what stays too long.

    Neighbouring parts repeat whole pieces of up to ``overlap`` code points. Blank parts are dropped.
    """
    k = next((i for i, s in enumerate(separators) if s == "" or s in body), len(separators) - 1)
    sep, weaker = separators[k], separators[k + 1 :]
    pieces = list(body) if sep == "" else [p for p in body.split(sep) if p]
    out: list[str] = []
    held: list[str] = []
    size = 0
    for p in pieces:
        if len(p) > limit:
            if held:
                out.append(sep.join(held))
                held, size = [], 0
            out += split_large(p, limit, overlap, weaker)
            continue
        extra = len(p) + (len(sep) if held else 0)
        if held and size + extra > limit:
            out.append(sep.join(held))
            while held and (size > overlap or size + len(sep) + len(p) > limit):
                size -= len(held[0]) + (len(sep) if len(held) > 1 else 0)
                held = held[1:]
            extra = len(p) + (len(sep) if held else 0)
        held.append(p)
        size += extra
    if held:
        out.append(sep.join(held))
    return [o.strip() for o in out if o.strip()]


def pack_units(header: str, units: list[str], size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[str, int, int]]:
    """(chunk, first unit, last unit), counted from 1: units packed greedily under size, repeating whole units as overlap.

    A unit that is too long for a chunk is split alone; its parts carry the same unit number.
    """
    room = max(1, size - len(header))
    out: list[tuple[str, int, int]] = []
    at = 0
    while at < len(units):
        if len(units[at]) > room:
            out += [(header + p, at + 1, at + 1) for p in split_large(units[at], room, min(overlap, max(0, room - 1)))]
            at += 1
            continue
        end, length = at, len(header)
        while end < len(units):
            more = len(units[end]) + (2 if end > at else 0)
            if end > at and length + more > size:
                break
            length, end = length + more, end + 1
        out.append((header + "\n\n".join(units[at:end]), at + 1, end))
        if end >= len(units):
            break
        back, seen = end, 0
        while overlap > 0 and back > at and seen < overlap:
            back -= 1
            seen += len(units[back]) + 2
        at = end if overlap <= 0 else back if back > at else max(at + 1, end - 1)
    return out


def chunk_documents(documents: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks (text, metadata, ord, piece) of documents: units in the JVM, the sequential packing over Arrow batches.

    Each document is packed alone, so nothing is shuffled; blank bodies give no chunk.
    """
    header, body = header_and_body(F.col("text"))
    meta = ["source", "section_id", "title", "chapter", "text_type"]
    ready = documents.select("ord", *meta, header.alias("header"), structural_units(body).alias("units"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (i, k, *chunk)
                for i, (head, units) in enumerate(zip(batch.column("header").to_pylist(), batch.column("units").to_pylist()))
                for k, chunk in enumerate(pack_units(head, units, size, overlap))
            ]
            at = pa.array([r[0] for r in rows], pa.int64())
            cols = [batch.column(n).take(at) for n in ("ord", *meta)]
            more = [pa.array([r[j] for r in rows], kind) for j, kind in ((1, pa.int32()), (2, pa.string()), (3, pa.int32()), (4, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*cols, *more], names=["ord", *meta, "piece", "text", "para_start", "para_end"])

    out = ready.mapInArrow(run, "ord bigint, source string, section_id string, title string, chapter string, text_type string, piece int, text string, para_start int, para_end int")
    return out.select("ord", "piece", "text", F.struct(*meta, "para_start", "para_end").alias("metadata"))
