"""HTML snapshots to provisions: pages become flat text blocks in one pass per page, the rest is relational."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kvist.functions.text import canonical_url, clean_text, strip

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that end an open tag of the same kind (or of the kinds named) when they begin.
IMPLIED = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "table", "div", "section", "main", "body", "html", "dl", "select"}
BLOCKS = "pos int, kind string, block int, item int, text string"


class _Blocks(HTMLParser):
    """Collects (pos, kind, block, item, text): the pieces of text that provisions are made of.

    kind: chapter (header of a chapter block), heading, body (one begins), reg, label, guide. block: the number of the heading that a section follows, or of the chapter.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, frozenset[str], dict]] = []
        self.rows: list[tuple[int, str, int, int, str]] = []
        self.headings = self.items = self.chapters = 0
        self.roots: dict[str, bool] = {}  # the kinds of document root that began
        self.inside: list[frozenset[str]] = []  # of each row, the roots it lies in
        self.pending: dict[int, int] = {}  # depth of a heading's parent: the heading that waits for a body
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in IMPLIED.get(tag, ()):
                self._close(i)
                break
            if self.stack[i][0] in SCOPE:
                break
        classes = frozenset((dict(attrs).get("class") or "").split())
        depth, info = len(self.stack), {}
        inside = lambda c: any(c in s[1] for s in self.stack)
        if tag == "div" and "print-chapter-content" in classes:
            self.chapters += 1
            info["chapter"] = self.chapters
        elif tag == "div" and "block-header" in classes:
            info["block-header"] = True
        elif tag == "h2" and "big-header" in classes and inside("print-chapter-content"):
            self.headings += 1
            info["heading"] = self.pending[depth] = self.headings
        elif tag == "section" and "section-big" in classes and depth in self.pending:
            info["body"] = self.pending.pop(depth)
            self._add("body", info["body"], "", self.stack)
        elif tag == "ul" and "guidance-text" in classes:
            info["guidance"] = True
        elif tag == "li" and "accordion-navigation" in classes:
            self.items += 1
            info["item"] = self.items
        elif "accordion-title" in classes:
            info["label"] = True
        elif tag == "div" and "content" in classes:
            info["content"] = True
        if tag in ("script", "style"):
            self.silent += 1
        for root in (["content"] if "print-document-content" in classes else []) + (["main"] if tag == "main" else []):
            if root not in self.roots:  # the first one counts
                self.roots[root] = info[f"root-{root}"] = True
        self.stack.append((tag, classes, info))

    def _close(self, i: int) -> None:
        for tag, _, _ in self.stack[i:]:
            self.silent -= tag in ("script", "style")
        for d in [d for d in self.pending if d > i]:
            del self.pending[d]
        del self.stack[i:]

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self._close(i)
                break

    def _add(self, kind: str, block: int, text: str, stack: list, item: int = 0) -> None:
        self.rows.append((len(self.rows), kind, block, item, text))
        self.inside.append(frozenset(r for r in ("content", "main") if any(f"root-{r}" in x for _, _, x in stack)))

    def handle_data(self, data):
        text = data.strip()
        if not text or self.silent:
            return
        info: dict = {}
        for _, _, x in self.stack:
            info |= x
        add = lambda kind, block, item=0: self._add(kind, block, text, self.stack, item)
        if "block-header" in info and "chapter" in info and "body" not in info:
            add("chapter", info["chapter"])
        elif "heading" in info:
            add("heading", info["heading"])
        elif "body" in info:
            if "guidance" in info:
                if "item" in info and ("label" in info or "content" in info):
                    add("label" if "label" in info else "guide", info["body"], info["item"])
            else:
                add("reg", info["body"])


def html_blocks(html: str | bytes | None) -> list[tuple[int, str, int, int, str]]:
    """The text blocks of a page, in order; see _Blocks. Unclosed tags are closed where their parent ends.

    Only the document root counts: the first print-document-content, else the first main, else the whole page.
    """
    if not html:
        return []
    p = _Blocks()
    p.feed(html.decode("utf-8", "replace") if isinstance(html, bytes) else html)
    p.close()
    root = next((r for r in ("content", "main") if r in p.roots), None)
    return [row for row, inside in zip(p.rows, p.inside) if root is None or root in inside]


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of stored pages."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def page_blocks(pages: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, pos, kind, block, item, text) of all pages; each is parsed alone, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = html_blocks(batch.column(1)[k].as_py())
                cols = list(zip(*rows)) or [()] * 5
                kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k] * len(rows), pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=[key, "pos", "kind", "block", "item", "text"])

    return pages.select(key, content).mapInArrow(run, f"`{key}` {pages.schema[key].dataType.simpleString()}, {BLOCKS}")


def provisions_of(blocks: DataFrame, key: str = "path") -> DataFrame:
    """(key, pos, chapter, section_id, title, reg_text, guidance_text, full_text), one row per provision.

    A heading must begin with § and hold an id like 8-5 or 8-5a, and a body must follow it before the next
    heading; else it gives none. The chapter is that of the last chapter header before it.
    """
    joined = lambda sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), sep)
    chapters = blocks.filter("kind = 'chapter'").groupBy(key, "block").agg(F.min("pos").alias("pos"), joined(" ").alias("chapter"))
    headings = blocks.filter("kind = 'heading'").groupBy(key, "block").agg(F.min("pos").alias("pos"), strip(joined(" ")).alias("heading"))
    carried = headings.select(key, "block", "pos", "heading", F.lit(None).cast("string").alias("chapter")).unionByName(
        chapters.select(key, F.lit(None).cast("int").alias("block"), "pos", F.lit(None).cast("string").alias("heading"), "chapter")
    )
    carried = carry_forward(carried, "chapter", "pos", key).filter("heading IS NOT NULL")
    # Fixed value: the form of a section number in a heading.
    number = F.regexp_extract("heading", r"(?U)§\s*(\d{1,2}-\d{1,2}[a-zA-Z]?)", 1)
    found = carried.filter(F.startswith("heading", F.lit("§")) & (number != ""))
    found = found.withColumns({"section_id": F.concat(F.lit("§ "), number), "title": strip(F.regexp_replace("heading", r"(?U)^§\s*\d{1,2}-\d{1,2}[a-zA-Z]?\s*[.\-–:]?\s*", ""))})
    reg = blocks.filter("kind = 'reg'").groupBy(key, "block").agg(clean_text(joined("\n")).alias("reg_text"))
    items = blocks.filter("kind IN ('label', 'guide')").groupBy(key, "block", "item").agg(
        F.min("pos").alias("at"),
        F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("pos", "kind", "text"))), lambda x: x["kind"] == "label"), lambda x: x["text"]), " ").alias("label"),
        clean_text(F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("pos", "kind", "text"))), lambda x: x["kind"] == "guide"), lambda x: x["text"]), "\n")).alias("body"),
    ).filter("body <> ''")
    part = F.concat(F.when(F.col("label") != "", F.col("label")).otherwise(F.lit("Veiledning")), F.lit("\n"), "body")
    guidance = items.groupBy(key, "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", part.alias("p")))), lambda x: x["p"]), "\n\n").alias("guidance_text"))
    bodies = blocks.filter("kind = 'body'").select(key, "block").distinct()
    both = found.join(bodies, [key, "block"], "left_semi").join(reg, [key, "block"], "left").join(guidance, [key, "block"], "left")
    both = both.withColumns({"reg_text": F.coalesce("reg_text", F.lit("")), "guidance_text": F.coalesce("guidance_text", F.lit(""))})
    return both.select(key, "pos", "chapter", "section_id", "title", "reg_text", "guidance_text", full_text().alias("full_text"))


def carry_forward(df: DataFrame, column: str, order: str, *keys: str, out: str | None = None) -> DataFrame:
    """The last value of column that isn't null, up to each row, within the keys."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(out or column, F.last(column, ignorenulls=True).over(w))


def full_text():
    """Regulation and guidance, joined by an empty line; empty ones are left out."""
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    return F.concat_ws("\n\n", some("reg_text"), some("guidance_text"))


def provision_records(provisions: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The fourteen columns of the provisions file: provisions (source_path, ...) with their snapshots' lines (source_path, url, ...)."""
    return provisions.join(snapshots, "source_path").select(
        F.lit("dibk").alias("source"), F.lit("provision").alias("doc_type"), F.col("url").alias("root_print_url"), "final_url",
        canonical_url(F.coalesce(F.when(F.col("final_url") != "", F.col("final_url")), "url")).alias("canonical_root_print_url"), "downloaded_at", "source_path", "sha256",
        "chapter", "section_id", "title", "reg_text", "guidance_text", "full_text", "pos",
    )
