"""Markup residue in text documents (problem 2): clean text by wrapper induction.

Each text becomes a tree (``markup.parse``). The trees of one host are aligned by simple tree
matching: a node matches a node of the same tag, siblings keep their order, and the alignment of
greatest total match wins. Nodes whose text stays the same over the pages of a host are its
template; nodes whose text varies are slots and hold the content. Constant paragraphs that stand
free (licence lines, footers, navigation) are left out of the clean text; constant headings, items
and table heads label the slots and stay.

A host may have any number of pages: pages are aligned in blocks of bounded size. The pages that
hold a text are then counted over all blocks of the host, also where a block has it once; a text
that blocks have several times is constant if any of them has it at the same node of two pages.
Pages of equal trees count once, so copies do not make their content a template.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.match import sized
from ..plans.tables import keep
from .arrow import parts, strings
from .markup import Block, kind, parse, render
from .oneform import one_form

#: Pages aligned with each other at once.
BLOCK = 64
#: A constant node is template from so many pages of a host on, however many pages the host has.
LEAST_PAGES = 5
#: Templates are broadcast up to this many nodes (about 100 bytes each), else joined by host and page.
BROADCAST_NODES = 100_000

_GROUPED = {"li": "ul", "tr": "table"}


class Node:
    """A node of a tree: tag, hash of its text, children."""

    __slots__ = ("tag", "texts", "children")

    def __init__(self, tag: str, text: int | None = None) -> None:
        self.tag = tag
        #: how many of the aligned pages have which text here
        self.texts: dict[int, int] = {} if text is None else {text: 1}
        self.children: list[Node] = []


def tree(tags: list[str], texts: list[int]) -> list[Node]:
    """The children of the root: blocks, with runs of items and rows under a node of their own."""
    found: list[Node] = []
    for tag, text in zip(tags, texts):
        tag = kind(tag)
        over = _GROUPED.get(tag)
        if over:
            if not found or found[-1].tag != over:
                found.append(Node(over))
            found[-1].children.append(Node(tag, text))
        else:
            found.append(Node(tag, text))
    return found


def _weight(a: Node, b: Node) -> int:
    """Simple tree matching of two nodes; an equal text counts as one more match."""
    if a.tag != b.tag:
        return 0
    same = 1 if b.texts and next(iter(b.texts)) in a.texts else 0
    if a.children and b.children:
        return 2 + same + align(a.children, b.children)[0]
    return 2 + same


def align(xs: list[Node], ys: list[Node]) -> tuple[int, list[tuple[int, int]]]:
    """The alignment of two ordered forests of greatest weight, and the pairs matched in it."""
    n, m = len(xs), len(ys)
    weights = [[_weight(x, y) for y in ys] for x in xs]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        row, above, w = best[i + 1], best[i], weights[i]
        for j in range(m):
            here = above[j] + w[j]
            left, up = row[j], above[j + 1]
            row[j + 1] = here if here >= left and here >= up and w[j] else left if left >= up else up
    pairs = []
    i, j = n, m
    while i and j:
        w = weights[i - 1][j - 1]
        if w and best[i][j] == best[i - 1][j - 1] + w:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i -= 1
    return best[n][m], pairs[::-1]


def fold(template: list[Node], page: list[Node]) -> list[Node]:
    """The template with one more page: matched nodes take up its texts, others are inserted."""
    if not template:
        return page
    out: list[Node] = []
    i = j = 0
    for x, y in [*align(template, page)[1], (len(template), len(page))]:
        out.extend(template[i:x])
        out.extend(page[j:y])
        if x < len(template):
            node, other = template[x], page[y]
            for text, n in other.texts.items():
                node.texts[text] = node.texts.get(text, 0) + n
            if other.children:
                node.children = fold(node.children, other.children)
            out.append(node)
        i, j = x + 1, y + 1
    return out


def aligned(nodes: list[Node]) -> dict[int, int]:
    """The texts of free paragraphs, and on how many pages the node has each that has it most."""
    most: dict[int, int] = {}
    for node in nodes:
        if node.tag == "p":
            for text, n in node.texts.items():
                most[text] = max(n, most.get(text, 0))
    return most


def _induce(pages: pd.DataFrame) -> pd.DataFrame:
    template: list[Node] = []
    held: Counter[int] = Counter()
    for tags, texts in zip(pages["tags"], pages["hashes"]):
        page = tree(tags.split(" "), list(texts))
        held.update({text for node in page if node.tag == "p" for text in node.texts})
        template = fold(template, page)
    host = pages["host"].iloc[0]
    # of several pages that hold a text, no two at the same node: it is content that recurs
    rows = [(host, text, held[text], n > 1, held[text] > 1) for text, n in aligned(template).items()]
    return pd.DataFrame(rows, columns=["host", "hash", "pages", "constant", "several"]).astype({"hash": "int64", "pages": "int64", "constant": "bool", "several": "bool"})


def _hash(tag: str, text: str) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(f"{kind(tag)} {' '.join(text.split())}")).view(np.int64))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in parts(batch, "text"):
            pieces, tags, texts, hashes, pages = [], [], [], [], []
            for text in strings(part, "text"):
                blocks, n = parse(text)
                if not n and text and not text.isascii():
                    # signs of markup may themselves be written in other characters
                    form = one_form(text)
                    if form != text:
                        blocks_of_form, n = parse(form)
                        blocks = blocks_of_form if n else blocks
                pieces.append(n)
                tags.append(" ".join(t for t, _ in blocks))
                texts.append([x for _, x in blocks])
                hashes.append([_hash(t, x) for t, x in blocks])
                pages.append(int(np.uint64(xxhash.xxh3_64_intdigest(np.array(hashes[-1], dtype=np.int64).tobytes())).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("kind"),
                    part.column("id"),
                    part.column("host"),
                    pa.array(pieces, pa.int32()),
                    pa.array(tags, pa.string()),
                    pa.array(texts, pa.list_(pa.string())),
                    pa.array(hashes, pa.list_(pa.int64())),
                    pa.array(pages, pa.int64()),
                ],
                names=["kind", "id", "host", "pieces", "tags", "texts", "hashes", "page"],
            )


_READ = "kind string, id long, host string, pieces int, tags string, texts array<string>, hashes array<long>, page long"


def templates(read: DataFrame, block: int = BLOCK) -> DataFrame:
    """``host, hash, pages``: the constant free paragraphs of each host that has any, and how many
    different pages hold them."""
    pages = read.where("tags != ''").select("host", "page", "tags", "hashes").dropDuplicates(["host", "page"])
    held = pages.groupBy("host").count().withColumn("blocks", F.ceil(F.col("count") / block))
    salted = pages.join(held, "host").withColumn("block", F.pmod(F.xxhash64("page"), F.col("blocks")))
    # a number of its own keeps the blocks apart: their rows are small, their alignment is the work
    width = int(read.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = salted.select("host", "block", "tags", "hashes").repartition(width, "host", "block")
    found = spread.groupBy("host", "block").applyInPandas(_induce, "host string, hash long, pages long, constant boolean, several boolean")
    total = found.groupBy("host", "hash").agg(F.sum("pages").alias("pages"), F.max("constant").alias("constant"), F.max("several").alias("several"))
    return total.where((F.col("pages") >= LEAST_PAGES) & (F.col("constant") | ~F.col("several"))).select("host", "hash", "pages")


def _templated(read: DataFrame, fixed: DataFrame, limit: int) -> DataFrame:
    """The read rows with ``template``, those of their hashes that are in the template of their host."""
    if fixed.limit(limit + 1).count() <= limit:
        of_host = fixed.groupBy("host").agg(F.collect_set("hash").alias("template"))
        return read.join(F.broadcast(of_host), "host", "left").withColumn("template", F.array_intersect("hashes", "template"))
    pages = read.select("host", "page", "hashes").dropDuplicates(["host", "page"]).select("host", "page", F.explode("hashes").alias("hash"))
    of_page = pages.join(fixed.select("host", "hash"), ["host", "hash"]).groupBy("host", "page").agg(F.collect_set("hash").alias("template"))
    return read.join(of_page, ["host", "page"], "left")


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, dropped = [], []
        columns = (batch.column(c).to_pylist() for c in ("tags", "texts", "hashes", "template"))
        for tags, bodies, hashes, template in zip(*columns):
            blocks: list[Block] = list(zip(tags.split(" "), bodies)) if bodies else []
            fixed = set(template or ())
            content = [b for b, h in zip(blocks, hashes) if h not in fixed] if fixed else blocks
            texts.append(render(content))
            dropped.append(len(blocks) - len(content))
        yield pa.RecordBatch.from_arrays(
            [batch.column("kind"), batch.column("id"), batch.column("host"), batch.column("pieces"), pa.array(dropped, pa.int32()), pa.array(texts, pa.string())],
            names=["record_kind", "record_id", "host", "pieces", "template_blocks", "clean"],
        )


def _source(records: DataFrame) -> DataFrame:
    return records.select(F.col("kind").cast("string").alias("kind"), F.col("id").cast("long").alias("id"), F.coalesce(F.col("host"), F.lit("")).alias("host"), F.col("text"))


def clean_markup(records: DataFrame, block: int = BLOCK, limit: int = BROADCAST_NODES) -> DataFrame:
    """``record_kind, record_id, host, pieces, template_blocks, clean`` for each row of ``records``
    (``kind, id, host, text``).

    ``pieces`` counts the pieces of markup, 0 for plain text, ``template_blocks`` the constant
    paragraphs left out. A null or empty text is clean as the empty string, with 0 pieces; a null
    host is a host of its own; null ids stay null; repeated rows stay repeated; no rows give none.
    """
    read = keep(_source(records).mapInArrow(_read, _READ))
    fixed = keep(templates(read, block))
    rows = _templated(read, fixed, limit).drop("page")
    return rows.mapInArrow(_write, "record_kind string, record_id long, host string, pieces int, template_blocks int, clean string")


def template_nodes(records: DataFrame, block: int = BLOCK, limit: int = BROADCAST_NODES) -> DataFrame:
    """``host, text, pages``: what was induced as template of each host of ``records`` (``kind, id,
    host, text``), and on how many different pages it stands. White space of a text is collapsed;
    hosts without a template have no row."""
    read = keep(_source(records).mapInArrow(_read, _READ))
    fixed = sized(keep(templates(read, block)), limit)
    nodes = read.select("host", F.explode(F.arrays_zip("hashes", "texts")).alias("n")).select("host", F.col("n.hashes").alias("hash"), F.col("n.texts").alias("text"))
    held = nodes.join(fixed, ["host", "hash"]).groupBy("host", "hash", "pages").agg(F.min("text").alias("text"))
    return held.select("host", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"), "pages")
